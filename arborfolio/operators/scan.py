"""Running products, maxima and rows before, over an order, without one task that has all rows.

An order is cut into parts (months or years of a date). A part's rows are run through by themselves; a row per part says
what it comes to, and what the parts before it come to is added to each of its rows. So a series of any length is as many
tasks as it has parts, with or without keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What joins two parts: the earlier parts' value with a part's own.
JOIN = {
    "product": lambda a, b: F.coalesce(a * b, a, b),
    "max": lambda a, b: F.greatest(a, b),
    "before": lambda a, b: b,
    "last": lambda a, b: F.coalesce(b, a),
}


def _inside(kind: str, value: Column, order: str) -> Column:
    """What the rows of a part come to, as an aggregate."""
    if kind == "before":
        return F.max_by(value, order)
    if kind == "last":
        return F.max_by(value, F.when(value.isNotNull(), F.col(order)))
    return F.product(value) if kind == "product" else F.max(value)


def running(rows: DataFrame, order: str, part: Column, keys: tuple[str, ...] = (), **scans: tuple[str, Column]) -> DataFrame:
    """rows with a column for each scan, (kind, value) by name: `product` and `max` of the values up to the row (nulls count
    for nothing), the `last` value that isn't null up to the row, or the value `before`: in the row before. Rows of a key have
    different places in the order."""
    rows = rows.withColumn("_part", part)
    inside = Window.partitionBy(*keys, "_part").orderBy(order)
    own, whole = {}, []
    for name, (kind, value) in scans.items():
        own[f"_{name}"] = (F.lag(value) if kind == "before" else F.last(value, True) if kind == "last" else _inside(kind, value, order)).over(inside)
        whole.append(_inside(kind, value, order).alias(name))
    if any(kind == "before" for kind, _ in scans.values()):
        own["_first"] = F.row_number().over(inside) == 1
    parts = rows.groupBy(*keys, "_part").agg(*whole)
    lists = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_part", *scans))).alias("_parts"))  # a row per part in an array
    earlier = lists.select(*keys, F.posexplode("_parts").alias("_k", "_x"), "_parts")
    ahead = []
    for name, (kind, _) in scans.items():
        if kind == "before":
            ahead.append(F.get("_parts", F.col("_k") - 1)[name].alias(f"_{name}_ahead"))
        else:
            none = F.lit(None).cast(parts.schema[name].dataType)
            ahead.append(F.aggregate(F.slice("_parts", F.lit(1), F.col("_k")), none, _step(kind, name)).alias(f"_{name}_ahead"))
    earlier = earlier.select(*keys, F.col("_x._part").alias("_part"), *ahead)
    out = rows.withColumns(own).join(earlier, [*keys, "_part"])
    made = {}
    for name, (kind, _) in scans.items():
        a, b = F.col(f"_{name}_ahead"), F.col(f"_{name}")
        made[name] = F.when(F.col("_first"), a).otherwise(b) if kind == "before" else JOIN[kind](a, b)
    return out.withColumns(made).drop("_part", "_first", *(f"_{n}" for n in scans), *(f"_{n}_ahead" for n in scans))


def as_of(left: DataFrame, right: DataFrame, value: str, part: Column, keys: tuple[str, ...] = (), order: str = "date") -> DataFrame:
    """left with the value of right's last row at or before each of its rows; null values of right count as no row. Both
    sides are put into one order and run through once. right has one row for each place of a key."""
    both = left.select(*keys, order).distinct().join(right.select(*keys, order, value), [*keys, order], "full")
    found = running(both, order, part, keys, **{value: ("last", F.col(value))})
    return left.join(found.select(*keys, order, value), [*keys, order], "left")


def _step(kind: str, name: str) -> Callable[[Column, Column], Column]:
    return lambda a, x: JOIN[kind](a, x[name])


def numbered(rows: DataFrame, column: str, name: str = "k") -> DataFrame:
    """The distinct values of a column, which are few (a row per month), numbered from 1 in their order."""
    values = rows.agg(F.array_sort(F.collect_set(column)).alias("v"))
    return values.select(F.posexplode("v").alias("i", column)).select(column, (F.col("i") + 1).alias(name))

"""Validation: one aggregate over a long frame, then an error on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborfolio.config import DataValidationError
from arborfolio.functions.columns import not_finite
from arborfolio.sources.panels import require_frame


def quality(panel: DataFrame, value: str = "price", by: tuple[str, ...] = ()) -> DataFrame:
    """One row (or one for each of `by`): dates, assets, rows, null_dates, null_values, duplicates, not_finite, not_positive."""
    v = F.col(value)
    keys = panel.groupBy(*by, "date", "asset").agg(F.count("*").alias("n"), F.count_if(v.isNull()).alias("nulls"), F.count_if(not_finite(v)).alias("odd"), F.count_if(v <= 0).alias("low"))
    return keys.groupBy(*by).agg(
        F.count_distinct("date").alias("dates"),
        F.count_distinct("asset").alias("assets"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(F.col("date").isNull(), F.col("n"))), F.lit(0)).alias("null_dates"),
        F.coalesce(F.sum("nulls"), F.lit(0)).alias("null_values"),
        F.count_if((F.col("n") > 1) & F.col("date").isNotNull()).alias("duplicates"),
        F.coalesce(F.sum("odd"), F.lit(0)).alias("not_finite"),
        F.coalesce(F.sum("low"), F.lit(0)).alias("not_positive"),
    )


def _fail(name: str, found: dict, *rules: tuple[bool, str]) -> None:
    for broken, message in rules:
        if broken:
            raise DataValidationError(f"{name}: {message}", **found)


def close_prices_are_valid() -> Column:
    """validate_close_prices() as an expression over the columns of quality()."""
    whole = F.col("null_values") + F.col("null_dates") == 0
    return (F.col("dates") >= 3) & whole & (F.col("rows") >= F.col("dates") * F.col("assets")) & (F.col("duplicates") == 0) & (F.col("not_finite") + F.col("not_positive") == 0)


def validate_close_prices(panel: DataFrame, name: str = "prices") -> DataFrame:
    q = quality(require_frame(panel, name)).first().asDict()
    holes = q["null_values"] + q["null_dates"] + (q["rows"] < q["dates"] * q["assets"])
    _fail(name, q, (q["dates"] < 3, "three dates or more are needed"), (holes > 0, "values are missing"), (q["duplicates"] > 0, "dates repeat"), (q["not_finite"] + q["not_positive"] > 0, "prices must be finite and positive"))
    return panel


def validate_returns(panel: DataFrame, value: str = "r", name: str = "returns") -> DataFrame:
    q = quality(require_frame(panel, name), value).first().asDict()
    holes = q["null_values"] + q["null_dates"] + (q["rows"] < q["dates"] * q["assets"])
    _fail(name, q, (holes > 0, "values are missing"), (q["duplicates"] > 0, "dates repeat"), (q["not_finite"] > 0, "returns must be finite"))
    return panel


def validate_dampening_input(panel: DataFrame, value: str = "r") -> DataFrame:
    q = quality(require_frame(panel, "returns"), value).first().asDict()
    _fail("returns", q, (q["assets"] < 1, "an asset is needed"), (q["dates"] < 2, "two dates or more are needed"))
    return validate_returns(panel, value)


def prepare_prices(panel: DataFrame, minimum_assets: int = 2) -> DataFrame:
    """Nulls are allowed outside an asset's history."""
    q = quality(require_frame(panel, "prices")).first().asDict()
    _fail("prices", q, (q["assets"] < minimum_assets, "too few assets"), (q["null_dates"] > 0, "dates are missing"), (q["duplicates"] > 0, "dates repeat"))
    return panel


def prepare_membership(intervals: DataFrame) -> DataFrame:
    require_frame(intervals, "membership")
    bad = intervals.filter("start is null or asset is null or end_excl <= start").limit(5).collect()
    if any(r.start is None or r.asset is None for r in bad):
        raise DataValidationError("membership start and ticker are needed")
    if bad:
        raise DataValidationError("membership must end after it starts", rows=[tuple(r) for r in bad])
    return intervals


def prepare_benchmark(prices: DataFrame) -> DataFrame:
    q = quality(require_frame(prices, "benchmark").withColumn("asset", F.lit("benchmark"))).first().asDict()
    _fail("benchmark", q, (q["rows"] < 3, "three rows or more are needed"), (q["null_values"] + q["null_dates"] > 0, "values are missing"), (q["not_positive"] + q["not_finite"] > 0, "prices must be finite and positive"), (q["duplicates"] > 0, "dates repeat"))
    return prices


def prepare_comparison_dates(dates: DataFrame) -> DataFrame:
    q = dates.agg(F.count("*").alias("n"), F.count("date").alias("there"), F.count_distinct("date").alias("distinct")).first()
    if q.n < 2 or q.there < q.n or q.distinct < q.n:
        raise DataValidationError("comparison dates must be two or more, known and unique", **q.asDict())
    return dates

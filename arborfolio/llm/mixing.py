"""Mixing sources to target weights by subset-sum budget fitting.

A document's size is its number of words. Targets fill the budget by weight, none above `most` times its source's size;
what is above goes to the others by weight until none is. A source takes every document floor(target / size) times. The
rest of its target is fitted on the counts of documents by exact size: a bounded-knapsack table finds the counts that come
nearest to it. Of a rest above TABLE words, what is above TABLE is first taken as an equal share of every size, rounded by
largest remainder; the table then has all documents that are left, and 2 * TABLE sums at most. So the sum is the nearest
possible one if the rest is TABLE words at most, and otherwise the nearest one with these shares.

In a size, the documents with the smallest seeded hashes of id and text are taken: the hash of the last one is found from
counts of hashes, so that documents are neither sorted nor shuffled, and each is held against its size's bound.

Defined results: null and empty texts have size 0 and are taken with 0 words; a null source is a source of its own and
sorts last. Only whole documents are taken, so a source ends as near to its target as its sizes allow. Repeated rows are
separate documents; rows with equal id, source and text are interchangeable, whatever is in their other columns. An empty
table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arborfolio.llm.shared import discard, keep, small

#: The weights of query op8, repeating over the sources in order, and its budget and ceiling.
WEIGHTS, BUDGET, MOST = (3, 1, 2), 1.5, 2.0
#: Words that the knapsack table fits at most.
TABLE = 1 << 20
#: Hashes of one size and source that one task puts in order, about.
RANKED = 256
#: Rows of the plan that are broadcast at most; beyond that it is joined by a shuffle.
BROADCAST_ROWS = 200_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def fill_targets(sizes: list[int], weights: list[float], budget: float, most: float = MOST) -> list[float]:
    """Share the budget by weight; no target above most times its size, the excess reshared among the others."""
    targets = [0.0] * len(sizes)
    open_, left = list(range(len(sizes))), budget
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total > most * sizes[i]]
        if not full:
            for i in open_:
                targets[i] = left * weights[i] / total
            break
        for i in full:
            targets[i] = most * sizes[i]
        left -= sum(targets[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return targets


def filled(lengths: list[int], counts: list[int], budget: int, table: int) -> list[int]:
    """How many documents of each length to take before the table: for what is above `table` words the same share of each
    length, rounded down, then one more of each by largest remainder, then more of the longest, until `table` words or less
    are left or no document fits into what is left."""
    total, over = sum(x * c for x, c in zip(lengths, counts, strict=True)), budget - table
    take = [c * over // total if x else 0 for x, c in zip(lengths, counts, strict=True)]
    left = budget - sum(x * t for x, t in zip(lengths, take, strict=True))
    for i in sorted((i for i, x in enumerate(lengths) if x and take[i] < counts[i]), key=lambda i: (-(counts[i] * over % total), -lengths[i])):
        if left <= table:
            break
        if lengths[i] <= left:
            take[i] += 1
            left -= lengths[i]
    for i in sorted((i for i, x in enumerate(lengths) if x and take[i] < counts[i]), key=lambda i: -lengths[i]):
        if left <= table:
            break
        n = min(counts[i] - take[i], left // lengths[i], -(-(left - table) // lengths[i]))
        take[i] += n
        left -= n * lengths[i]
    return take


def fit_budget(lengths: list[int], counts: list[int], budget: int, table: int = TABLE) -> list[int]:
    """How many documents of each length to take, at most its count, so that their words come nearest to the budget (of two
    sums as near, the smaller one): over all choices if the budget is `table` at most, else over those that begin with what
    filled() takes. The table has a bit for each sum, and which step made it: 2 * `table` sums at most."""
    total = sum(x * c for x, c in zip(lengths, counts, strict=True))
    if budget >= total:
        return [c if x else 0 for x, c in zip(lengths, counts, strict=True)]
    take = filled(lengths, counts, budget, table) if budget > table else [0] * len(lengths)
    left = budget - sum(x * t for x, t in zip(lengths, take, strict=True))
    free = sorted((i for i, x in enumerate(lengths) if x and take[i] < counts[i] and x <= 2 * left), key=lambda i: -lengths[i])
    if left <= 0 or not free:
        return take
    if left > table:  # every document that is left is longer than what is left: one of them, or none
        best = min(free, key=lambda i: (lengths[i] - left, lengths[i]))
        take[best] += lengths[best] - left < left
        return take
    # step[s]: the step that first made the sum s, of so many documents of one length; a sum is made from those of earlier
    # steps. Sums are counted in units of what divides all lengths.
    unit = math.gcd(*(lengths[i] for i in free))
    limit, nearest = min(2 * left, left + lengths[free[0]]) // unit, (left + (unit - 1) // 2) // unit
    step, steps = np.zeros(limit + 1, np.int32), [(0, 0)]
    made, within = 1, (1 << (limit + 1)) - 1
    for i in free:
        size = lengths[i] // unit
        rest, part = min(counts[i] - take[i], limit // size), 1
        while rest and not made >> nearest & 1:
            n = min(part, rest)
            if new := (made << n * size) & within & ~made:
                step[np.flatnonzero(np.unpackbits(np.frombuffer(new.to_bytes(limit // 8 + 1, "little"), np.uint8), bitorder="little"))] = len(steps)
                made |= new
                steps.append((i, n))
            rest -= n
            part *= 2
    sums = np.append(0, np.flatnonzero(step))
    goal = int(sums[np.lexsort((sums, np.abs(sums * unit - left)))[0]])
    while goal:
        i, n = steps[step[goal]]
        take[i] += n
        goal -= n * lengths[i] // unit
    return take


def _plan(sized: DataFrame, weights: tuple[float, ...], budget: float, most: float, max_sources: int) -> tuple[DataFrame, list[str]]:
    """sized: source, size, h. Rows p_source, p_size, source_size, target, whole, last, ties, among, by source and size: every
    document is taken `whole` times, those with a hash below `last` once more, and `ties` of the `among` that have this hash."""
    spark = sized.sparkSession
    lengths, path1 = keep(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "lengths")
    sources = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("total")).limit(max_sources + 1).collect()
    if len(sources) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    sources.sort(key=lambda r: (r.source is None, r.source or ""))
    totals = [int(r.total) for r in sources]
    targets = fill_targets(totals, [weights[i % len(weights)] for i in range(len(sources))], budget * sum(totals), most)
    goals = spark.createDataFrame([(r.source, n, t) for r, n, t in zip(sources, totals, targets, strict=True)], "source string, source_size long, target double")

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size")
        size, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
        whole = min(int(target // size), int(most)) if size else 0
        lengths, counts = rows["size"].tolist(), rows["n"].tolist()
        take = fit_budget(lengths, counts, max(0, round(target - whole * size))) if size else [0] * len(lengths)
        return rows.assign(whole=whole, extra=take)[["source", "size", "n", "source_size", "target", "whole", "extra"]]

    # a source has a row for each of its sizes, so that the group stays small
    plan = lengths.join(F.broadcast(goals), lengths["source"].eqNullSafe(goals["source"])).select(lengths["source"], "size", "n", "source_size", "target")
    plan = plan.groupBy("source").applyInPandas(fit, "source string, size long, n long, source_size long, target double, whole long, extra long")
    plan, path2 = keep(plan, "mix-plan")
    open_ = plan.filter((F.col("extra") > 0) & (F.col("extra") < F.col("n"))).select(F.col("source").alias("o_source"), F.col("size").alias("o_size"), "n", "extra")
    open_ = small(open_, BROADCAST_ROWS)
    # a size that many documents share is cut by hash into buckets of about RANKED hashes; the bound is in the bucket in which the count is reached
    buckets = F.ceil(F.col("n") / RANKED)
    rows = sized.join(open_, sized["source"].eqNullSafe(F.col("o_source")) & (sized["size"] == F.col("o_size")))
    rows = rows.select("source", "size", "extra", "h", F.least(buckets - 1, F.floor((F.col("h") / 2.0**64 + 0.5) * buckets)).cast("long").alias("bucket"))
    by_size = Window.partitionBy("source", "size")
    filled = rows.groupBy("source", "size", "extra", "bucket").agg(F.count("*").alias("here"))
    filled = filled.withColumn("before", F.sum("here").over(by_size.orderBy("bucket")) - F.col("here"))
    filled = filled.filter((F.col("before") < F.col("extra")) & (F.col("before") + F.col("here") >= F.col("extra")))
    filled, path3 = keep(filled.select(F.col("source").alias("f_source"), F.col("size").alias("f_size"), F.col("bucket").alias("f_bucket"), "before"), "mix-buckets")
    within = rows.join(small(filled, BROADCAST_ROWS), rows["source"].eqNullSafe(F.col("f_source")) & (F.col("size") == F.col("f_size")) & (F.col("bucket") == F.col("f_bucket")))
    within = within.groupBy("source", "size", "extra", "before", "h").agg(F.count("*").alias("among"))
    within = within.withColumn("before", F.col("before") + F.sum("among").over(by_size.orderBy("h")) - F.col("among"))
    bounds = within.filter((F.col("before") < F.col("extra")) & (F.col("before") + F.col("among") >= F.col("extra")))
    bounds = bounds.select(F.col("source").alias("b_source"), F.col("size").alias("b_size"), F.col("h").alias("last"), (F.col("extra") - F.col("before")).alias("ties"), "among")
    plan = plan.join(bounds, plan["source"].eqNullSafe(F.col("b_source")) & (plan["size"] == F.col("b_size")), "left")
    whole = F.col("whole") + F.when(F.col("extra") == F.col("n"), 1).otherwise(0)
    plan = plan.select(F.col("source").alias("p_source"), F.col("size").alias("p_size"), "source_size", "target", whole.alias("whole"), "last", "ties", "among")
    plan, path4 = keep(plan, "mix-bounds")
    return plan, [path1, path2, path3, path4]


def _taken(rows: DataFrame, plan: DataFrame) -> tuple[DataFrame, list[str]]:
    """rows: _source, _size, _h and others. Adds source_size, target, _copies; the paths of tables that the result reads."""
    joined = rows.join(small(plan, BROADCAST_ROWS), rows["_source"].eqNullSafe(F.col("p_source")) & (rows["_size"] == F.col("p_size")))
    even = F.col("last").isNull() | (F.col("_h") != F.col("last")) | (F.col("ties") == F.col("among"))
    out = [*rows.columns, "source_size", "target"]
    copies = F.col("whole") + F.when(F.col("_h") <= F.col("last"), 1).otherwise(0)
    taken = joined.filter(even).select(*out, copies.alias("_copies"))
    if not plan.filter("ties < among").limit(1).count():
        return taken, []
    # rows that nothing tells apart, of which some are taken: numbered within the parts of their table, as there may be many
    tied, path = keep(joined.filter(~even).withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id()), "mix-ties")
    parts = tied.groupBy("_source", "_size", "_part").agg(F.count("*").alias("_here"))
    parts = parts.withColumn("_before", F.sum("_here").over(Window.partitionBy("_source", "_size").orderBy("_part")) - F.col("_here"))
    parts = small(parts.select(F.col("_source").alias("t_source"), F.col("_size").alias("t_size"), F.col("_part").alias("t_part"), "_before"), BROADCAST_ROWS)  # a row per size and partition
    number = F.col("_before") + F.row_number().over(Window.partitionBy("_source", "_size", "_part").orderBy("_place"))
    ranked = tied.join(parts, tied["_source"].eqNullSafe(F.col("t_source")) & (F.col("_size") == F.col("t_size")) & (F.col("_part") == F.col("t_part")))
    copies = F.col("whole") + F.when(number <= F.col("ties"), 1).otherwise(0)
    return taken.unionByName(ranked.select(*out, copies.alias("_copies"))), [path]


def _hash(id_: Column, text: Column, seed: int) -> Column:
    return F.xxhash64(id_.cast("string"), text, F.lit(seed))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_sources: int = 100_000) -> DataFrame:
    """One row per row of docs: id, source, size, source_size, target (its source's), copies, taken (copies * size).

    max_sources: sources are listed on the driver; more of them is an error.
    """
    spark = docs.sparkSession
    sized, path = keep(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), _hash(F.col(id_col), F.col(text_col), seed).alias("h")), "sizes")
    plan, paths = _plan(sized, weights, budget, most, max_sources)
    rows, more = _taken(sized.select("id", F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("h").alias("_h")), plan)
    copies = F.col("_copies")
    out, _ = keep(rows.select("id", F.col("_source").alias("source"), F.col("_size").alias("size"), "source_size", "target", copies.alias("copies"), (copies * F.col("_size")).alias("taken")), "mix")
    discard(spark, path, *paths, *more)
    return out


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_sources: int = 100_000) -> DataFrame:
    """The rows of docs, all columns, as often as mix() takes them; each is held against its size's bound where it is."""
    keys = (F.col(source_col).cast("string").alias("_source"), word_count(F.col(text_col)).alias("_size"), _hash(F.col(id_col), F.col(text_col), seed).alias("_h"))
    sized, path = keep(docs.select(*keys).toDF("source", "size", "h"), "sizes")
    plan, _ = _plan(sized, weights, budget, most, max_sources)
    discard(docs.sparkSession, path)
    rows, _ = _taken(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), *keys), plan)
    return rows.filter("_copies > 0").select("_doc", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("_doc.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")

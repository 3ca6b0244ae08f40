"""Trailing medians by a sorted window that slides, and series cut into time ranges that overlap by a halo.

A step of the window takes one value out and puts one in, by binary search; the median lies in its middle, and the median
deviation is found by binary search too: the k values nearest to the median are neighbours in the sorted window. So a row
costs a few comparisons per doubling of the window, not a sort of its frame.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborfolio.functions.columns import month_of


def sliding_medians(values: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The median and the median absolute deviation of the `window` values that end at each place, from place window - 1 on;
    NaN where one of them is NaN."""
    n, x = len(values), values.tolist()
    med, mad = np.full(max(0, n - window + 1), np.nan), np.full(max(0, n - window + 1), np.nan)
    frame: list[float] = []
    for i, new in enumerate(x):
        if i >= window and (old := x[i - window]) == old:
            del frame[bisect_left(frame, old)]
        if new == new:
            insort(frame, new)
        if i >= window - 1 and len(frame) == window:
            at = (frame[(window - 1) // 2] + frame[window // 2]) / 2
            med[i - window + 1] = at
            low = _nearest(frame, at, (window - 1) // 2)
            mad[i - window + 1] = low if window % 2 else (low + _nearest(frame, at, window // 2)) / 2
    return med, mad


def _nearest(frame: list[float], at: float, k: int) -> float:
    """The k-th smallest (from 0) of the distances to `at`: the values up to it are neighbours in the sorted frame."""
    low, high = 0, len(frame) - 1 - k
    while low < high:
        middle = (low + high) // 2
        if at - frame[middle] > frame[middle + k + 1] - at:
            low = middle + 1
        else:
            high = middle
    return max(at - frame[low], frame[low + k] - at)


def time_ranges(rows: DataFrame, keys: tuple[str, ...], block_rows: int, halo: int) -> DataFrame:
    """rows with a date, and columns block and own: each key's series in blocks of `block_rows` rows or up to a month's more,
    in the order of dates. A block has its own rows and, with own false, those months before it that hold the `halo` rows
    before its first one, and no more months than that. A key's months are counted first, so that neither a key's series nor
    its list of dates passes through one task: only a row per key and month does."""
    rows = rows.withColumn("_month", month_of(F.col("date")))
    counts = rows.groupBy(*keys, "_month").agg(F.count("*").alias("n"))
    running = Window.partitionBy(*keys).orderBy("_month")
    placed = counts.withColumn("before", F.sum("n").over(running) - F.col("n")).withColumn("block", F.floor(F.col("before") / block_rows))
    starts = placed.groupBy(*(F.col(k).alias(f"_{k}") for k in keys), F.col("block").alias("_block")).agg(F.min("before").alias("first"))
    # a month is in its own block, and in the halo of the later blocks that begin less than `halo` rows behind its end
    ends = placed.select(*keys, "_month", "block", (F.col("before") + F.col("n")).alias("end"))
    last = F.floor((F.col("end") + halo) / block_rows)
    near = ends.withColumn("_next", F.explode(F.when(last > F.col("block"), F.sequence(F.col("block") + 1, last))))
    near = near.join(starts, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("_next") == F.col("_block")]).filter(F.col("first") - F.col("end") < halo)
    halves = ends.select(*keys, "_month", "block", F.lit(True).alias("own")).unionByName(near.select(*keys, "_month", F.col("_block").alias("block"), F.lit(False).alias("own")))
    return rows.join(halves, [*keys, "_month"]).drop("_month")


def by_time_range(rows: DataFrame, keys: tuple[str, ...], block_rows: int, halo: int, kernel: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """kernel over each block of time_ranges(), whose rows it gets in the order of dates with the halo before its own; of
    what it returns, rows of the halo are left out."""
    schema = rows.schema

    def run(block: pd.DataFrame) -> pd.DataFrame:
        out = kernel(block.sort_values("date", kind="stable"))
        return out[out["own"]][schema.names]

    return time_ranges(rows, keys, block_rows, halo).groupBy(*keys, "block").applyInPandas(run, schema)

"""Realized covariances by blocks of assets, for universes whose returns don't fit one task.

Assets are dealt to blocks by hash; a task has the returns of one month and two blocks and multiplies two matrices. So a
task holds 2/blocks of a month's returns, and a return is sent to as many tasks as there are blocks: its share of the pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborfolio.functions.columns import month_of


def blocked_cov(returns: DataFrame, blocks: int) -> DataFrame:
    """Rows month, i, j (i <= j), cov: sums of products of returns on the dates that both assets have."""
    own = F.pmod(F.xxhash64("asset"), F.lit(blocks)).cast("int")
    rows = returns.select(month_of(F.col("date")).alias("month"), "date", "asset", "r", own.alias("own"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = rows.select("month", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "date", "asset", "r")
    return rows.groupBy("month", "p", "q").applyInPandas(_products, "month date, i string, j string, cov double")


def _products(rows: pd.DataFrame) -> pd.DataFrame:
    p, q = rows["p"].iloc[0], rows["q"].iloc[0]
    day, days = pd.factorize(rows["date"])
    sides = []
    for block in (p, q):
        mine = (rows["own"] == block).to_numpy()
        asset, names = pd.factorize(rows["asset"][mine], sort=True)
        x, there = np.zeros((len(names), len(days))), np.zeros((len(names), len(days)))
        np.add.at(x, (asset, day[mine]), rows["r"][mine].to_numpy(float))
        there[asset, day[mine]] = 1
        sides.append((np.asarray(names, object), x, there))
    (left, x, there), (right, y, also) = sides
    cov, common = x @ y.T, there @ also.T > 0
    if p == q:
        common &= np.triu(np.ones(common.shape, bool))
    a, b = np.nonzero(common)
    i, j = left[a], right[b]
    turned = i > j
    i, j = np.where(turned, j, i), np.where(turned, i, j)
    return pd.DataFrame({"month": rows["month"].iloc[0], "i": i, "j": j, "cov": cov[a, b]})

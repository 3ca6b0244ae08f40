"""Holding months in closed form: weights drift with prices, nothing is iterated by day.

With p0 the price on the trading date before the month, V(t) is the sum of w * P(t) / P(p0); gross returns are ratios of V,
end weights the terms of V at the end. Months are linked only by turnover, which needs the end weights of the month before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborfolio.config import EPSILON, CalculationError
from arborfolio.functions.columns import month_of, not_finite
from arborfolio.operators.scan import running


def held_values(panel: DataFrame, dates: DataFrame, moments: DataFrame, weights: DataFrame) -> DataFrame:
    """weights: rid, variant, asset, weight. Rows rid, variant, asset, date, v: weight times growth since the month's start.
    The panel meets its months, and the dates before them, by equal keys; both have a row per month and are broadcast."""
    before = running(dates.select("date").distinct(), "date", F.trunc("date", "year"), p0=("before", F.col("date")))
    starts = moments.select("rid", F.col("eff").alias("date")).join(before, "date").select("rid", F.col("p0").alias("date"))
    start = panel.join(F.broadcast(starts), "date").select("rid", "asset", F.col("price").alias("start"))
    spans = moments.select("rid", "month", "eff", "hold_end")
    held = panel.withColumn("month", month_of(F.col("date"))).join(F.broadcast(spans), "month").filter(F.col("date").between(F.col("eff"), F.col("hold_end")))
    held = held.select("rid", "asset", "date", "price").join(weights, ["rid", "asset"]).join(start, ["rid", "asset"])
    return held.select("rid", "variant", "asset", "date", (F.col("weight") * F.try_divide("price", "start")).alias("v"))


def end_weights(values: DataFrame) -> DataFrame:
    last = values.groupBy("rid", "variant", "asset").agg(F.max_by("v", "date").alias("v"))
    return last.withColumn("weight", F.col("v") / F.sum("v").over(Window.partitionBy("rid", "variant"))).drop("v")


def turnover(weights: DataFrame, ends: DataFrame) -> DataFrame:
    """Half the absolute change against the drifted weights of the month before, over both months' assets; 0.5 at first."""
    old = ends.select((F.col("rid") + 1).alias("rid"), "variant", "asset", F.col("weight").alias("old"))
    old = old.join(F.broadcast(weights.select("rid", "variant").distinct()), ["rid", "variant"], "left_semi")  # a row per month
    both = weights.select("rid", "variant", "asset", "weight").join(old, ["rid", "variant", "asset"], "full")
    change = F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("old", F.lit(0.0)))
    return both.groupBy("rid", "variant").agg((0.5 * F.sum(change)).alias("turnover"))


def daily_returns(values: DataFrame, turnovers: DataFrame, bps: float) -> DataFrame:
    """Rows rid, variant, Date, Month, GrossReturn, TransactionCost, NetReturn, NetValue."""
    daily = values.groupBy("rid", "variant", "date").agg(F.sum("v").alias("v"))
    month = Window.partitionBy("rid", "variant").orderBy("date")
    gross = F.col("v") / F.coalesce(F.lag("v").over(month), F.lit(1.0)) - 1
    daily = daily.withColumn("GrossReturn", gross).withColumn("first", F.row_number().over(month) == 1)
    daily = daily.join(F.broadcast(turnovers), ["rid", "variant"])  # a row per month
    cost = F.when(F.col("first"), F.col("turnover") * bps / 10_000).otherwise(F.lit(0.0))
    daily = daily.withColumn("TransactionCost", cost).withColumn("NetReturn", (1 - cost) * (1 + F.col("GrossReturn")) - 1)
    path = Window.partitionBy("variant").orderBy("date")  # a row per trading date
    return daily.withColumn("NetValue", F.product(1 + F.col("NetReturn")).over(path)).select("rid", "variant", F.col("date").alias("Date"), F.trunc("date", "MM").alias("Month"), "GrossReturn", "TransactionCost", "NetReturn", "NetValue")


def check_growth(daily: DataFrame) -> DataFrame:
    """The value of a portfolio stays above zero and its weights can be made to add up to 1."""
    gross = F.col("GrossReturn")
    if bad := daily.filter(gross.isNull() | not_finite(gross) | (1 + gross <= EPSILON)).orderBy("Date").limit(1).collect():
        raise CalculationError("the portfolio lost everything, or its value is unknown", date=str(bad[0].Date))
    return daily


def monthly_returns(daily: DataFrame) -> DataFrame:
    """Compounded months with their costs; NetValue at the month's end."""
    months = daily.groupBy("rid", "variant", "Month").agg((F.product(1 + F.col("GrossReturn")) - 1).alias("GrossReturn"), F.sum("TransactionCost").alias("TransactionCost"), (F.product(1 + F.col("NetReturn")) - 1).alias("NetReturn"), F.max_by("NetValue", "Date").alias("NetValue"))
    return months

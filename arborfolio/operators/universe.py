"""Which assets are members with complete prices at each monthly rebalance."""

from __future__ import annotations

from datetime import date, timedelta
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborfolio.config import DataValidationError
from arborfolio.functions.columns import month_of

COMPLETE, INCOMPLETE, NO_PRICES = "EligibleCompleteEstimationAndHoldingWindow", "IncompleteEstimationOrHoldingWindow", "MissingPriceColumn"


def rebalances(calendar: DataFrame, months: int) -> DataFrame:
    """Rows rid, month, eff, hold_end, m0, m1: the estimation window is the calendar's `months` months before."""
    first = calendar.select((F.col("k") + months).alias("k"), F.col("Month").alias("m0"))
    last = calendar.select((F.col("k") + 1).alias("k"), F.col("Month").alias("m1"))
    return calendar.join(F.broadcast(first), "k").join(F.broadcast(last), "k").select(F.col("k").cast("int").alias("rid"), F.col("Month").alias("month"), F.col("EffectiveDate").alias("eff"), F.col("HoldingEndDate").alias("hold_end"), "m0", "m1")  # a row per month


def active_members(intervals: DataFrame, moments: DataFrame) -> DataFrame:
    """Members of each rebalance: start <= eff < end. Intervals are laid out by the years that they touch, within those of
    the rebalances, and meet the rebalances of a year by an equal key; their ends are compared behind it."""
    years = moments.agg(F.min(F.year("eff")).alias("first"), F.max(F.year("eff")).alias("last")).first()
    first, last = (years.first or 0, years.last or 0)
    begins = F.greatest(F.year("start"), F.lit(first))
    ends = F.least(F.coalesce(F.year("end_excl"), F.lit(last)), F.lit(last))
    laid = intervals.withColumn("_year", F.explode(F.when(begins <= ends, F.sequence(begins, ends))))
    held = (F.col("start") <= F.col("eff")) & (F.col("end_excl").isNull() | (F.col("end_excl") > F.col("eff")))
    return laid.join(F.broadcast(moments.withColumn("_year", F.year("eff"))), "_year").filter(held).drop("_year")  # a row per month


def _months(dates: DataFrame) -> list[tuple]:
    """(month, dates, last date) of the calendar's months in order; a row per date comes to the driver."""
    days: dict[date, list[date]] = {}
    for r in dates.select("date").distinct().collect():
        if r.date is not None:
            days.setdefault(r.date.replace(day=1), []).append(r.date)
    return [(m, len(x), max(x)) for m, x in sorted(days.items())]


def _places(months: list[tuple]) -> list[tuple]:
    """(month, k, last date) of every month from the calendar's first to its last; a month that the calendar lacks has the
    place of the one before it."""
    out: list[tuple] = []
    for k, (month, _, end) in enumerate(months, 1):
        while out and (gap := (out[-1][0] + timedelta(days=31)).replace(day=1)) < month:
            out.append((gap, *out[-1][1:]))
        out.append((month, k, end))
    return out


def eligibility(panel: DataFrame, dates: DataFrame, intervals: DataFrame, moments: DataFrame) -> DataFrame:
    """The audit of all rebalances: a row per rebalance and active member.

    dates is the base panel's calendar, which says how many prices a member needs; tables with a row per month are made on
    the driver. One pass over the panel counts each asset's prices by month, an array per asset; a window's count is a sum
    over its part of the array. Prices on dates after the calendar's last one of a month count for the windows that go on
    after that month only.
    """
    spark = panel.sparkSession
    active = active_members(intervals, moments).select("rid", "eff", "hold_end", "m0", "m1", "asset")
    if active.groupBy("rid", "asset").count().filter("count > 1").limit(1).count():
        raise DataValidationError("a ticker is active twice at a rebalance")
    months = _months(dates)
    number = {m: k for k, (m, _, _) in enumerate(months, 1)}
    days = list(accumulate((n for _, n, _ in months), initial=0))
    spans = [(r.rid, number[r.m0], days[r.rid] - days[number[r.m0] - 1]) for r in moments.select("rid", "m0").collect()]
    required = spark.createDataFrame(spans, "rid int, k0 int, required long")
    placed = spark.createDataFrame(_places(months), "Month date, k int, end date")
    valid = (F.col("price") > 0) & ~F.isnan("price")
    last = F.lit(months[-1][0] if months else None).cast("date")
    counts = panel.withColumn("Month", F.least(month_of(F.col("date")), last)).join(F.broadcast(placed), "Month", "left")
    counts = counts.groupBy("asset", "k").agg(F.count_if(valid).alias("whole"), F.count_if(valid & (F.col("date") <= F.col("end"))).alias("held"))
    known = counts.groupBy("asset").agg(F.collect_list(F.struct("k", "whole", "held")).alias("months"))  # a row per month in an array
    rows = active.join(F.broadcast(required), "rid").join(known, "asset", "left")
    inside = F.aggregate("months", F.lit(0).cast("long"), lambda n, x: n + F.when((x["k"] >= F.col("k0")) & (x["k"] < F.col("rid")), x["whole"]).when(x["k"] == F.col("rid"), x["held"]).otherwise(0))
    available = F.coalesce(inside, F.lit(0))
    eligible = F.col("months").isNotNull() & (available == F.col("required"))
    reason = F.when(F.col("months").isNull(), NO_PRICES).when(eligible, COMPLETE).otherwise(INCOMPLETE)
    return rows.select("rid", F.col("eff").alias("EffectiveDate"), F.col("m0").alias("EstimationStartMonth"), F.col("m1").alias("EstimationEndMonth"), F.col("hold_end").alias("HoldingEndDate"), F.col("asset").alias("Price_Ticker"), eligible.alias("Eligible"), reason.alias("EligibilityReason"), F.col("required").alias("RequiredPriceObservations"), available.alias("AvailablePriceObservations"))


def eligibility_summary(audit: DataFrame) -> DataFrame:
    return audit.groupBy("EffectiveDate").agg(F.count("*").alias("ActiveMembers"), F.count_if("Eligible").alias("EligibleAssets"))


def latest_excluded(audit: DataFrame) -> DataFrame:
    last = audit.agg(F.max("EffectiveDate").alias("last"))
    return audit.join(F.broadcast(last), F.col("EffectiveDate") == F.col("last")).filter(~F.col("Eligible")).select("EffectiveDate", "Price_Ticker", "EligibilityReason")

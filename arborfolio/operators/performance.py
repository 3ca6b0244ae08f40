"""Metrics, drawdowns, comparisons, the benchmark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborfolio.config import EPSILON, YEAR_DAYS, YEAR_MONTHS, CalculationError, DataValidationError
from arborfolio.functions.columns import month_of, ratio
from arborfolio.operators.checks import prepare_benchmark, prepare_comparison_dates
from arborfolio.operators.scan import as_of, running

BENCHMARK = "SP100Benchmark"


def drawdowns(path: DataFrame, keys: tuple[str, ...], order: str, value: str = "NetReturn", base: bool = False, part: Column | None = None) -> DataFrame:
    """Adds value, drawdown: V over its running maximum less 1. base: the start value 1 counts as a maximum too. part: of the
    order, so that a series is a task for each part and not one."""
    if part is not None:
        rows = running(path, order, part, keys, value=("product", 1 + F.col(value)))
        rows = running(rows, order, part, keys, _peak=("max", F.col("value")))
        peak = F.greatest("_peak", F.lit(1.0)) if base else F.col("_peak")
        return rows.withColumn("drawdown", F.col("value") / peak - 1).drop("_peak")
    w = Window.partitionBy(*keys).orderBy(order)
    rows = path.withColumn("value", F.product(1 + F.col(value)).over(w))
    peak = F.max("value").over(w)
    return rows.withColumn("drawdown", F.col("value") / (F.greatest(peak, F.lit(1.0)) if base else peak) - 1)


def _sharpe(ret: Column, vol: Column) -> Column:
    return F.when(vol > EPSILON, ret / vol).otherwise(0.0)


def monthly_metrics(months: DataFrame, diagnostics: DataFrame | None = None, key: str = "variant", check: bool = False) -> DataFrame:
    """A row per key: annualized return, volatility, Sharpe ratio, drawdown (no base), and means of the diagnostics.
    check: each key has two months or more, as a deviation needs them."""
    if check and (few := months.groupBy(key).count().filter("count < 2").limit(1).collect() or not months.limit(1).count()):
        raise CalculationError("metrics need two months or more", found=str(few))
    rows = drawdowns(months, (key,), "Month")
    agg = rows.groupBy(key).agg(F.count("*").alias("OutOfSampleMonths"), F.product(1 + F.col("NetReturn")).alias("total"), (F.stddev_samp("NetReturn") * float(YEAR_MONTHS) ** 0.5).alias("AnnualizedVolatility"), F.min("drawdown").alias("MaximumDrawdown"))
    ret = F.pow(F.col("total"), YEAR_MONTHS / F.col("OutOfSampleMonths")) - 1
    agg = agg.withColumn("AnnualizedReturn", ret).withColumn("SharpeRatio", _sharpe(F.col("AnnualizedReturn"), F.col("AnnualizedVolatility")))
    if diagnostics is not None:
        means = diagnostics.groupBy(key).agg(F.avg("MaximumWeight").alias("AverageMaximumWeight"), F.max("MaximumWeight").alias("WorstMaximumWeight"), F.avg("EffectiveHoldings").alias("AverageEffectiveHoldings"), F.avg("Turnover").alias("AverageTurnover"))
        agg = agg.join(means, key)
    else:
        none = F.lit(None).cast("double")
        agg = agg.withColumns({"AverageMaximumWeight": none, "WorstMaximumWeight": none, "AverageEffectiveHoldings": none, "AverageTurnover": F.lit(0.0)})
    return agg.select(key, "OutOfSampleMonths", "AnnualizedReturn", "AnnualizedVolatility", "SharpeRatio", "MaximumDrawdown", "AverageMaximumWeight", "WorstMaximumWeight", "AverageEffectiveHoldings", "AverageTurnover")


def benchmark_daily(prices: DataFrame, comparison_dates: DataFrame, check: bool = True, align: bool = False) -> DataFrame:
    """Returns on the benchmark's own calendar, then the strategy's dates: Date, GrossReturn, TransactionCost, NetReturn,
    GrossValue, NetValue. align: for a benchmark with other holidays, prices are those of its last date at or before each
    of the strategy's dates and the last one before the first of these, and returns go from date to date."""
    if align:
        first = comparison_dates.agg(F.min("date").alias("first"))
        opened = prices.join(F.broadcast(first), F.col("date") < F.col("first")).agg(F.max("date").alias("date")).filter("date is not null")  # one row
        prices = as_of(comparison_dates.select("date").union(opened).distinct(), prices, "price", month_of(F.col("date")))
    if check:
        prepare_benchmark(prices)
        prepare_comparison_dates(comparison_dates)
    month = month_of(F.col("date"))
    returns = running(prices.select("date", "price"), "date", month, p0=("before", F.col("price"))).select("date", (ratio(F.col("price"), F.col("p0")) - 1).alias("r"))
    rows = comparison_dates.select("date").join(returns, "date", "left")
    if check:
        missing = [str(r.date) for r in rows.filter("r is null").orderBy("date").limit(10).collect()]
        if missing:
            raise DataValidationError("the benchmark lacks dates", dates=missing)
        if rows.filter("r <= -1 or isnan(r)").limit(1).count():
            raise CalculationError("a benchmark return is -100% or less")
    rows = running(rows, "date", month, value=("product", 1 + F.col("r")))
    return rows.select(F.col("date").alias("Date"), F.col("r").alias("GrossReturn"), F.lit(0.0).alias("TransactionCost"), F.col("r").alias("NetReturn"), F.col("value").alias("GrossValue"), F.col("value").alias("NetValue"))


def benchmark_monthly(daily: DataFrame) -> DataFrame:
    months = daily.groupBy(F.trunc("Date", "MM").alias("Month")).agg(F.min("Date").alias("EffectiveDate"), (F.product(1 + F.col("GrossReturn")) - 1).alias("GrossReturn"))
    months = running(months, "Month", F.trunc("Month", "year"), NetValue=("product", 1 + F.col("GrossReturn")))
    return months.select("Month", "EffectiveDate", "GrossReturn", F.lit(0.0).alias("TransactionCost"), F.col("GrossReturn").alias("NetReturn"), "NetValue")


def compare(paths: dict[str, DataFrame], key: str) -> DataFrame:
    """Inner join of paths on Date or Month: {name}_Return, {name}_NetValue; the benchmark's columns have no underscore."""
    out = None
    for name, path in paths.items():
        sep = "" if name == BENCHMARK else "_"
        part = path.select(key, F.col("NetReturn").alias(f"{name}{sep}Return"), F.col("NetValue").alias(f"{name}{sep}NetValue"))
        out = part if out is None else out.join(part, key)
    return out


def performance_table(series: DataFrame, base: bool = False, key: str = "series") -> DataFrame:
    """series: key, Date, NetReturn. Daily figures annualized over 252 days; zero where a ratio has no base."""
    rows = drawdowns(series, (key,), "Date", base=base)
    year = float(YEAR_DAYS) ** 0.5
    agg = rows.groupBy(key).agg(F.count("*").alias("days"), F.product(1 + F.col("NetReturn")).alias("growth"), (F.coalesce(F.stddev_samp("NetReturn"), F.lit(0.0)) * year).alias("Volatility"), (F.coalesce(F.stddev_samp(F.when(F.col("NetReturn") < 0, F.col("NetReturn"))), F.lit(0.0)) * year).alias("Downside"), F.min("drawdown").alias("MaximumDrawdown"))
    ret = F.pow(F.col("growth"), YEAR_DAYS / F.col("days")) - 1
    agg = agg.withColumn("AnnualizedReturn", ret)
    r = F.col("AnnualizedReturn")
    return agg.select(key, (F.col("growth") - 1).alias("TotalReturn"), "AnnualizedReturn", "Volatility", _sharpe(r, F.col("Volatility")).alias("Sharpe"), _sharpe(r, F.col("Downside")).alias("Sortino"), F.when(F.abs("MaximumDrawdown") > EPSILON, r / F.abs("MaximumDrawdown")).otherwise(0.0).alias("Calmar"), "MaximumDrawdown")


def histogram(returns: DataFrame, value: str = "NetReturn", bins: int = 36) -> DataFrame:
    """Rows bin, low, high, n over percent returns; the axis is symmetric in whole nice steps, outer values are clamped."""
    x = F.col(value) * 100
    most = returns.agg(F.max(F.abs(x)).alias("most"))
    raw = F.col("most") * 2 / 6
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    step = F.when(raw / power < 1.5, 1).when(raw / power < 3, 2).when(raw / power < 7, 5).otherwise(10) * power
    axis = most.select(F.when(F.col("most") > 0, F.ceil(F.col("most") / step) * step).otherwise(1.0).alias("limit"))
    width = F.col("limit") * 2 / bins
    rows = returns.join(F.broadcast(axis))  # one row
    bin_ = F.least(F.greatest(F.floor((x + F.col("limit")) / width), F.lit(0)), F.lit(bins - 1))
    return rows.groupBy(bin_.cast("int").alias("bin"), "limit").agg(F.count("*").alias("n")).select("bin", (F.col("bin") * width - F.col("limit")).alias("low"), ((F.col("bin") + 1) * width - F.col("limit")).alias("high"), "n")


def diagnostics_of(daily: DataFrame, diagnostics: DataFrame, key: str = "variant") -> DataFrame:
    """Mean largest weight, best and worst day, mean effective holdings."""
    days = daily.groupBy(key).agg(F.max("NetReturn").alias("BestDay"), F.min("NetReturn").alias("WorstDay"))
    means = diagnostics.groupBy(key).agg(F.avg("MaximumWeight").alias("AverageMaximumPosition"), F.avg("EffectiveHoldings").alias("EffectiveHoldings"))
    return days.join(means, key)


def universe_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that only one of two universes has; none if they are paired."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))

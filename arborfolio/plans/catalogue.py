"""The queries by name. Panels stand in for market data: see sources/panels.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arborfolio.config import BacktestConfig
from arborfolio.functions.columns import lenient_date, lossy_double, rounded
from arborfolio.operators import availability, blocks, checks, holding, market, network, performance, scan, trees, universe
from arborfolio.plans import backtest
from arborfolio.sources import panels
from arborfolio.sources.lineage import dropped, shared_folder, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Settings of the queries: months of estimation, window, threshold, cost.
CONFIG = BacktestConfig(estimation_months=24, window=63, threshold=3.0, transaction_cost_bps=10.0)
DAMPEN = {"window": 63, "threshold": 3.0}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.weekly_panel(spark, sf_dir, "p_brand")


def fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six assets, only the weeks in which all have prices: the fixed universe."""
    return backtest.complete_dates(panels.weekly_panel(spark, sf_dir, "p_type"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.staggered_membership(kept_panel(spark, sf_dir)[0])


def audit(spark: SparkSession, sf_dir: str, months: int = CONFIG.estimation_months) -> DataFrame:
    panel, moments = kept_panel(spark, sf_dir)
    if months != CONFIG.estimation_months:
        moments = backtest.local(universe.rebalances(market.month_calendar(panel), months))
    dates = backtest.local(panel.select("date").distinct())
    return universe.eligibility(panel, dates, panels.staggered_membership(panel), moments)


#: What the queries made and wrote, by what it was made from.
_held: dict[tuple, backtest.Backtest] = {}
_panels: dict[tuple, tuple[DataFrame, DataFrame, str]] = {}


def release() -> None:
    """Delete what the queries have written."""
    for done in _held.values():
        done.release()
    for panel, _, path in _panels.values():
        dropped(panel.sparkSession, path)
    _held.clear()
    _panels.clear()


def kept_panel(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The brand panel as a table that is written once, and its rebalances; the queries of a session share it until release()."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _panels:
        panel, path = written(px(spark, sf_dir), "panel")
        _panels[key] = (panel, backtest.local(universe.rebalances(market.month_calendar(panel), CONFIG.estimation_months)), path)
    return _panels[key][:2]


def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_panel(spark, sf_dir)[1]


def _once(key: tuple, make: Callable[[], backtest.Backtest]) -> backtest.Backtest:
    """A study that is made once; there are as many as the queries have settings."""
    if key not in _held:
        _held[key] = make()
    return _held[key]


def study(spark: SparkSession, sf_dir: str) -> backtest.Backtest:
    """Both variants on the brand panel; the queries of a session share its parts until release()."""

    def make() -> backtest.Backtest:
        panel = kept_panel(spark, sf_dir)[0]
        return backtest.run_point_in_time(panel, panels.staggered_membership(panel), CONFIG, backtest.BOTH, check=False)

    return _once((spark.sparkContext.applicationId, sf_dir), make)


def fixed(spark: SparkSession, sf_dir: str, weights: str = "inverse_proportional", adjacency: str = "correlation_distance") -> backtest.Backtest:
    config = BacktestConfig(estimation_months=24, weight_normalization=weights, adjacency_weighting=adjacency)
    return _once((spark.sparkContext.applicationId, sf_dir, weights, adjacency), lambda: backtest.run_fixed_universe(fx(spark, sf_dir), config, check=False))


def comparison_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = kept_panel(spark, sf_dir)[0]
    first = moments(spark, sf_dir).agg(F.min("eff").alias("eff"))
    return panel.select("date").distinct().join(F.broadcast(first)).filter("date >= eff").select("date")  # one row


def benchmark(spark: SparkSession, sf_dir: str) -> backtest.BenchmarkResult:
    return backtest.run_benchmark(panels.weekly_benchmark(spark, sf_dir), comparison_weeks(spark, sf_dir), check=False)


def tidy(df: DataFrame, digits: int = 8) -> DataFrame:
    """Doubles rounded, as sums are made in another order elsewhere."""
    return df.select(*(rounded(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point-in-time backtest of the flag panel: three months of estimation, window 8, daily returns of both variants."""
    panel = panels.flag_panel(spark, sf_dir)
    config = BacktestConfig(estimation_months=3, window=8)
    return backtest.run_point_in_time(panel, panels.always_members(panel), config, backtest.BOTH, check=False).daily_returns


# Relational verbs on panels.


@query
def panel_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px(spark, sf_dir)


@query
def panel_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = px(spark, sf_dir)
    extra = F.col("asset") >= "Brand#6"
    return market.combine_panels(panel.filter(~extra), panel.filter(extra))


@query
def panel_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.wide_panel(panels.weekly_panel(spark, sf_dir, "p_type"))


@query
def panel_long_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = panels.wide_panel(panels.weekly_panel(spark, sf_dir, "p_type"))
    return panels.long_panel(wide, 2).filter("price is not null")


@query
def lossy_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    text = F.when(F.col("event_id") % 7 == 0, "bad").when(F.col("event_id") % 11 == 0, "NaN").otherwise(F.col("value").cast("string"))
    stamp = F.when(F.col("event_id") % 5 == 0, "n/a").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return events.select("event_id", lenient_date(stamp).alias("day"), rounded(lossy_double(text)).alias("value"))


@query
def panel_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.quality(px(spark, sf_dir)).select(*(F.col(c).cast("long") for c in ("dates", "assets", "rows", "null_dates", "null_values", "duplicates", "not_finite", "not_positive")))


@query
def null_dup_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each brand: weeks with a price, weeks of the calendar without one."""
    panel = px(spark, sf_dir)
    weeks = panel.agg(F.count_distinct("date").alias("weeks"))
    return panel.groupBy("asset").agg(F.count("price").alias("present"), F.min("date").alias("first"), F.max("date").alias("last")).join(F.broadcast(weeks)).select("asset", "present", (F.col("weeks") - F.col("present")).alias("missing"), "first", "last")


# Returns.


@query
def log_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(market.log_returns(px(spark, sf_dir), check=False))


@query
def simple_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(market.simple_returns(px(spark, sf_dir)))


@query
def rolling_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(market.trailing_median(market.log_returns(fx(spark, sf_dir), check=False), DAMPEN).select("date", "asset", "med"))


@query
def rolling_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(market.trailing_median(market.log_returns(fx(spark, sf_dir), check=False), DAMPEN).select("date", "asset", "mad"))


@query
def dampened_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(market.dampen(market.log_returns(fx(spark, sf_dir), check=False), DAMPEN, check=False))


@query
def dampened_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands by day, window 126; a brand's returns are those from one of its days to the next."""
    return tidy(market.dampen(market.log_returns(panels.daily_panel(spark, sf_dir), check=False), {"window": 126, "threshold": 3.0}, check=False))


@query
def dampened_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dampened_daily by time ranges: no brand's series is one task."""
    return tidy(market.dampen(market.log_returns(panels.daily_panel(spark, sf_dir), check=False), {"window": 126, "threshold": 3.0}, check=False, block_rows=160))


@query
def trailing_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing medians and median deviations of brands by day, window 63, by time ranges shorter than the window."""
    return tidy(market.trailing_median(market.log_returns(panels.daily_panel(spark, sf_dir), check=False), DAMPEN, block_rows=40))


@query
def daily_cov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly covariances of brands by day."""
    return tidy(market.monthly_realized_cov(market.log_returns(panels.daily_panel(spark, sf_dir), check=False), check=False))


@query
def daily_cov_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """daily_cov by products of blocks of assets."""
    return tidy(blocks.blocked_cov(market.log_returns(panels.daily_panel(spark, sf_dir), check=False), 4))


@query
def validation_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the validations say of the brand panel and of panels that break a rule each: a row per case."""
    panel = kept_panel(spark, sf_dir)[0]
    whole = backtest.complete_dates(panel.join(F.broadcast(scan.numbered(panel, "asset").filter("k <= 2")), "asset"))
    rows = whole.join(F.broadcast(scan.numbered(whole, "date", "day")), "date")  # a row per date
    first, price = F.col("k") == 1, F.col("price")
    case = lambda name, changed=price, times=F.lit(1): F.struct(F.lit(name).alias("case"), changed.alias("price"), times.alias("times"))
    instead = lambda value: F.when(first, value).otherwise(price)
    cases = F.array(
        case("whole"),
        case("twice", times=F.when(first & (F.col("day") == 1), 2).otherwise(1)),
        case("negative", instead(-price)),
        case("zero", instead(F.lit(0.0))),
        case("holes", times=F.when(first & (F.col("date") >= "1996-01-01"), 0).otherwise(1)),
        case("infinite", instead(F.lit(float("inf")))),
        case("short", times=F.when(F.col("day") <= 2, 1).otherwise(0)),
    )
    made = rows.select("date", "asset", F.explode(cases).alias("x")).select("date", "asset", "x.*").filter("times > 0")
    made = made.select("case", "date", "asset", "price", F.explode(F.sequence(F.lit(1), "times")))
    return checks.quality(made, by=("case",)).select("case", checks.close_prices_are_valid().alias("valid"))


@query
def month_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.month_calendar(px(spark, sf_dir)).select("Month", "EffectiveDate", "HoldingEndDate")


# Universe.


@query
def membership_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A membership file of the brands, in which five of seven records break a rule: the bad records with their lines."""
    rows = members(spark, sf_dir).withColumn("k", F.row_number().over(Window.orderBy("asset")) - 1)  # a row per asset
    start, end = F.col("start").cast("string"), F.coalesce(F.col("end_excl").cast("string"), F.lit(""))
    fields = [F.when(F.col("k") % 7 == 1, "soon").when(F.col("k") % 7 == 5, "").otherwise(start), F.when(F.col("k") % 7 == 2, "1990-01-01").otherwise(end), F.when(F.col("k") % 7 == 3, "").otherwise(F.col("asset"))]
    text = F.concat(F.concat_ws(",", *fields), F.when(F.col("k") % 7 == 4, ",more").otherwise(""))
    head = spark.createDataFrame([(-1, ",".join(panels.MEMBERSHIP))], "k int, value string")
    folder = shared_folder(spark, "membership")
    head.unionByName(rows.select("k", text.alias("value"))).coalesce(1).sortWithinPartitions("k").select("value").write.text(folder)
    return panels.membership_problems(spark, folder)


@query
def active_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return universe.active_members(members(spark, sf_dir), moments(spark, sf_dir)).select(F.col("eff").alias("EffectiveDate"), "asset")


@query
def eligibility_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark, sf_dir).drop("rid")


@query
def eligibility_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return universe.eligibility_summary(audit(spark, sf_dir))


@query
def excluded_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return universe.latest_excluded(audit(spark, sf_dir))


# Covariances, graph and weights of the fixed universe.


@query
def monthly_cov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(market.monthly_realized_cov(market.log_returns(fx(spark, sf_dir), check=False), check=False))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.window_cov(market.monthly_realized_cov(market.log_returns(fx(spark, sf_dir), check=False), check=False), CONFIG.estimation_months)


@query
def window_cov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(windows(spark, sf_dir))


@query
def correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(market.correlation(windows(spark, sf_dir), check=False).drop("distance"))


@query
def distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(market.correlation(windows(spark, sf_dir), check=False).drop("rho"))


@query
def mst_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(study(spark, sf_dir).network_edges)


@query
def mst_edges_unweighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(fixed(spark, sf_dir, adjacency="unweighted").network_edges.drop("variant"))


def rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed universe's trees, by rounds over edge rows."""
    return trees.spanning_edges(market.correlation(windows(spark, sf_dir), check=False).drop("rho"))


@query
def mst_edges_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(rounds(spark, sf_dir))


@query
def tree_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights, centrality and radius of the fixed universe's trees, by messages over edge rows."""
    return tidy(trees.tree_weights(rounds(spark, sf_dir)))


@query
def common_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By bitmaps: the dates that the eligible assets of a rebalance have in common, in its window and 63 before it."""
    panel, when = kept_panel(spark, sf_dir)
    chosen = audit(spark, sf_dir).filter("Eligible").select("rid", F.col("Price_Ticker").alias("asset"))
    rows = availability.needed_dates(panel, panel, chosen, when, CONFIG.window)
    return rows.join(F.broadcast(when.select("rid", "eff")), "rid").select(F.col("eff").alias("EffectiveDate"), "date", "common")  # a row per month


@query
def mst_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = study(spark, sf_dir).network_edges
    ends = edges.select("variant", "EffectiveDate", F.explode(F.array("AssetLeft", "AssetRight")).alias("asset"))
    degree = ends.groupBy("variant", "EffectiveDate", "asset").agg(F.count("*").alias("degree"))
    return degree.groupBy("variant", "EffectiveDate").agg(F.max("degree").alias("max_degree"))


@query
def centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(study(spark, sf_dir).allocation_diagnostics.select("variant", "EffectiveDate", "Asset", "Centrality", "Degree"))


@query
def weights_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(study(spark, sf_dir).rebalance_weights)


@query
def weights_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(fixed(spark, sf_dir, weights="paper_softmax").rebalance_weights.drop("variant"))


# Holding, metrics, comparisons of the point-in-time study.


@query
def turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(study(spark, sf_dir).rebalance_diagnostics.select("variant", "EffectiveDate", "Turnover"))


@query
def holding_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(study(spark, sf_dir).daily_returns)


@query
def end_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(study(spark, sf_dir).end_weights)


@query
def monthly_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(study(spark, sf_dir).monthly_returns)


@query
def rebalance_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(study(spark, sf_dir).rebalance_diagnostics.drop("CentralityNormalization", "WeightNormalization", "AdjacencyWeighting", "AMADWindow", "AMADThreshold"))


def metrics(spark: SparkSession, sf_dir: str, variant: str) -> DataFrame:
    return tidy(study(spark, sf_dir).metrics.filter(F.col("variant") == variant))


@query
def metrics_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(spark, sf_dir, "NRP-raw")


@query
def metrics_dampened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(spark, sf_dir, "NRP-AMAD")


@query
def fixed_monthly_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(fixed(spark, sf_dir).monthly_returns.drop("variant", "EligibleAssets"))


@query
def benchmark_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(benchmark(spark, sf_dir).daily)


@query
def benchmark_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A benchmark that lacks the first week of every month and every thirteenth day of the year's count, on the panel's weeks."""
    bench = panels.weekly_benchmark(spark, sf_dir).filter("day(date) > 7 and dayofyear(date) % 13 <> 0")
    return tidy(performance.benchmark_daily(bench, comparison_weeks(spark, sf_dir), check=False, align=True))


@query
def benchmark_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(benchmark(spark, sf_dir).monthly)


@query
def benchmark_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(benchmark(spark, sf_dir).metrics)


def paths(spark: SparkSession, sf_dir: str, daily: bool) -> dict[str, DataFrame]:
    done, other = study(spark, sf_dir), benchmark(spark, sf_dir)
    mine = done.daily_returns if daily else done.monthly_returns
    return {"AMAD_NRP": mine.filter("variant = 'NRP-AMAD'"), "Raw_NRP": mine.filter("variant = 'NRP-raw'"), performance.BENCHMARK: other.daily if daily else other.monthly}


@query
def compare_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(performance.compare(paths(spark, sf_dir, True), "Date"))


@query
def compare_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(performance.compare(paths(spark, sf_dir, False), "Month"))


@query
def compare_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(backtest.union_all([study(spark, sf_dir).metrics, benchmark(spark, sf_dir).metrics]))


@query
def latest_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(backtest.latest_allocation(study(spark, sf_dir).rebalance_weights).drop("Rank"))


@query
def top_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's twenty largest positions."""
    return tidy(backtest.latest_allocation(study(spark, sf_dir).rebalance_weights, 20))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [p.select(F.lit(name).alias("series"), "Date", "NetReturn") for name, p in paths(spark, sf_dir, True).items()]
    return backtest.union_all(parts)


@query
def drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(performance.drawdowns(series(spark, sf_dir), ("series",), "Date").select("series", "Date", "drawdown"))


@query
def drawdown_base1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(performance.drawdowns(series(spark, sf_dir), ("series",), "Date", base=True).select("series", "Date", "drawdown"))


@query
def drawdown_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """drawdown by running products and maxima over months."""
    rows = performance.drawdowns(series(spark, sf_dir), ("series",), "Date", part=F.trunc("Date", "MM"))
    return tidy(rows.select("series", "Date", "drawdown"))


@query
def performance_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(performance.performance_table(series(spark, sf_dir)))


@query
def performance_table_base1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(performance.performance_table(series(spark, sf_dir), base=True))


@query
def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = study(spark, sf_dir)
    return tidy(performance.diagnostics_of(done.daily_returns, done.rebalance_diagnostics))


@query
def return_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(performance.histogram(study(spark, sf_dir).daily_returns.filter("variant = 'NRP-AMAD'")), 6)


@query
def paired_universe_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of this study's universe against that with window 12: the rows that only one has."""
    other = audit(spark, sf_dir, 12)
    pick = lambda a: a.filter("Eligible").select("EffectiveDate", "Price_Ticker")
    return performance.universe_difference(pick(audit(spark, sf_dir)), pick(other))


__all__ = ["QUERIES", "Window", "flagship", "holding", "network"]

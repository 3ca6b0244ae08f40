"""Backtests: every rebalance is a key, so that all months and variants run in one plan."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborfolio.config import BacktestConfig, DataValidationError, make_config
from arborfolio.operators import checks, holding, market, network, performance, universe
from arborfolio.sources.lineage import dropped, written
from arborfolio.sources.panels import always_members


class Backtest:
    """Result tables, each made when it is first asked for; those of several variants have a variant column.

    What several tables share (the panel, the audit, the graphs, end weights, turnovers, daily returns) is written once below
    spark.checkpoint.dir: the plans behind it start from that table, however long the way to it was."""

    def __init__(self, panel: DataFrame, dates: DataFrame, chosen: DataFrame, moments: DataFrame, audit: DataFrame | None, config: BacktestConfig, variants: dict[str, bool], kept: list[str]):
        self._panel, self._dates, self._chosen, self._moments, self._audit = panel, dates, chosen, moments, audit
        self._config, self._variants, self._paths = config, variants, kept
        self._when = F.broadcast(moments.select("rid", F.col("eff").alias("EffectiveDate"), F.col("m0").alias("EstimationStartMonth"), F.col("m1").alias("EstimationEndMonth")))

    def release(self) -> None:
        """Delete what the tables share; they can't be read any more."""
        dropped(self._panel.sparkSession, *self._paths)
        self._paths.clear()

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        df, path = written(df, name)
        self._paths.append(path)
        return df

    @cached_property
    def _graph(self) -> DataFrame:
        return self._kept(network.allocate_rebalances(self._panel, self._dates, self._chosen, self._moments, self._config, self._variants), "graphs")

    @cached_property
    def _nodes(self) -> DataFrame:
        return self._graph.filter("kind = 'node'").select("rid", "variant", F.col("a").alias("asset"), F.col("x").alias("weight"), F.col("y").alias("centrality"), F.col("z").cast("long").alias("degree"))

    @cached_property
    def _values(self) -> DataFrame:
        return holding.held_values(self._panel, self._dates, self._moments, self._nodes.select("rid", "variant", "asset", "weight"))

    @cached_property
    def _ends(self) -> DataFrame:
        return self._kept(holding.end_weights(self._values), "end-weights")

    @cached_property
    def _moved(self) -> DataFrame:
        return self._kept(holding.turnover(self._nodes, self._ends), "turnovers")

    @cached_property
    def _daily(self) -> DataFrame:
        return self._kept(holding.daily_returns(self._values, self._moved, self._config.transaction_cost_bps), "daily-returns")

    @cached_property
    def _sizes(self) -> DataFrame:
        return self._nodes.groupBy("rid", "variant").agg(F.count("*").alias("EligibleAssets"), F.max("weight").alias("MaximumWeight"), F.min("weight").alias("MinimumWeight"), (1 / F.sum(F.col("weight") * F.col("weight"))).alias("EffectiveHoldings"))

    @property
    def daily_returns(self) -> DataFrame:
        return self._daily.drop("rid")

    @cached_property
    def monthly_returns(self) -> DataFrame:
        months = holding.monthly_returns(self._daily).join(F.broadcast(self._sizes.select("rid", "variant", "EligibleAssets")), ["rid", "variant"]).join(self._when, "rid")
        return months.select("variant", "Month", "EffectiveDate", "EstimationStartMonth", "EstimationEndMonth", "GrossReturn", "TransactionCost", "NetReturn", "NetValue", "EligibleAssets")

    @property
    def rebalance_weights(self) -> DataFrame:
        return self._nodes.join(self._when, "rid").select("variant", "EffectiveDate", "EstimationEndMonth", F.col("asset").alias("Asset"), F.col("weight").alias("Weight"))

    @property
    def allocation_diagnostics(self) -> DataFrame:
        return self._nodes.join(self._when, "rid").select("variant", "EffectiveDate", "EstimationEndMonth", F.col("asset").alias("Asset"), F.col("weight").alias("Weight"), F.col("centrality").alias("Centrality"), F.col("degree").alias("Degree"))

    @property
    def network_edges(self) -> DataFrame:
        return self._graph.filter("kind = 'edge'").join(self._when, "rid").select("variant", "EffectiveDate", "EstimationEndMonth", F.col("a").alias("AssetLeft"), F.col("b").alias("AssetRight"), F.col("x").alias("Distance"), F.col("y").alias("Correlation"), F.col("z").alias("AdjacencyWeight"))

    @cached_property
    def rebalance_diagnostics(self) -> DataFrame:
        config = self._config
        radius = self._graph.filter("kind = 'graph'").select("rid", "variant", F.col("x").alias("SpectralRadius"), F.col("y").cast("long").alias("MaximumMSTDegree"))
        facts = self._sizes.join(radius, ["rid", "variant"]).join(self._moved.withColumnRenamed("turnover", "Turnover"), ["rid", "variant"]).join(self._when, "rid")
        if self._audit is not None:
            counts = self._audit.groupBy("rid").agg(F.count("*").alias("ActiveMembers"), F.count_if(~F.col("Eligible")).alias("ExcludedAssets"))
            facts = facts.join(F.broadcast(counts), "rid")  # a row per month
        settings: dict[str, Column] = {"CentralityNormalization": F.lit(config.centrality_normalization), "WeightNormalization": F.lit(config.weight_normalization), "AdjacencyWeighting": F.lit(config.adjacency_weighting), "ReturnPreprocessing": F.substring_index("variant", "-", -1), "AMADWindow": F.lit(config.window), "AMADThreshold": F.lit(config.threshold)}
        facts = facts.withColumns(settings)
        members = ["ActiveMembers", "EligibleAssets", "ExcludedAssets"] if self._audit is not None else []
        return facts.select("variant", "EffectiveDate", "EstimationStartMonth", "EstimationEndMonth", *members, *settings, "MaximumWeight", "MinimumWeight", "EffectiveHoldings", "MaximumMSTDegree", "SpectralRadius", "Turnover")

    @property
    def membership_audit(self) -> DataFrame | None:
        return self._audit.drop("rid") if self._audit is not None else None

    @cached_property
    def metrics(self) -> DataFrame:
        return performance.monthly_metrics(self.monthly_returns, self.rebalance_diagnostics).withColumn("ReturnPreprocessing", F.substring_index("variant", "-", -1))

    @property
    def end_weights(self) -> DataFrame:
        return self._ends.join(self._when, "rid").select("variant", "EffectiveDate", F.col("asset").alias("Asset"), F.col("weight").alias("Weight"))

    def checked(self) -> Backtest:
        """Make the returns, and raise if a portfolio's value or its metrics don't exist."""
        holding.check_growth(self._daily)
        performance.monthly_metrics(self.monthly_returns, check=True)
        return self


@dataclass(frozen=True)
class BenchmarkResult:
    daily: DataFrame
    monthly: DataFrame
    metrics: DataFrame


def variants_of(config: BacktestConfig) -> dict[str, bool]:
    return {config.label: config.dampened}


BOTH = {"NRP-raw": False, "NRP-AMAD": True}


def local(rows: DataFrame) -> DataFrame:
    """A table with a row per month or date, held by the driver, so that the plans that read it stay small."""
    return rows.sparkSession.createDataFrame(rows.collect(), rows.schema)


def run_point_in_time(price_data: DataFrame, membership_intervals: DataFrame, config: BacktestConfig | dict | None = None, variants: dict[str, bool] | None = None, dates: DataFrame | None = None, check: bool = True) -> Backtest:
    """price_data: long panel. dates: the base panel's calendar where it has dates without any price."""
    config = make_config(config)
    if check:
        checks.prepare_prices(price_data)
        checks.prepare_membership(membership_intervals)
    price_data, path = written(price_data.select("date", "asset", "price"), "panel")
    dates = local((dates if dates is not None else price_data).select("date").distinct())
    moments = local(universe.rebalances(market.month_calendar(dates), config.estimation_months))
    audit, also = written(universe.eligibility(price_data, dates, membership_intervals, moments), "audit")  # a row per rebalance and member
    if check:
        few = moments.join(audit.filter("Eligible").groupBy("rid").count(), "rid", "left").agg(F.count("*").alias("months"), F.min(F.coalesce("count", F.lit(0))).alias("least")).first()
        if not few.months:
            raise DataValidationError("there are no months after the estimation window", needed=config.estimation_months)
        if few.least < 2:
            raise DataValidationError("fewer than two assets are eligible at a rebalance")
    chosen = audit.filter("Eligible").select("rid", F.col("Price_Ticker").alias("asset"))
    found = Backtest(price_data, dates, chosen, moments, audit, config, variants or variants_of(config), [path, also])
    return found.checked() if check else found


def run_fixed_universe(price_data: DataFrame, config: BacktestConfig | dict | None = None, variants: dict[str, bool] | None = None, check: bool = True) -> Backtest:
    """All assets, always; prices are complete. Months are those of the returns, so that the first date opens none."""
    config = make_config(config)
    if check:
        checks.validate_close_prices(price_data)
    price_data, path = written(price_data.select("date", "asset", "price"), "panel")
    dates = local(price_data.select("date").distinct())
    first = dates.agg(F.min("date").alias("first"))
    returns = dates.join(F.broadcast(first)).filter("date > first").select("date")  # one row
    moments = local(universe.rebalances(market.month_calendar(returns), config.estimation_months))
    if check and not moments.limit(1).count():
        raise DataValidationError("there are no months after the estimation window", needed=config.estimation_months)
    rids = [r.rid for r in moments.select("rid").collect()]  # a row per month
    chosen = price_data.select("asset").distinct().select(F.explode(F.array(*map(F.lit, rids)).cast("array<int>")).alias("rid"), "asset")
    found = Backtest(price_data, dates, chosen, moments, None, config, variants or variants_of(config), [path])
    return found.checked() if check else found


def run_benchmark(benchmark_price_data: DataFrame, comparison_dates: DataFrame, check: bool = True) -> BenchmarkResult:
    daily = performance.benchmark_daily(benchmark_price_data, comparison_dates, check)
    monthly = performance.benchmark_monthly(daily)
    metrics = performance.monthly_metrics(monthly.withColumn("variant", F.lit(performance.BENCHMARK)), check=check)
    return BenchmarkResult(daily, monthly, metrics.withColumn("ReturnPreprocessing", F.lit("none")))


def complete_dates(panel: DataFrame) -> DataFrame:
    """The rows of dates on which every asset has a price."""
    assets = panel.agg(F.count_distinct("asset").alias("assets"))
    whole = panel.filter("price is not null").groupBy("date").agg(F.count("*").alias("n")).join(F.broadcast(assets), F.col("n") == F.col("assets"))
    return panel.join(whole.select("date"), "date", "left_semi")


def latest_allocation(weights: DataFrame, k: int | None = None) -> DataFrame:
    """The last rebalance's weights, ranked; ties by name."""
    last = weights.groupBy("variant").agg(F.max("EffectiveDate").alias("EffectiveDate"))
    rows = weights.join(F.broadcast(last), ["variant", "EffectiveDate"])
    rows = rows.withColumn("Rank", F.row_number().over(Window.partitionBy("variant").orderBy(F.desc("Weight"), "Asset")))
    return rows.filter(F.col("Rank") <= k) if k else rows


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


__all__ = ["BOTH", "Backtest", "BenchmarkResult", "always_members", "complete_dates", "latest_allocation", "run_benchmark", "run_fixed_universe", "run_point_in_time", "union_all"]

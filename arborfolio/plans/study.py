"""The study: both variants and the benchmark from files to a run directory; its report, its requests, its command line."""

from __future__ import annotations

import argparse
import json
import re
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborfolio.config import BacktestConfig, DataValidationError, InputError, NotFoundError, get_logger
from arborfolio.functions.axes import clean_limits, date_ticks, escape_markup, percent, tick_values, two_places
from arborfolio.operators import performance, universe
from arborfolio.operators.market import combine_panels
from arborfolio.plans import backtest, charts
from arborfolio.sources import files as stored
from arborfolio.sources import panels, sinks

PREFIXES = {"AMAD_NRP": "NRP-AMAD", "Raw_NRP": "NRP-raw"}


def run_study(spark: SparkSession, base_path: str, supplemental_path: str, membership_path: str, benchmark_path: str, output_root: str, estimation_months: int = 24, window: int = 63, threshold: float = 3.0, transaction_cost_bps: float = 0.0) -> Path | str:
    began = time.time()
    config = BacktestConfig(estimation_months=estimation_months, window=window, threshold=threshold, transaction_cost_bps=transaction_cost_bps)
    files = {name: panels.require_file(path, f"{name} file") for name, path in (("base", base_path), ("supplemental", supplemental_path), ("membership", membership_path), ("benchmark", benchmark_path))}
    base = panels.read_panel(spark, str(files["base"]))
    supplemental = panels.read_panel(spark, str(files["supplemental"]), 1)
    members = panels.read_membership(spark, str(files["membership"]))
    bench = panels.long_panel(spark.read.parquet(str(files["benchmark"])), 1).filter(F.col("asset") == performance.BENCHMARK).select("date", "price")
    dates = base.select("date").distinct()
    prices, done = combine_panels(base, supplemental), None
    try:
        done = backtest.run_point_in_time(prices, members, config, backtest.BOTH, dates=dates)
        universes = [done.rebalance_weights.filter(F.col("variant") == v).select("EffectiveDate", "Asset") for v in backtest.BOTH]
        if performance.universe_difference(*universes).limit(1).count():
            raise DataValidationError("the variants' universes differ")
        own_dates = done.daily_returns.select(F.col("Date").alias("date")).distinct()
        other = backtest.run_benchmark(bench, own_dates)
        with sinks.new_run(output_root, estimation_months) as (run, place):
            stored.write_bytes(stored.join(run, stored.name_of(files["membership"])), stored.read_bytes(files["membership"]))
            for prefix, variant in PREFIXES.items():
                sinks.write_variant(done, run, prefix, variant)
            sinks.write_benchmark(other, run)
            daily = {p: done.daily_returns.filter(F.col("variant") == v) for p, v in PREFIXES.items()} | {performance.BENCHMARK: other.daily}
            monthly = {p: done.monthly_returns.filter(F.col("variant") == v) for p, v in PREFIXES.items()} | {performance.BENCHMARK: other.monthly}
            sinks.write_table(performance.compare(daily, "Date").orderBy("Date"), run, "comparison_daily")
            sinks.write_table(performance.compare(monthly, "Month").orderBy("Month"), run, "comparison_monthly")
            stored.write_bytes(stored.join(run, "net_value.svg"), net_value_chart(panels.read_table(spark, run, "comparison_daily")).svg().encode())
            stored.write_bytes(stored.join(run, "latest_allocation.svg"), allocation_chart(panels.read_table(spark, run, "AMAD_NRP_rebalance_weights")).svg().encode())
            metrics = backtest.union_all([done.metrics, other.metrics])
            sinks.write_table(metrics, run, "comparison_metrics")
            summary = universe.eligibility_summary(done.membership_audit)
            counts = summary.agg(F.min("ActiveMembers"), F.max("ActiveMembers"), F.min("EligibleAssets"), F.max("EligibleAssets")).first()
            sinks.write_metadata(run, {
                "configuration": config.__dict__,
                "inputs": files,
                "history_rule": f"the {estimation_months} calendar months before the holding month",
                "eligibility_rule": "active on the effective date, with a price on every date from the window's start to the holding month's end",
                "members": dict(zip(("least_active", "most_active", "least_eligible", "most_eligible"), counts, strict=True)),
                "latest_excluded": [r.Price_Ticker for r in universe.latest_excluded(done.membership_audit).collect()],
                "artifacts": stored.names_in(run),
                "elapsed_seconds": time.time() - began,
            })
        get_logger(__name__).info("study written to %s", place)
        return place
    finally:
        if done is not None:
            done.release()


def return_series(path: DataFrame) -> DataFrame:
    """Rows series, Date, NetReturn of a comparison table."""
    return backtest.union_all([path.select(F.lit(n).alias("series"), "Date", F.col(f"{n}{'' if n == performance.BENCHMARK else '_'}Return").alias("NetReturn")) for n in (*PREFIXES, performance.BENCHMARK)])


def performance_rows(spark: SparkSession, run: Path | str, base: bool = False) -> list[dict[str, Any]]:
    series = return_series(panels.read_table(spark, run, "comparison_daily"))
    return [r.asDict() for r in performance.performance_table(series, base).orderBy("series").collect()]


def chart_data(path: DataFrame, columns: list[str]) -> dict[str, Any]:
    """What a line chart needs: series, axis limits and ticks. path has a row per trading date."""
    rows = path.orderBy("Date").select("Date", *columns).collect()
    values = [x for r in rows for x in r[1:] if x is not None]
    low, high, step = clean_limits(min(values), max(values)) if values else (0.0, 1.0, 0.5)
    return {"dates": [str(r.Date) for r in rows], "series": {c: [r[c] for r in rows] for c in columns}, "limits": [low, high], "ticks": tick_values(low, high, step), "date_ticks": [str(d) for d in date_ticks(r.Date for r in rows)]}


def net_value_chart(path: DataFrame) -> charts.Drawing:
    """The series of a comparison table, which has a row per trading date."""
    names = [c for c in path.columns if c.endswith("NetValue")]
    rows = path.orderBy("Date").select("Date", *names).collect()
    return charts.line_chart("Net value", [r.Date for r in rows], {c.removesuffix("NetValue").rstrip("_"): [r[c] for r in rows] for c in names})


def drawdown_chart(path: DataFrame) -> charts.Drawing:
    """Both variants' drawdowns, no base."""
    values = path.select("Date", *(F.col(f"{p}_NetValue").alias(p) for p in PREFIXES))
    long = backtest.union_all([values.select(F.lit(p).alias("series"), "Date", F.col(p).alias("NetReturn"), F.col(p).alias("NetValue")) for p in PREFIXES])
    found = {(r.series, r.Date): r.drawdown for r in performance.drawdowns(long, ("series",), "Date").select("series", "Date", "drawdown").collect()}
    dates = sorted({d for _, d in found})
    return charts.line_chart("Drawdown", dates, {p: [found.get((p, d)) for d in dates] for p in PREFIXES}, percents=True)


def allocation_chart(weights: DataFrame, k: int = 25) -> charts.Drawing:
    """The last rebalance's k largest weights."""
    rows = backtest.latest_allocation(weights.withColumnRenamed("Strategy", "variant"), k).orderBy("Rank").collect()
    return charts.bar_chart(f"Latest allocation, {rows[0].EffectiveDate}" if rows else "Latest allocation", [(r.Asset, r.Weight) for r in rows])


def generate_report(spark: SparkSession, run_directory: str | Path, output_directory: str | Path) -> Path | str:
    """A report of a run as text (its path is returned) and as PDF with charts: performance table, twenty largest
    positions, net values and drawdowns. The charts are beside it as SVG, and their data as JSON."""
    run, out = panels.require_file(run_directory, "run directory"), stored.located(output_directory)
    name, meta = stored.name_of(run), panels.read_metadata(run)
    lines = [f"# Study {name}", "", f"Configuration: {json.dumps(meta['configuration'])}", "", "| series | total | annualized | volatility | Sharpe | Sortino | Calmar | drawdown |", "|-|-|-|-|-|-|-|-|"]
    cells = [[r["series"], percent(r["TotalReturn"]), percent(r["AnnualizedReturn"]), percent(r["Volatility"]), two_places(r["Sharpe"]), two_places(r["Sortino"]), two_places(r["Calmar"]), percent(r["MaximumDrawdown"])] for r in performance_rows(spark, run)]
    lines += [f"| {' | '.join(r)} |" for r in cells]
    weights = panels.read_table(spark, run, "AMAD_NRP_rebalance_weights")
    positions = [[str(r.Rank), r.Asset, percent(r.Weight)] for r in backtest.latest_allocation(weights.withColumnRenamed("Strategy", "variant"), 20).orderBy("Rank").collect()]
    lines += ["", "| rank | asset | weight |", "|-|-|-|", *(f"| {rank} | {escape_markup(asset)} | {weight} |" for rank, asset, weight in positions)]
    path = panels.read_table(spark, run, "comparison_daily")
    names = [c for c in path.columns if c.endswith("NetValue")]
    stored.write_bytes(stored.join(out, "charts.json"), json.dumps({"net_value": chart_data(path, names)}).encode())
    drawn = {"net_value": net_value_chart(path), "drawdown": drawdown_chart(path)}
    for kind, chart in drawn.items():
        stored.write_bytes(stored.join(out, f"{kind}.svg"), chart.svg().encode())
    head = ["series", "total", "annualized", "volatility", "Sharpe", "Sortino", "Calmar", "drawdown"]
    parts = [charts.table_drawing([head, *cells]), *drawn.values(), charts.table_drawing([["rank", "asset", "weight"], *positions], 400, 0.15)]
    stored.write_bytes(stored.join(out, f"{name}.pdf"), charts.pdf(charts.pages(f"Study {name}", parts)))
    target = stored.join(out, f"{name}.md")
    stored.write_bytes(target, ("\n".join(lines) + "\n").encode())
    return target


#: The service's defaults, choices and bounds.
DEFAULTS = {"estimation_months": 24, "AMAD_window": 126, "AMAD_threshold": 3.0, "transaction_cost_bps": 0.0}
RUN_ID = re.compile(r"run_\d{8}T\d{6}Z_months\d+")
MOST_BYTES = 16_384


def validate_request(body: dict[str, Any]) -> dict[str, Any]:
    given = DEFAULTS | {k: v for k, v in body.items() if k in DEFAULTS}
    months, window = int(given["estimation_months"]), int(given["AMAD_window"])
    threshold, bps = float(given["AMAD_threshold"]), float(given["transaction_cost_bps"])
    for ok, message in ((months in (12, 24), "Estimation must be 12 or 24 months"), (window in (64, 126), "The window must be 64 or 126 days"), (1 <= threshold <= 10, "The threshold must be between 1 and 10"), (0 <= bps <= 100, "Costs must be between 0 and 100 basis points")):
        if not ok:
            raise InputError(message)
    return {"estimation_months": months, "window": window, "threshold": threshold, "transaction_cost_bps": bps}


def load_payload(spark: SparkSession, run: Path | str) -> dict[str, Any]:
    table = lambda stem: [json.loads(x) for x in panels.read_table(spark, run, stem).toJSON().collect()]
    weights = panels.read_table(spark, run, "AMAD_NRP_rebalance_weights").withColumnRenamed("Strategy", "variant")
    allocation = [json.loads(x) for x in backtest.latest_allocation(weights).orderBy("Rank").toJSON().collect()]
    return {"run_id": stored.name_of(run), "metadata": panels.read_metadata(run), "metrics": table("comparison_metrics"), "path": sorted(table("comparison_daily"), key=lambda r: r["Date"]), "allocation": allocation}


class Service:
    """The HTTP routes as one function, so that they need no port. study(**settings) returns a run directory. Reports are
    sent as PDF, or as text if the request's format is "text"."""

    def __init__(self, spark: SparkSession, output_root: str | Path, study: Any) -> None:
        self.spark, self.root, self.study, self.busy = spark, stored.located(output_root), study, threading.Lock()

    def answer(self, method: str, path: str, body: bytes = b"") -> tuple[int, Any]:
        try:
            if method == "OPTIONS":
                return 204, {}
            if (method, path) == ("GET", "/api/health"):
                return 200, {"status": "ok"}
            if (method, path) not in (("POST", "/api/backtest"), ("POST", "/api/report")):
                return 404, {"error": "Not found"}
            if not 1 <= len(body) <= MOST_BYTES:
                raise InputError("The request body is empty or too large")
            request = json.loads(body)
            if not isinstance(request, dict):
                raise InputError("The request must be an object")
            if path == "/api/report":
                name = str(request.get("run_id", ""))
                if not RUN_ID.fullmatch(name):
                    raise InputError("Unknown run id")
                run = stored.join(self.root, name)
                if not stored.exists(run):
                    raise NotFoundError("The run isn't there", run=name)
                report = generate_report(self.spark, run, stored.join(run, "report"))
                if request.get("format") == "text":
                    return 200, stored.read_bytes(report).decode()
                return 200, stored.read_bytes(stored.join(stored.join(run, "report"), f"{name}.pdf"))
            settings = validate_request(request)
            if not self.busy.acquire(blocking=False):
                return 409, {"error": "A backtest is running"}
            try:
                return 200, load_payload(self.spark, self.study(**settings))
            finally:
                self.busy.release()
        except NotFoundError as missing:
            return 404, {"error": str(missing)}
        except ValueError as bad:
            return 400, {"error": str(bad)}
        except Exception as failed:  # noqa: BLE001  whatever fails, the service goes on
            return 500, {"error": str(failed)}


def serve(service: Service, port: int = 8000) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _do(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            status, body = service.answer(self.command, self.path, self.rfile.read(min(size, MOST_BYTES + 1)))
            kind = "application/pdf" if isinstance(body, bytes) else "text/markdown" if isinstance(body, str) else "application/json"
            raw = body if isinstance(body, bytes) else (body if isinstance(body, str) else json.dumps(body, default=str)).encode()
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        do_GET = do_POST = do_OPTIONS = _do

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)


def main(argv: list[str] | None = None) -> Path:
    parser = argparse.ArgumentParser(description=__doc__)
    for name in ("base", "supplemental", "membership", "benchmark", "output-root"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--estimation-months", type=int, default=24)
    parser.add_argument("--window", type=int, default=63)
    parser.add_argument("--threshold", type=float, default=3.0)
    parser.add_argument("--transaction-cost-bps", type=float, default=0.0)
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName("arborfolio study").getOrCreate()
    return run_study(spark, a.base, a.supplemental, a.membership, a.benchmark, a.output_root, a.estimation_months, a.window, a.threshold, a.transaction_cost_bps)


if __name__ == "__main__":
    print(main())

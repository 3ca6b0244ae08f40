import json
import math
from datetime import date, timedelta
from xml.etree import ElementTree

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from arborfolio import BacktestConfig, CalculationError, DataValidationError, InputError, NotFoundError, make_config, make_dampen_config
from arborfolio.functions.axes import clean_limits, date_ticks, escape_markup, nice_step, tick_values
from arborfolio.operators import checks, holding, market, network, performance, universe
from arborfolio.plans import backtest, charts, study
from arborfolio.sources import files, panels, sinks

START = date(2025, 1, 1)


def series(spark, values, value="r"):
    return spark.createDataFrame([(START + timedelta(days=i), "A", float(v)) for i, v in enumerate(values)], f"date date, asset string, {value} double")


def dampened(spark, values, window=5):
    return [r.r for r in market.dampen(series(spark, values), {"window": window, "threshold": 3.0}).orderBy("date").collect()]


def test_dampening_looks_only_back(spark):
    head = [0.001, -0.001, 0.002, -0.002, 0.0015, 0.08]
    a, b = dampened(spark, [*head, 0.0]), dampened(spark, [*head, 0.25])
    assert a[:6] == b[:6] and abs(a[5] - 0.017452486685861593) < 1e-12


def test_dampening_formula_and_edges(spark):
    got = dampened(spark, [-1, 0, 1, 2, 10])
    assert got[:4] == [-1, 0, 1, 2] and math.isclose(got[4], 1 + 3 + math.log(7))
    assert dampened(spark, [1, 1, 1, 1, 5]) == [1, 1, 1, 1, 5]  # no deviation
    assert dampened(spark, [-1, 0, 1, 2, 4])[4] == 4  # exactly at the threshold
    assert dampened(spark, [-1, 0, 10]) == [-1, 0, 10]  # shorter than the window


def test_kernel_equals_native(spark):
    rng = np.random.default_rng(1)
    values = rng.standard_t(2, 40)
    kernel = market.dampen_matrix(values[:, None], make_dampen_config({"window": 9}))[:, 0]
    native = [r.r for r in market.dampen_native(series(spark, values), {"window": 9}).orderBy("date").collect()]
    assert native == pytest.approx([r.r for r in market.dampen(series(spark, values), {"window": 9}).orderBy("date").collect()])
    assert np.allclose(kernel, native)


COV = np.array([[0.040, 0.012, 0.004], [0.012, 0.050, 0.010], [0.004, 0.010, 0.030]])


def test_allocation_fixture():
    a = network.allocate(["A", "B", "C"], [COV], {"estimation_months": 1})
    assert list(zip(a.edges.AssetLeft, a.edges.AssetRight, strict=True)) == [("A", "B"), ("B", "C")]
    assert np.allclose(a.weights, [0.3704577, 0.2612015, 0.3683408]) and math.isclose(a.spectral_radius, 1.3161668249546, rel_tol=1e-10)
    assert np.allclose(a.centrality, [0.49856529, 0.70710678, 0.50143061]) and a.max_degree == 2
    soft = network.allocate(["A", "B", "C"], [COV], {"estimation_months": 1, "weight_normalization": "paper_softmax"})
    assert np.allclose(soft.weights, [0.39337908, 0.21772481, 0.38889612])
    flat = network.allocate(["A", "B", "C"], [COV], {"estimation_months": 1, "adjacency_weighting": "unweighted"})
    assert math.isclose(flat.spectral_radius, math.sqrt(2)) and np.allclose(flat.weights, [0.36939806, 0.26120387, 0.36939806])


def test_allocation_edges():
    two = network.allocate(["A", "B"], [COV[:2, :2]], {"estimation_months": 1})
    assert np.allclose(two.weights, 0.5) and np.allclose(two.centrality, 1 / math.sqrt(2))
    same = np.ones((2, 2))
    with pytest.raises(CalculationError):
        network.allocate(["A", "B"], [same], {"estimation_months": 1})
    assert network.allocate(["A", "B"], [same], {"estimation_months": 1, "adjacency_weighting": "unweighted"}).edges.shape[0] == 1
    with pytest.raises(CalculationError):
        network.allocate(["A", "B"], [np.zeros((2, 2))], {"estimation_months": 1})
    with pytest.raises(DataValidationError):
        network.allocate(["A", "B"], [COV[:2, :2]], {"estimation_months": 2})


def test_tree_ties_and_random_trees():
    tied = 1 - np.eye(4)
    assert network.spanning_tree(tied, "correlation_distance") == [(0, 1), (0, 2), (0, 3)]
    rng = np.random.default_rng(2)
    for _ in range(20):
        n = int(rng.integers(2, 9))
        d = rng.random((n, n))
        d = (d + d.T) / 2
        rank = {(i, j): k for k, (_, i, j) in enumerate(sorted((d[i, j], i, j) for i in range(n) for j in range(i + 1, n)))}
        m = np.array([[0 if i == j else rank[min(i, j), max(i, j)] for j in range(n)] for i in range(n)])
        for _ in range(4):
            m = np.min(np.maximum(m[:, :, None], m[None, :, :]), axis=1)
        assert sorted(network.spanning_tree(d, "correlation_distance")) == sorted(e for e, k in rank.items() if m[e] == k)


def test_benchmark_fixture(spark):
    days = [date(2025, 1, 1), date(2025, 1, 31), date(2025, 2, 28), date(2025, 3, 31), date(2025, 4, 30)]
    prices = spark.createDataFrame(list(zip(days, [100.0, 101.0, 102.0, 100.0, 104.0], strict=True)), "date date, price double")
    got = backtest.run_benchmark(prices, prices.filter("date > '2025-01-01'").select("date"))
    assert [round(r.NetValue, 10) for r in got.daily.orderBy("Date").collect()] == [1.01, 1.02, 1.0, 1.04]
    m = got.metrics.first()
    assert math.isclose(m.AnnualizedReturn, 0.124864) and math.isclose(m.SharpeRatio, 1.4811903271, rel_tol=1e-9) and math.isclose(m.MaximumDrawdown, -0.0196078431, rel_tol=1e-8)
    with pytest.raises(DataValidationError):
        backtest.run_benchmark(prices, spark.createDataFrame([(date(2025, 2, 1),), (date(2025, 2, 28),)], "date date"))


def test_drawdown_conventions(spark):
    path = series(spark, [-0.10, 0.05]).withColumnRenamed("r", "NetReturn")
    least = lambda base: performance.drawdowns(path, ("asset",), "date", base=base).agg(F.min("drawdown")).first()[0]
    assert least(False) == 0 and math.isclose(least(True), -0.10)


def panel_of(spark, prices, start=date(2024, 1, 1), step=3):
    rows = [(start + timedelta(days=step * i), a, float(p)) for a, ps in prices.items() for i, p in enumerate(ps) if p is not None]
    return spark.createDataFrame(rows, "date date, asset string, price double")


def test_eligibility_reasons_and_bounds(spark):
    n = 40
    panel = panel_of(spark, {"A": [10 + i % 3 for i in range(n)], "B": [5 + i % 4 if i != 20 else None for i in range(n)], "C": [7 + i % 5 for i in range(n)]})
    intervals = spark.createDataFrame([(date(2024, 1, 1), None, "A"), (date(2024, 1, 1), None, "B"), (date(2024, 3, 1), date(2024, 4, 1), "C"), (date(2024, 1, 1), None, "Z")], "start date, end_excl date, asset string")
    moments = universe.rebalances(market.month_calendar(panel), 1)
    audit = universe.eligibility(panel, panel, intervals, moments)
    got = {(str(r.EffectiveDate)[:7], r.Price_Ticker): r.EligibilityReason for r in audit.collect()}
    assert got["2024-03", "A"] == universe.COMPLETE and got["2024-03", "B"] == universe.INCOMPLETE and got["2024-03", "Z"] == universe.NO_PRICES
    assert ("2024-03", "C") in got and ("2024-04", "C") not in got
    twice = intervals.union(intervals.filter("asset = 'A'"))
    with pytest.raises(DataValidationError):
        universe.eligibility(panel, panel, twice, moments)


def loop_backtest(prices, months, bps, dampen, window):
    """The study by plain loops over a complete panel (dates x assets)."""
    dates = list(prices.index)
    keys = [d.strftime("%Y-%m") for d in dates]
    cal = sorted(set(keys))
    value, previous, out = 1.0, {}, []
    for k in range(months, len(cal)):
        first = keys.index(cal[k])
        past = prices.iloc[:first].to_numpy()
        r = np.log(past[1:] / past[:-1])
        if dampen:
            r = market.dampen_matrix(r, make_dampen_config({"window": window}))
        use = [r[i - 1] for i in range(1, first) if keys[i] in cal[k - months : k]]
        a = network.allocate_sum(list(prices.columns), np.array(use).T @ np.array(use), BacktestConfig(estimation_months=months))
        w = dict(zip(a.names, a.weights, strict=True))
        moved = 0.5 * sum(abs(w.get(x, 0) - previous.get(x, 0)) for x in w.keys() | previous.keys())
        held = np.array(a.weights)
        for i in [i for i, key in enumerate(keys) if key == cal[k]]:
            s = prices.iloc[i].to_numpy() / prices.iloc[i - 1].to_numpy() - 1
            g = float(held @ s)
            cost = moved * bps / 1e4 if i == first else 0.0
            net = (1 - cost) * (1 + g) - 1
            value *= 1 + net
            out.append((dates[i], g, cost, net, value))
            held = held * (1 + s) / (1 + g)
        previous = dict(zip(a.names, held, strict=True))
    return out


@pytest.fixture(scope="module")
def random_prices():
    rng = np.random.default_rng(7)
    days = [date(2024, 1, 1) + timedelta(days=3 * i) for i in range(70)]
    return pd.DataFrame(np.exp(np.cumsum(rng.standard_t(3, (70, 5)) * 0.02, axis=0)) * 50, index=days, columns=list("ABCDE"))


@pytest.mark.parametrize("variant", ["NRP-raw", "NRP-AMAD"])
def test_point_in_time_equals_loop(spark, random_prices, variant):
    panel = panel_of(spark, {c: list(random_prices[c]) for c in random_prices})
    config = {"estimation_months": 2, "transaction_cost_bps": 25.0, "window": 8}
    got = backtest.run_point_in_time(panel, panels.always_members(panel), config, {variant: variant == "NRP-AMAD"})
    rows = [tuple(r) for r in got.daily_returns.orderBy("Date").select("Date", "GrossReturn", "TransactionCost", "NetReturn", "NetValue").collect()]
    want = loop_backtest(random_prices, 2, 25.0, variant == "NRP-AMAD", 8)
    assert [r[0] for r in rows] == [w[0] for w in want] and np.allclose([r[1:] for r in rows], [w[1:] for w in want], atol=1e-10)
    first = got.rebalance_diagnostics.orderBy("EffectiveDate").first()
    assert math.isclose(first.Turnover, 0.5) and first.EligibleAssets == 5
    sums = got.rebalance_weights.groupBy("EffectiveDate").agg(F.sum("Weight").alias("w")).collect()
    assert all(math.isclose(r.w, 1) for r in sums)


def test_fixed_universe_agrees_after_the_first_month(spark, random_prices):
    panel = panel_of(spark, {c: list(random_prices[c]) for c in random_prices})
    a = backtest.run_fixed_universe(panel, {"estimation_months": 2}).daily_returns.orderBy("Date").collect()
    b = backtest.run_point_in_time(panel, panels.always_members(panel), {"estimation_months": 2}).daily_returns.orderBy("Date").collect()
    assert np.allclose([r.NetReturn for r in a], [r.NetReturn for r in b])


def test_rows_before_the_window_vanish_for_all(spark, random_prices):
    table = {c: list(random_prices[c]) for c in random_prices}
    table["E"][3] = None  # before the later windows
    panel = panel_of(spark, table)
    got = backtest.run_point_in_time(panel, panels.always_members(panel), {"estimation_months": 2, "window": 8}, {"NRP-AMAD": True})
    last = got.rebalance_weights.filter(F.col("EffectiveDate") == got.rebalance_weights.agg(F.max("EffectiveDate")).first()[0]).orderBy("Asset").collect()
    cut = random_prices.drop(index=random_prices.index[3])
    keys = [d.strftime("%Y-%m") for d in cut.index]
    first = keys.index(max(keys))
    past = cut.iloc[:first].to_numpy()
    r = market.dampen_matrix(np.log(past[1:] / past[:-1]), make_dampen_config({"window": 8}))
    months = sorted(set(keys))[-3:-1]
    use = np.array([r[i - 1] for i in range(1, first) if keys[i] in months])
    want = network.allocate_sum(list(cut.columns), use.T @ use, BacktestConfig(estimation_months=2))
    assert np.allclose([r.Weight for r in last], want.weights)


def test_turnover_over_both_universes(spark):
    now = spark.createDataFrame([(2, "v", "A", 0.5), (2, "v", "B", 0.5)], "rid int, variant string, asset string, weight double")
    ends = spark.createDataFrame([(1, "v", "B", 0.4), (1, "v", "C", 0.6)], "rid int, variant string, asset string, weight double")
    assert math.isclose(holding.turnover(now, ends).first().turnover, 0.6)


def test_validation_errors(spark):
    good = panel_of(spark, {"A": [1, 2, 3], "B": [2, 3, 4]})
    assert checks.validate_close_prices(good) is good
    for bad in (panel_of(spark, {"A": [1, 2], "B": [2, 3]}), panel_of(spark, {"A": [1, None, 3], "B": [2, 3, 4]}), good.union(good), panel_of(spark, {"A": [1, 2, 3], "B": [2, -3, 4]}), panel_of(spark, {"A": [1, 2, float("inf")], "B": [2, 3, 4]})):
        with pytest.raises(DataValidationError):
            checks.validate_close_prices(bad)
    with pytest.raises(DataValidationError):
        checks.validate_close_prices([1, 2])
    intervals = spark.createDataFrame([(date(2024, 1, 2), date(2024, 1, 2), "A")], "start date, end_excl date, asset string")
    with pytest.raises(DataValidationError):
        checks.prepare_membership(intervals)
    with pytest.raises(DataValidationError):
        market.combine_panels(good, good)


def test_functions_validate_their_input(spark):
    good = panel_of(spark, {"A": [1, 2, 3, 5], "B": [2, 3, 4, 3]})
    r = market.log_returns(good)
    assert r.count() == 6 and market.dampen(r, {"window": 2}).count() == 6 and market.monthly_realized_cov(r).count() == 3
    zero, hole = panel_of(spark, {"A": [1, 0, 3, 5], "B": [2, 3, 4, 3]}), panel_of(spark, {"A": [1, None, 3, 5], "B": [2, 3, 4, 3]})
    for bad in (zero, hole, good.union(good)):
        with pytest.raises(DataValidationError):
            market.log_returns(bad)
    assert market.log_returns(zero, check=False).filter("asset = 'B'").count() == 3 and market.simple_returns(zero).filter("asset = 'A'").count() == 2
    endless = r.withColumn("r", F.lit(float("inf")))
    short = r.filter(F.col("date") == r.agg(F.max("date")).first()[0])
    for bad in (endless, r.filter("r > 0"), r.union(r), short):
        with pytest.raises(DataValidationError):
            market.dampen(bad, {"window": 2})
    for bad in (endless, r.filter("r > 0"), r.union(r)):
        with pytest.raises(DataValidationError):
            market.monthly_realized_cov(bad)
    flat = market.monthly_realized_cov(market.log_returns(panel_of(spark, {"A": [1, 1, 1], "B": [2, 3, 4]})))
    with pytest.raises(CalculationError):
        market.correlation(flat)
    assert market.correlation(flat, check=False).first().rho is None


def test_loss_and_metric_guards(spark):
    days = spark.createDataFrame([(START, 0.1), (START + timedelta(days=1), -1.0)], "Date date, GrossReturn double")
    with pytest.raises(CalculationError, match="2025-01-02"):
        holding.check_growth(days)
    assert holding.check_growth(days.limit(1)).count() == 1
    with pytest.raises(CalculationError):
        holding.check_growth(days.withColumn("GrossReturn", F.lit(float("nan"))))
    months = spark.createDataFrame([("v", START, 0.1)], "variant string, Month date, NetReturn double")
    with pytest.raises(CalculationError, match="two months"):
        performance.monthly_metrics(months, check=True)
    assert performance.monthly_metrics(months).count() == 1
    short = panel_of(spark, {"A": [10 + i % 3 for i in range(22)], "B": [5 + i % 4 for i in range(22)]})  # one month after the window
    with pytest.raises(CalculationError, match="two months"):
        backtest.run_point_in_time(short, panels.always_members(short), {"estimation_months": 2})


def test_clean_and_exact_ways_agree(spark, random_prices):
    table = {c: list(random_prices[c]) for c in random_prices}
    table["E"] = [None] * 6 + table["E"][6:]  # listed later: the first rebalances' windows come after dates without it
    panel = panel_of(spark, table)
    config = make_config({"estimation_months": 2, "window": 8})
    dates = panel.select("date").distinct()
    moments = universe.rebalances(market.month_calendar(dates), 2)
    chosen = universe.eligibility(panel, dates, panels.always_members(panel), moments).filter("Eligible").select("rid", F.col("Price_Ticker").alias("asset"))
    clean = [r.rid for r in network.clean_before(panel, dates, chosen, moments, 8).collect()]
    rids = [r.rid for r in moments.collect()]
    assert clean and set(clean) < set(rids)
    history = panel.join(chosen, "asset").join(moments.select("rid", "eff"), "rid").filter("date < eff").select("rid", "date", "asset", "price")
    exact = network.allocate_groups(history, moments, config, backtest.BOTH)
    both = network.allocate_rebalances(panel, dates, chosen, moments, config, backtest.BOTH)
    key = lambda df: {(r.rid, r.variant, r.kind, r.a, r.b): (r.x, r.y) for r in df.collect()}
    a, b = key(exact), key(both)
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k], atol=1e-10) for k in a)


def test_tables_by_csv_and_remote_names(spark, tmp_path):
    df = spark.createDataFrame([(date(2024, 1, 2), 1.5)], "Date date, x double")
    sinks.write_table(df, tmp_path, "t")
    assert panels.read_table(spark, tmp_path, "t", "csv").collect() == df.collect() == panels.read_table(spark, str(tmp_path), "t").collect()
    uri = f"file://{tmp_path}"
    place = files.located(f"{uri}/sub")
    files.make_folder(place)
    files.write_bytes(files.join(place, "a.json"), b"{}")
    assert files.names_in(place) == ["a.json"] and files.read_bytes(f"{uri}/sub/a.json") == b"{}" and files.name_of(place) == "sub"
    assert panels.require_file(f"{uri}/sub", "folder") == f"{uri}/sub"
    for missing in (f"{uri}/none", tmp_path / "none"):
        with pytest.raises(NotFoundError):
            panels.require_file(missing, "folder")
    with pytest.raises(FileExistsError):
        files.make_folder(place)


def test_wide_and_long(spark):
    wide = spark.createDataFrame([("2024-01-02 10:00", "1.5", float("nan")), ("2024-01-03", "x", 2.0)], "Date string, A string, B double")
    got = {(str(r.date), r.asset): r.price for r in panels.long_panel(wide, 2).collect()}
    assert got == {("2024-01-02", "A"): 1.5, ("2024-01-02", "B"): None, ("2024-01-03", "A"): None, ("2024-01-03", "B"): 2.0}
    assert panels.wide_panel(panels.long_panel(wide, 2)).columns == ["Date", "A", "B"]
    with pytest.raises(DataValidationError):
        panels.long_panel(wide.select("Date"), 1)


def test_settings():
    assert make_config({"estimation_months": "12"}).estimation_months == 12 and make_config().window == 63
    for bad in ({"estimation_months": 0}, {"window": 1}, {"threshold": 0}, {"weight_normalization": "x"}, {"unknown": 1}, {"transaction_cost_bps": -1}):
        with pytest.raises(InputError):
            make_config(bad)


def test_axes():
    assert nice_step(10) == 2 and nice_step(0) == 1 and nice_step(35) == 10
    assert clean_limits(0.03, 9.7) == (0, 10, 2) and tick_values(0, 10, 5) == [0, 5, 10]
    assert date_ticks([date(2024, 5, 1), date(2024, 6, 1), date(2025, 1, 2), date(2025, 3, 1)]) == [date(2024, 5, 1), date(2025, 1, 2), date(2025, 3, 1)]
    assert escape_markup("a_b") == "a\\_b"


def pdf_objects(raw):
    """Follows a PDF's cross-reference table; every entry has to lead to its object."""
    start = int(raw.rsplit(b"startxref\n", 1)[1].split(b"\n")[0])
    table = raw[start:].split(b"\n")
    n = int(table[1].split()[1])
    assert table[0] == b"xref" and all(raw[int(table[2 + i][:10]) :].startswith(f"{i} 0 obj".encode()) for i in range(1, n))
    return n - 1


def lines_of(svg):
    """The names of an SVG's series: its lines that have one."""
    return [t for e in ElementTree.fromstring(svg).iter("{http://www.w3.org/2000/svg}polyline") if (t := e[0].text)]


def bars_of(svg):
    return [e[0].text for e in ElementTree.fromstring(svg).iter("{http://www.w3.org/2000/svg}rect") if len(e) and e[0].text]


def test_charts():
    days = [date(2024, 1, 1) + timedelta(days=30 * i) for i in range(20)]
    chart = charts.line_chart("a & b", days, {"x": [1.0 + i / 10 for i in range(20)], "y": [1.0, None, 2.0, *[1.5] * 17]})
    assert lines_of(chart.svg()) == ["x", "y", "y"]  # a null breaks the line
    assert lines_of(charts.line_chart("one value", days[:1], {"x": [1.0]}).svg()) == ["x"]
    assert "no data" in charts.line_chart("none", [], {"x": []}).svg() and bars_of(charts.bar_chart("none", []).svg()) == []
    assert bars_of(charts.bar_chart("w", [("A<", 0.75), ("B", 0.25)]).svg()) == ["A<: 75.00%", "B: 25.00%"]
    with pytest.raises(ValueError, match="series"):
        charts.line_chart("four", days, {c: [1.0] * 20 for c in "abcd"})
    many = charts.pages("t (1)", [chart] * 7)  # two to a page
    assert len(many) == 4 and pdf_objects(charts.pdf(many)) == 4 + 2 * 4


def test_requests():
    assert study.validate_request({}) == {"estimation_months": 24, "window": 126, "threshold": 3.0, "transaction_cost_bps": 0.0}
    assert study.validate_request({"estimation_months": 12, "AMAD_window": 64})["window"] == 64
    for bad, message in (({"estimation_months": 36}, "12 or 24 months"), ({"AMAD_window": 63}, "64 or 126 days"), ({"AMAD_threshold": 11}, "between 1 and 10"), ({"transaction_cost_bps": 101}, "0 and 100")):
        with pytest.raises(InputError, match=message):
            study.validate_request(bad)


def test_study_report_and_service(spark, random_prices, tmp_path):
    wide = random_prices.reset_index(names="Date")
    spark.createDataFrame(wide[["Date", "A", "B", "C"]]).write.parquet(str(tmp_path / "base"))
    spark.createDataFrame(wide[["Date", "D", "E"]]).write.parquet(str(tmp_path / "supp"))
    spark.createDataFrame(wide[["Date", "A"]].rename(columns={"A": "SP100Benchmark"})).write.parquet(str(tmp_path / "bench"))
    (tmp_path / "members.csv").write_text("Name,Membership_Start,Membership_End_Exclusive,Price_Ticker\n" + "".join(f"x,2020-01-01,,{c}\n" for c in "ABCDE"))

    def go(estimation_months, window, threshold, transaction_cost_bps):
        return study.run_study(spark, str(tmp_path / "base"), str(tmp_path / "supp"), str(tmp_path / "members.csv"), str(tmp_path / "bench"), str(tmp_path / "runs"), 2, 8, threshold, transaction_cost_bps)

    service = study.Service(spark, tmp_path / "runs", go)
    status, payload = service.answer("POST", "/api/backtest", b"{}")
    assert status == 200 and len(payload["allocation"]) == 5 and payload["metadata"]["members"]["least_eligible"] == 5
    assert {m["variant"] for m in payload["metrics"]} == {"NRP-raw", "NRP-AMAD", "SP100Benchmark"}
    status, text = service.answer("POST", "/api/report", json.dumps({"run_id": payload["run_id"], "format": "text"}).encode())
    assert status == 200 and "AMAD_NRP" in text
    status, raw = service.answer("POST", "/api/report", json.dumps({"run_id": payload["run_id"]}).encode())
    assert status == 200 and raw.startswith(b"%PDF-") and pdf_objects(raw) == 6  # one page
    run = tmp_path / "runs" / payload["run_id"]
    assert len(bars_of((run / "latest_allocation.svg").read_text())) == 5
    assert lines_of((run / "net_value.svg").read_text()) == ["AMAD_NRP", "Raw_NRP", "SP100Benchmark"]
    assert lines_of((run / "report" / "drawdown.svg").read_text()) == ["AMAD_NRP", "Raw_NRP"]
    assert service.answer("GET", "/api/health")[0] == 200 and service.answer("GET", "/x")[0] == 404 and service.answer("POST", "/api/backtest", b"")[0] == 400
    assert service.answer("POST", "/api/backtest", b'{"AMAD_window": 63}')[0] == 400 and service.answer("POST", "/api/report", b'{"run_id": "../x"}')[0] == 400
    with service.busy:
        assert service.answer("POST", "/api/backtest", b"{}")[0] == 409

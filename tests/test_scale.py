"""What lets series, rebalances and graphs grow beyond one task: each against the plain way."""

from datetime import UTC, date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from arborfolio.config import BacktestConfig, CalculationError, DataValidationError
from arborfolio.operators import availability, blocks, market, network, scan, sliding, trees, universe
from arborfolio.sources import panels, sinks


def long_rows(spark, frame, name):
    rows = [(d, a, float(v)) for d, r in frame.iterrows() for a, v in r.items() if v == v]
    return spark.createDataFrame(rows, f"date date, asset string, {name} double")


def plain_medians(values, window):
    frames = np.lib.stride_tricks.sliding_window_view(values, window)
    med = np.median(frames, axis=-1)
    return med, np.median(np.abs(frames - med[:, None]), axis=-1)


def test_sliding_medians_equal_sorted_frames():
    rng = np.random.default_rng(4)
    for window in (1, 2, 3, 8, 63, 126):
        for values in (rng.standard_t(2, 300), rng.integers(0, 4, 300).astype(float), np.zeros(200)):
            for got, want in zip(sliding.sliding_medians(values, window), plain_medians(values, window), strict=True):
                assert np.array_equal(got, want)
    holes = np.array([1.0, np.nan, 2, 3, 4, 5])
    assert np.isnan(sliding.sliding_medians(holes, 3)[0][:2]).all() and sliding.sliding_medians(holes, 3)[0][2:].tolist() == [3, 4]
    assert len(sliding.sliding_medians(np.zeros(3), 5)[0]) == 0


def test_sliding_costs_less_than_the_window():
    class Counted(float):
        compared = 0

        def __lt__(self, other):
            Counted.compared += 1
            return float(self) < float(other)

    class Values(np.ndarray):
        def tolist(self):
            return [Counted(x) for x in np.asarray(self)]

    values = np.random.default_rng(1).standard_normal(3_000)
    sliding.sliding_medians(values.view(Values), 1_000)
    assert 0 < Counted.compared / len(values) < 60


@pytest.mark.parametrize("block", [3, 40, 10_000])
def test_time_ranges_give_the_whole_series(spark, block):
    rng = np.random.default_rng(2)
    days = [date(2020, 1, 1) + timedelta(days=int(d)) for d in np.cumsum(rng.integers(1, 30, 400))]
    frame = pd.DataFrame({"A": rng.standard_t(2, 400), "B": rng.standard_t(2, 400)}, index=days)
    frame.iloc[20:300, 1] = np.nan
    returns = long_rows(spark, frame, "r")
    config = {"window": 25, "threshold": 2.0}
    parts = sliding.time_ranges(returns, ("asset",), block, 24)
    assert parts.filter("own").count() == returns.count()
    if block == 3:
        assert parts.groupBy("asset", "block").count().agg(F.max("count")).first()[0] < 24 + 31 + 31
        assert parts.filter("asset = 'A'").select("block").distinct().count() > 16
    for make in (market.dampen, market.trailing_median):
        kw = {"check": False} if make is market.dampen else {}
        whole = sorted(map(str, make(returns, config, **kw).collect()))
        assert sorted(map(str, make(returns, config, block_rows=block, **kw).collect())) == whole


def holed_panel(spark, seed, holes=0.02):
    rng = np.random.default_rng(seed)
    days = [date(2024, 1, 1) + timedelta(days=2 * i) for i in range(110)]
    frame = pd.DataFrame(np.exp(np.cumsum(rng.standard_t(3, (110, 5)) * 0.02, axis=0)) * 50, index=days, columns=list("ABCDE"))
    frame = frame.mask(rng.random(frame.shape) < holes)
    frame.iloc[:30, 4] = np.nan
    return frame, long_rows(spark, frame, "price")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_needed_dates_equal_whole_history(spark, seed):
    frame, panel = holed_panel(spark, seed)
    dates = spark.createDataFrame([(d,) for d in frame.index], "date date")
    moments = universe.rebalances(market.month_calendar(dates), 2).filter("rid > 4")
    chosen = moments.select("rid").crossJoin(panel.select("asset").distinct()).filter("not (rid = 6 and asset in ('A', 'E'))")
    config, variants = BacktestConfig(estimation_months=2, window=8), {"raw": False, "drawn": True}
    history = panel.join(chosen, "asset").join(moments.select("rid", "eff"), "rid").filter("date < eff").select("rid", "date", "asset", "price")
    plain = lambda df: sorted([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()], key=str)
    got = network.allocate_needed(panel, dates, chosen, moments, config, variants)
    assert plain(got) == plain(network.allocate_groups(history, moments, config, variants))
    # only the window's common dates, and eight before it, are sent
    needed = availability.needed_dates(panel, dates, chosen, moments, 8)
    spans = {r.rid: r for r in moments.collect()}
    assets = {i: [r.asset for r in chosen.filter(f"rid = {i}").collect()] for i in spans}
    for rid, found in needed.toPandas().groupby("rid"):
        common = [d for d in frame.index if d < spans[rid].eff and frame.loc[d, assets[rid]].notna().all()]
        inside = [d for d in common if d >= spans[rid].m0]
        want = [d for d in common if d < spans[rid].m0][-8:] + inside
        assert sorted(found["date"]) == want and set(found["common"]) == {len(common)} and not found["bad"].any()


def test_needed_dates_see_bad_prices_and_missing_ones(spark):
    frame, _ = holed_panel(spark, 5, holes=0)
    frame.iloc[35, 0] = -1.0
    panel = long_rows(spark, frame, "price")
    dates = spark.createDataFrame([(d,) for d in frame.index], "date date")
    moments = universe.rebalances(market.month_calendar(dates), 2).filter("rid > 4")
    chosen = moments.select("rid").crossJoin(panel.select("asset").distinct())
    config = BacktestConfig(estimation_months=2, window=8)
    with pytest.raises(Exception, match="finite and positive"):
        network.allocate_needed(panel, dates, chosen, moments, config, {"raw": False}).collect()
    lone = panel.filter("asset <> 'A' or date >= '2024-07-01'").filter("asset <> 'B' or date < '2024-02-01'")
    with pytest.raises(Exception, match="finite and positive"):
        network.allocate_needed(lone, dates, chosen, moments, config, {"raw": False}).collect()


def test_blocked_covariances_equal_pairs(spark):
    rng = np.random.default_rng(3)
    days = [date(2024, 1, 1) + timedelta(days=3 * i) for i in range(40)]
    frame = pd.DataFrame(rng.standard_normal((40, 9)), index=days, columns=list("ABCDEFGHI")).mask(rng.random((40, 9)) < 0.4)
    frame.loc[frame.index[:20], "A"] = np.nan
    returns = long_rows(spark, frame, "r")
    plain = lambda df: sorted((str(r.month), r.i, r.j, round(r["cov"], 9)) for r in df.collect())
    want = plain(market.monthly_realized_cov(returns, check=False))
    for n in (1, 3):
        assert plain(blocks.blocked_cov(returns, n)) == want
    assert blocks.blocked_cov(returns.limit(0), 3).count() == 0


def test_tree_rounds_equal_sorted_edges(spark):
    rng = np.random.default_rng(8)
    rows, want = [], set()
    for key, n in ((1, 2), (2, 40), (3, 25)):
        d = rng.integers(1, 30, (n, n)) / 30  # many ties
        names = [f"n{x:03d}" for x in range(n)]
        rows += [(key, names[i], names[j], float(d[i, j])) for i in range(n) for j in range(i + 1, n)]
        d = np.triu(d, 1) + np.triu(d, 1).T
        want |= {(key, names[a], names[b]) for a, b in network.spanning_tree(d, "unweighted")}
    pairs = spark.createDataFrame(rows, "key int, i string, j string, distance double")
    assert {(r.key, r.i, r.j) for r in trees.spanning_edges(pairs, "key").collect()} == want
    with pytest.raises(CalculationError):
        trees.spanning_edges(pairs.filter("key = 3 and (i > 'n005') = (j > 'n005')"), "key")
    with pytest.raises(CalculationError):
        trees.spanning_edges(pairs.withColumn("distance", F.lit(0.0)), "key")
    assert trees.spanning_edges(pairs.limit(0), "key").count() == 0


def test_tree_messages_equal_the_dense_eigenvector():
    rng = np.random.default_rng(0)
    for n in (2, 3, 5, 30, 200):
        for path in (False, True):
            i = np.arange(n - 1) if path else np.array([rng.integers(0, k) for k in range(1, n)])
            j, w = np.arange(1, n), rng.random(n - 1) + 0.01
            dense = np.zeros((n, n))
            dense[i, j] = dense[j, i] = w
            radius, vector = trees.tree_perron(i, j, w, n)
            values, axes = np.linalg.eigh(dense)
            assert abs(radius - values[-1]) < 1e-12 and np.abs(vector - np.abs(axes[:, -1])).max() < 1e-9
            assert n > 30 or np.abs(vector - network.perron(dense)[1]).max() < 1e-9
    with pytest.raises(CalculationError):
        trees.tree_perron(np.array([0]), np.array([1]), np.array([1.0]), 3)


@pytest.mark.parametrize("keys", [(), ("k",)])
def test_running_values_equal_one_window(spark, keys):
    rng = np.random.default_rng(6)
    rows = [(k, date(2020, 1, 1) + timedelta(days=int(d)), float(v) if v < 1.5 else None) for k in ("a", "b")[: 1 + len(keys)] for d, v in zip(np.cumsum(rng.integers(1, 40, 60)), rng.standard_normal(60), strict=True)]
    frame = spark.createDataFrame(rows, "k string, date date, v double")
    w = Window.partitionBy(*keys, F.lit(1)).orderBy("date")
    want = frame.select("*", F.product("v").over(w).alias("p"), F.max("v").over(w).alias("m"), F.lag("v").over(w).alias("b"))
    got = scan.running(frame, "date", F.trunc("date", "MM"), keys, p=("product", F.col("v")), m=("max", F.col("v")), b=("before", F.col("v")))
    plain = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else str(x) for x in r) for r in df.select("k", "date", "v", "p", "m", "b").collect())
    assert plain(got) == plain(want)
    if not keys:
        windows = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in x]
        assert windows and all("], [_part#" in x for x in windows)
    assert [(r.date.day, r.k) for r in scan.numbered(spark.sql("select date'2024-01-05' as date union all select date'2024-01-02' union all select date'2024-01-05'"), "date").orderBy("k").collect()] == [(2, 1), (5, 2)]


def test_members_by_year_equal_a_nested_loop(spark):
    rng = np.random.default_rng(9)
    day = lambda: date(2019, 1, 1) + timedelta(days=int(rng.integers(0, 1500)))
    rows = [(a, b if b > a else None, f"x{i}") for i in range(60) for a, b in [(day(), day())]] + [(date(2021, 3, 1), date(2021, 3, 1), "none")]
    intervals = spark.createDataFrame(rows, "start date, end_excl date, asset string")
    effs = [(i, date(2020, 1 + i % 12, 3).replace(year=2020 + i // 12)) for i in range(24)]
    moments = spark.createDataFrame(effs, "rid int, eff date")
    found = universe.active_members(intervals, moments)
    assert sorted((r.rid, r.asset) for r in found.collect()) == sorted((i, a) for i, eff in effs for s, e, a in rows if s <= eff and (e is None or e > eff))
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert universe.active_members(intervals, moments.limit(0)).count() == 0


def test_runs_are_whole_or_not_there(spark, tmp_path):
    when = datetime(2024, 5, 6, 7, 8, 9, tzinfo=UTC)
    with pytest.raises(RuntimeError), sinks.new_run(tmp_path, 24, when) as (run, _):
        sinks.write_table(spark.range(3).toDF("n"), run, "numbers")
        raise RuntimeError("midway")
    assert list(tmp_path.iterdir()) == []
    with sinks.new_run(tmp_path, 24, when) as (run, place):
        assert not place.exists() and not run.name.startswith("run_")
        sinks.write_table(spark.range(3).toDF("n"), run, "numbers")
    assert [p.name for p in tmp_path.iterdir()] == ["run_20240506T070809Z_months24"] and sinks.is_whole(place)
    assert panels.read_table(spark, place, "numbers").count() == 3
    with pytest.raises(FileExistsError), sinks.new_run(tmp_path, 24, when):
        pass
    (place / "numbers.csv" / "more").write_text("x")
    assert not sinks.is_whole(place)


def test_bad_membership_records_name_their_lines(spark, tmp_path):
    head = "Membership_Start,Membership_End_Exclusive,Price_Ticker,Note\n"
    (tmp_path / "good.csv").write_text(head + "2020-01-01,,A,x\n2020-01-01,2021-01-01,B,\n")
    assert panels.read_membership(spark, str(tmp_path / "good.csv")).count() == 2
    (tmp_path / "bad.csv").write_text(head + "2020-01-01,,A,x\n2020-13-01,,B,\n\n2020-01-01,2019-01-01,C,\n2020-01-01,,,\n2020-01-01\n,,D,\n")
    got = panels.membership_problems(spark, str(tmp_path / "bad.csv")).orderBy("line").collect()
    assert [(r.line, r.reason) for r in got] == [(3, "not a date"), (5, "ends before it starts"), (6, "no ticker"), (7, "fields"), (8, "no start")]
    with pytest.raises(DataValidationError, match="3"):
        panels.read_membership(spark, str(tmp_path / "bad.csv"))


def test_numbered_lines_of_a_file_in_blocks(spark, tmp_path):
    (tmp_path / "t.txt").write_text("".join(f"line {i}\n" for i in range(1, 5_001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = panels.numbered_lines(spark, str(tmp_path / "t.txt"))
        assert lines.filter("value = concat('line ', line)").count() == 5_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)

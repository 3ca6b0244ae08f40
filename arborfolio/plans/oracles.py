"""SQL for DuckDB, written from the operators' meaning and by other algorithms: spanning trees by minimax closure of edge
ranks, eigenvectors by repeated squaring of A + I, drift day by day as cumulative products."""

from __future__ import annotations

ORACLES: dict[str, str] = {}


def r(x: str, digits: int = 8) -> str:
    return f"(round({x}, {digits}) + 0.0)"


def panel(name: str, column: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, {column} AS asset, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / (count(l_extendedprice) * 100.0) AS price FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"


PX = panel("px", "p_brand")
TX = panel("tx", "p_type")
DX = "dx AS MATERIALIZED (SELECT CAST(l_shipdate AS DATE) AS date, p_brand AS asset, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / (count(l_extendedprice) * 100.0) AS price FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"
FX = f"""{TX}, fx AS MATERIALIZED (SELECT * FROM tx WHERE date IN (SELECT date FROM tx GROUP BY date HAVING count(*) = (SELECT count(DISTINCT asset) FROM tx)))"""
BX = "bx AS MATERIALIZED (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / (count(l_extendedprice) * 100.0) AS price FROM lineitem GROUP BY 1)"
MEMB = """memb AS MATERIALIZED (SELECT DATE '1995-01-01' + CAST(k % 4 * 180 AS INTEGER) AS start, CASE WHEN k % 5 = 4 THEN DATE '1995-01-01' + CAST(k % 4 * 180 AS INTEGER) + 1500 END AS end_excl, asset
  FROM (SELECT asset, row_number() OVER (ORDER BY asset) - 1 AS k FROM (SELECT DISTINCT asset FROM px)) UNION ALL SELECT DATE '1995-01-01', CAST(NULL AS DATE), 'Brand#None')"""


def calendar(source: str, months: int = 24) -> str:
    return f"""cal AS MATERIALIZED (SELECT CAST(date_trunc('month', date) AS DATE) AS month, min(date) AS eff, max(date) AS hold_end, row_number() OVER (ORDER BY CAST(date_trunc('month', date) AS DATE)) AS k FROM {source} GROUP BY 1),
reb AS MATERIALIZED (SELECT CAST(c.k AS INTEGER) AS rid, c.month, c.eff, c.hold_end, a.month AS m0, b.month AS m1 FROM cal c JOIN cal a ON a.k = c.k - {months} JOIN cal b ON b.k = c.k - 1)"""


def audits(name: str = "audit", reb: str = "reb") -> str:
    return f"""{name} AS MATERIALIZED (SELECT r.rid, r.eff, r.m0, r.m1, r.hold_end, m.asset, (SELECT count(DISTINCT p.date) FROM px p WHERE p.date BETWEEN r.m0 AND r.hold_end) AS required,
  (SELECT count(*) FROM px p WHERE p.asset = m.asset AND p.price > 0 AND p.date BETWEEN r.m0 AND r.hold_end) AS available, m.asset IN (SELECT asset FROM px) AS known
  FROM memb m JOIN {reb} r ON m.start <= r.eff AND (m.end_excl IS NULL OR m.end_excl > r.eff))"""


UNIVERSE = f"{PX}, {MEMB}, {calendar('px')}, {audits()}"
HISTORY_PIT = """pan AS MATERIALIZED (SELECT * FROM px), elig AS MATERIALIZED (SELECT rid, asset FROM audit WHERE known AND available = required),
hist AS MATERIALIZED (SELECT e.rid, p.date, p.asset, p.price FROM elig e JOIN reb USING (rid) JOIN px p ON p.asset = e.asset AND p.date < reb.eff),
obs AS MATERIALIZED (SELECT h.* FROM hist h JOIN (SELECT rid, date FROM hist GROUP BY rid, date HAVING count(*) = (SELECT count(*) FROM elig e WHERE e.rid = hist.rid)) USING (rid, date))"""
HISTORY_FIXED = "pan AS MATERIALIZED (SELECT * FROM fx), obs AS MATERIALIZED (SELECT rid, date, asset, price FROM fx JOIN reb ON fx.date < reb.eff)"
FIXED = f"{FX}, {calendar('(SELECT * FROM fx WHERE date > (SELECT min(date) FROM fx))')}, {HISTORY_FIXED}"


def network(dampened: bool, prefix: str, adjacency: str = "d", mode: str = "inverse") -> str:
    """CTEs {prefix}edge (rid, i, j, d, rho, a), {prefix}node (rid, asset, xi, weight), {prefix}top (rid, lambda)."""
    p = prefix
    damp = f"""CASE WHEN count(*) OVER w = 63 AND mad(x) OVER w > 1e-12 AND abs(x - median(x) OVER w) > 3 * mad(x) OVER w THEN median(x) OVER w + sign(x - median(x) OVER w) * mad(x) OVER w * (3 + ln(greatest(abs(x - median(x) OVER w) / mad(x) OVER w - 2, 1))) ELSE x END"""
    out = [f"{p}ret AS MATERIALIZED (SELECT rid, date, asset, ln(price / lag(price) OVER (PARTITION BY rid, asset ORDER BY date)) AS x FROM obs)"]
    out.append(f"{p}use AS MATERIALIZED (SELECT rid, date, asset, {damp if dampened else 'x'} AS x FROM {p}ret WHERE x IS NOT NULL" + (" WINDOW w AS (PARTITION BY rid, asset ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW))" if dampened else ")"))
    out.append(f"{p}win AS MATERIALIZED (SELECT u.* FROM {p}use u JOIN reb USING (rid) WHERE CAST(date_trunc('month', u.date) AS DATE) BETWEEN m0 AND m1)")
    out.append(f"{p}cov AS MATERIALIZED (SELECT a.rid, a.asset AS i, b.asset AS j, sum(a.x * b.x) AS s FROM {p}win a JOIN {p}win b ON a.rid = b.rid AND a.date = b.date AND a.asset <= b.asset GROUP BY 1, 2, 3)")
    out.append(f"{p}cor AS MATERIALIZED (SELECT c.rid, c.i, c.j, greatest(-1, least(1, c.s / sqrt(v.s * u.s))) AS rho FROM {p}cov c JOIN {p}cov v ON v.rid = c.rid AND v.i = c.i AND v.j = c.i JOIN {p}cov u ON u.rid = c.rid AND u.i = c.j AND u.j = c.j WHERE c.i < c.j)")
    out.append(f"{p}ranked AS MATERIALIZED (SELECT rid, i, j, rho, 1 - rho * rho AS d, row_number() OVER (PARTITION BY rid ORDER BY 1 - rho * rho, i, j) AS k FROM {p}cor)")
    out.append(f"{p}m0 AS MATERIALIZED (SELECT rid, i, j, k AS v FROM {p}ranked UNION ALL SELECT rid, j, i, k FROM {p}ranked UNION ALL SELECT DISTINCT rid, asset, asset, 0 FROM {p}win)")
    for s in range(1, 6):
        out.append(f"{p}m{s} AS MATERIALIZED (SELECT a.rid, a.i, b.j, min(greatest(a.v, b.v)) AS v FROM {p}m{s - 1} a JOIN {p}m{s - 1} b ON a.rid = b.rid AND a.j = b.i GROUP BY 1, 2, 3)")
    out.append(f"{p}edge AS MATERIALIZED (SELECT e.rid, e.i, e.j, e.d, e.rho, CAST({'e.d' if adjacency == 'd' else '1'} AS DOUBLE) AS a FROM {p}ranked e JOIN {p}m5 m ON m.rid = e.rid AND m.i = e.i AND m.j = e.j AND m.v = e.k)")
    out.append(f"{p}s0 AS MATERIALIZED (SELECT rid, i, j, a AS v FROM {p}edge UNION ALL SELECT rid, j, i, a FROM {p}edge UNION ALL SELECT DISTINCT rid, asset, asset, 1.0 FROM {p}win)")
    for s in range(1, 13):
        out.append(f"{p}t{s} AS MATERIALIZED (SELECT a.rid, a.i, b.j, sum(a.v * b.v) AS v FROM {p}s{s - 1} a JOIN {p}s{s - 1} b ON a.rid = b.rid AND a.j = b.i GROUP BY 1, 2, 3)")
        out.append(f"{p}s{s} AS MATERIALIZED (SELECT rid, i, j, v / max(v) OVER (PARTITION BY rid) AS v FROM {p}t{s})")
    inverse = "exp(1 / xi - max(1 / xi) OVER (PARTITION BY rid))" if mode == "softmax" else "1 / xi"
    out.append(f"{p}xi AS MATERIALIZED (SELECT rid, asset, y / sqrt(sum(y * y) OVER (PARTITION BY rid)) AS xi FROM (SELECT rid, i AS asset, sum(v) AS y FROM {p}s12 GROUP BY 1, 2))")
    out.append(f"{p}raw AS MATERIALIZED (SELECT rid, asset, xi, {inverse} AS w FROM {p}xi)")
    out.append(f"{p}node AS MATERIALIZED (SELECT rid, asset, xi, w / sum(w) OVER (PARTITION BY rid) AS weight FROM {p}raw)")
    out.append(f"{p}top AS MATERIALIZED (SELECT e.rid, 2 * sum(e.a * x.xi * y.xi) AS lambda FROM {p}edge e JOIN {p}xi x ON x.rid = e.rid AND x.asset = e.i JOIN {p}xi y ON y.rid = e.rid AND y.asset = e.j GROUP BY 1)")
    return ", ".join(out)


def both(*names: str) -> str:
    """One CTE for each name, over both variants."""
    return ", ".join(f"{n} AS MATERIALIZED (SELECT 'NRP-raw' AS variant, * FROM r_{n} UNION ALL SELECT 'NRP-AMAD', * FROM d_{n})" for n in names)


PIT = f"{UNIVERSE}, {HISTORY_PIT}, {network(False, 'r_')}, {network(True, 'd_')}, {both('edge', 'node', 'top')}"


def hold(bps: float) -> str:
    """day-by-day drift: an asset's value is its weight times the product of its simple returns since the month's start."""
    return f"""prices AS MATERIALIZED (SELECT asset, date, price, price / lag(price) OVER (PARTITION BY asset ORDER BY date) AS g FROM pan),
hval AS MATERIALIZED (SELECT n.variant, n.rid, n.asset, p.date, n.weight * product(p.g) OVER (PARTITION BY n.variant, n.rid, n.asset ORDER BY p.date) AS v FROM node n JOIN reb USING (rid) JOIN prices p ON p.asset = n.asset AND p.date BETWEEN reb.eff AND reb.hold_end),
hend AS MATERIALIZED (SELECT variant, rid, asset, v / sum(v) OVER (PARTITION BY variant, rid) AS w FROM hval JOIN reb USING (rid) WHERE date = hold_end),
moved AS MATERIALIZED (SELECT variant, rid, 0.5 * sum(abs(new - old)) AS turnover FROM (SELECT variant, rid, asset, sum(n) AS new, sum(o) AS old FROM (SELECT variant, rid, asset, weight AS n, 0.0 AS o FROM node UNION ALL SELECT variant, rid + 1, asset, 0.0, w FROM hend) WHERE rid IN (SELECT rid FROM reb) GROUP BY 1, 2, 3) GROUP BY 1, 2),
tot AS MATERIALIZED (SELECT variant, rid, date, sum(v) AS v FROM hval GROUP BY 1, 2, 3),
days0 AS MATERIALIZED (SELECT t.variant, t.rid, t.date, t.v / coalesce(lag(t.v) OVER (PARTITION BY t.variant, t.rid ORDER BY t.date), 1.0) - 1 AS gross, CASE WHEN t.date = reb.eff THEN m.turnover * {bps} / 10000 ELSE 0.0 END AS cost FROM tot t JOIN moved m USING (variant, rid) JOIN reb USING (rid)),
days1 AS MATERIALIZED (SELECT *, (1 - cost) * (1 + gross) - 1 AS net FROM days0),
days AS MATERIALIZED (SELECT *, product(1 + net) OVER (PARTITION BY variant ORDER BY date) AS value FROM days1),
mon AS MATERIALIZED (SELECT variant, rid, CAST(date_trunc('month', date) AS DATE) AS month, product(1 + gross) - 1 AS gross, sum(cost) AS cost, product(1 + net) - 1 AS net, arg_max(value, date) AS value FROM days GROUP BY 1, 2, 3),
diag AS MATERIALIZED (SELECT variant, rid, max(weight) AS hi, min(weight) AS lo, 1 / sum(weight * weight) AS eff_n, count(*) AS n FROM node GROUP BY 1, 2)"""


STUDY = f"{PIT}, {hold(10.0)}"
BENCH = f"""{BX}, bret AS MATERIALIZED (SELECT date, price / lag(price) OVER (ORDER BY date) - 1 AS x FROM bx),
bday AS MATERIALIZED (SELECT d.date, b.x, product(1 + b.x) OVER (ORDER BY d.date) AS value FROM (SELECT DISTINCT date FROM px WHERE date >= (SELECT min(eff) FROM reb)) d LEFT JOIN bret b USING (date)),
bmon AS MATERIALIZED (SELECT month, eff, x, product(1 + x) OVER (ORDER BY month) AS value FROM (SELECT CAST(date_trunc('month', date) AS DATE) AS month, min(date) AS eff, product(1 + x) - 1 AS x FROM bday GROUP BY 1))"""


def metric_rows(source: str, key: str, month: str, net: str) -> str:
    return f"""(SELECT variant, count(*) AS n, product(1 + net) AS total, stddev_samp(net) * sqrt(12) AS vol, min(dd) AS mdd FROM (SELECT *, v / max(v) OVER (PARTITION BY variant ORDER BY month) - 1 AS dd FROM (SELECT {key} AS variant, {month} AS month, {net} AS net, product(1 + {net}) OVER (PARTITION BY {key} ORDER BY {month}) AS v FROM {source})) GROUP BY 1)"""


def metric_sql(source: str, extra: str, kind: str) -> str:
    ret = "pow(total, 12.0 / n) - 1"
    return f"""SELECT q.variant, q.n AS "OutOfSampleMonths", {r(ret)} AS "AnnualizedReturn", {r('vol')} AS "AnnualizedVolatility", {r(f'CASE WHEN vol > 1e-12 THEN ({ret}) / vol ELSE 0.0 END')} AS "SharpeRatio", {r('mdd')} AS "MaximumDrawdown", {extra}, {kind} AS "ReturnPreprocessing" FROM {source}"""


DIAG_MEANS = f"""{r('avg_hi')} AS "AverageMaximumWeight", {r('max_hi')} AS "WorstMaximumWeight", {r('avg_n')} AS "AverageEffectiveHoldings", {r('avg_t')} AS "AverageTurnover\""""
NO_MEANS = """CAST(NULL AS DOUBLE) AS "AverageMaximumWeight", CAST(NULL AS DOUBLE) AS "WorstMaximumWeight", CAST(NULL AS DOUBLE) AS "AverageEffectiveHoldings", 0.0 :: DOUBLE AS "AverageTurnover\""""
STUDY_METRICS = metric_sql(f"{metric_rows('mon', 'variant', 'month', 'net')} q JOIN (SELECT variant, avg(hi) AS avg_hi, max(hi) AS max_hi, avg(eff_n) AS avg_n, avg(turnover) AS avg_t FROM diag JOIN moved USING (variant, rid) GROUP BY 1) USING (variant)", DIAG_MEANS, "split_part(q.variant, '-', 2)")
BENCH_METRICS = metric_sql(metric_rows("bmon", "'SP100Benchmark'", "month", "x") + " q", NO_MEANS, "'none'")

SERIES = """ser AS MATERIALIZED (SELECT CASE variant WHEN 'NRP-AMAD' THEN 'AMAD_NRP' ELSE 'Raw_NRP' END AS series, date, net FROM days UNION ALL SELECT 'SP100Benchmark', date, x FROM bday),
sval AS MATERIALIZED (SELECT *, product(1 + net) OVER (PARTITION BY series ORDER BY date) AS v FROM ser)"""
ALL = f"WITH {STUDY}, {BENCH}, {SERIES}"


def drawdown_sql(base: bool) -> str:
    peak = "max(v) OVER (PARTITION BY series ORDER BY date)"
    return f"v / {f'greatest({peak}, 1.0)' if base else peak} - 1"


def table_sql(base: bool) -> str:
    ret = "pow(g, 252.0 / n) - 1"
    ratio = lambda x: r(f"CASE WHEN {x} > 1e-12 THEN ({ret}) / {x} ELSE 0.0 END")
    return f"""{ALL} SELECT series, {r('g - 1')} AS "TotalReturn", {r(ret)} AS "AnnualizedReturn", {r('vol')} AS "Volatility", {ratio('vol')} AS "Sharpe", {ratio('down')} AS "Sortino", {ratio('abs(mdd)')} AS "Calmar", {r('mdd')} AS "MaximumDrawdown"
FROM (SELECT series, count(*) AS n, product(1 + net) AS g, coalesce(stddev_samp(net), 0) * sqrt(252) AS vol, coalesce(stddev_samp(CASE WHEN net < 0 THEN net END), 0) * sqrt(252) AS down, min(dd) AS mdd FROM (SELECT *, {drawdown_sql(base)} AS dd FROM sval) GROUP BY 1)"""


W63 = "WINDOW w AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)"
FRET = f"WITH {FX}, ret AS MATERIALIZED (SELECT * FROM (SELECT date, asset, ln(price / lag(price) OVER (PARTITION BY asset ORDER BY date)) AS x FROM fx) WHERE x IS NOT NULL)"
MCOV = f"{FRET}, mcov AS MATERIALIZED (SELECT CAST(date_trunc('month', a.date) AS DATE) AS month, a.asset AS i, b.asset AS j, sum(a.x * b.x) AS cov FROM ret a JOIN ret b ON a.date = b.date AND a.asset <= b.asset GROUP BY 1, 2, 3)"
WCOV = f"{MCOV}, mi AS (SELECT month, row_number() OVER (ORDER BY month) AS k FROM (SELECT DISTINCT month FROM mcov)), wcov AS MATERIALIZED (SELECT t.month, c.i, c.j, sum(c.cov) AS cov FROM mi t JOIN mi s ON s.k BETWEEN t.k - 24 AND t.k - 1 JOIN mcov c ON c.month = s.month WHERE t.k > 24 GROUP BY 1, 2, 3)"
COR = f"{WCOV}, cor AS (SELECT c.month, c.i, c.j, greatest(-1, least(1, c.cov / sqrt(a.cov * b.cov))) AS rho FROM wcov c JOIN wcov a ON a.month = c.month AND a.i = c.i AND a.j = c.i JOIN wcov b ON b.month = c.month AND b.i = c.j AND b.j = c.j WHERE c.i < c.j)"
HEAD = 'eff AS "EffectiveDate", m1 AS "EstimationEndMonth"'
AUDIT_COLUMNS = """eff AS "EffectiveDate", m0 AS "EstimationStartMonth", m1 AS "EstimationEndMonth", hold_end AS "HoldingEndDate", asset AS "Price_Ticker", known AND available = required AS "Eligible",
CASE WHEN NOT known THEN 'MissingPriceColumn' WHEN available = required THEN 'EligibleCompleteEstimationAndHoldingWindow' ELSE 'IncompleteEstimationOrHoldingWindow' END AS "EligibilityReason", required AS "RequiredPriceObservations", available AS "AvailablePriceObservations\""""
LATEST = f"""ranked AS (SELECT n.variant, eff AS "EffectiveDate", m1 AS "EstimationEndMonth", asset AS "Asset", weight, CAST(row_number() OVER (PARTITION BY n.variant ORDER BY weight DESC, asset) AS INTEGER) AS "Rank" FROM node n JOIN reb USING (rid) WHERE eff = (SELECT max(eff) FROM reb))"""
COMPARE = lambda a, key, value, bench: f"""SELECT x.{key} AS "{'Date' if key == 'date' else 'Month'}", {r('x.net')} AS "AMAD_NRP_Return", {r('x.value')} AS "AMAD_NRP_NetValue", {r('y.net')} AS "Raw_NRP_Return", {r('y.value')} AS "Raw_NRP_NetValue", {r('b.x')} AS "SP100BenchmarkReturn", {r('b.value')} AS "SP100BenchmarkNetValue" FROM {a} x JOIN {a} y ON y.{key} = x.{key} AND y.variant = 'NRP-raw' JOIN {bench} b ON b.{key} = x.{key} WHERE x.variant = 'NRP-AMAD'"""

ORACLES |= {
    "panel_prices": f"WITH {PX} SELECT date, asset, price FROM px",
    "panel_combine": f"WITH {PX} SELECT date, asset, price FROM px WHERE asset < 'Brand#6' UNION ALL SELECT date, asset, price FROM px WHERE asset >= 'Brand#6' AND date IN (SELECT date FROM px WHERE asset < 'Brand#6')",
    "panel_long_again": f"WITH {TX} SELECT date, asset, price FROM tx",
    "lossy_normalize": "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(ts AS DATE) END AS day, CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 THEN NULL ELSE round(value, 8) + 0.0 END AS value FROM events",
    "panel_quality": f"WITH {PX} SELECT count(DISTINCT date) AS dates, count(DISTINCT asset) AS assets, count(*) AS rows, CAST(sum(CASE WHEN date IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_dates, CAST(sum(CASE WHEN price IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_values, count(*) - count(DISTINCT (date, asset)) AS duplicates, CAST(sum(CASE WHEN isnan(price) OR isinf(price) THEN 1 ELSE 0 END) AS BIGINT) AS not_finite, CAST(sum(CASE WHEN price <= 0 THEN 1 ELSE 0 END) AS BIGINT) AS not_positive FROM px",
    "null_dup_audit": f"WITH {PX} SELECT asset, count(*) AS present, (SELECT count(DISTINCT date) FROM px) - count(*) AS missing, min(date) AS first, max(date) AS last FROM px GROUP BY 1",
    "log_returns": f"WITH {PX} SELECT date, asset, {r('x')} AS r FROM (SELECT date, asset, ln(price / lag(price) OVER (PARTITION BY asset ORDER BY date)) AS x FROM px) WHERE x IS NOT NULL",
    "simple_returns": f"WITH {PX} SELECT date, asset, {r('x')} AS r FROM (SELECT date, asset, price / lag(price) OVER (PARTITION BY asset ORDER BY date) - 1 AS x FROM px) WHERE x IS NOT NULL",
    "rolling_median": f"{FRET} SELECT date, asset, CASE WHEN count(*) OVER w = 63 THEN {r('median(x) OVER w')} END AS med FROM ret {W63}",
    "rolling_mad": f"{FRET} SELECT date, asset, CASE WHEN count(*) OVER w = 63 THEN {r('mad(x) OVER w')} END AS mad FROM ret {W63}",
    "dampened_returns": f"{FRET} SELECT date, asset, {r('CASE WHEN n = 63 AND s > 1e-12 AND abs(x - m) > 3 * s THEN m + sign(x - m) * s * (3 + ln(greatest(abs(x - m) / s - 2, 1))) ELSE x END')} AS r FROM (SELECT date, asset, x, median(x) OVER w AS m, mad(x) OVER w AS s, count(*) OVER w AS n FROM ret {W63})",
    "dampened_daily": f"WITH {DX}, ret AS MATERIALIZED (SELECT * FROM (SELECT date, asset, ln(price / lag(price) OVER (PARTITION BY asset ORDER BY date)) AS x FROM dx) WHERE x IS NOT NULL) SELECT date, asset, {r('CASE WHEN n = 126 AND s > 1e-12 AND abs(x - m) > 3 * s THEN m + sign(x - m) * s * (3 + ln(greatest(abs(x - m) / s - 2, 1))) ELSE x END')} AS r FROM (SELECT date, asset, x, median(x) OVER w AS m, mad(x) OVER w AS s, count(*) OVER w AS n FROM ret WINDOW w AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 125 PRECEDING AND CURRENT ROW))",
    "trailing_ranges": f"WITH {DX}, ret AS MATERIALIZED (SELECT * FROM (SELECT date, asset, ln(price / lag(price) OVER (PARTITION BY asset ORDER BY date)) AS x FROM dx) WHERE x IS NOT NULL) SELECT date, asset, {r('x')} AS r, {r('CASE WHEN n = 63 THEN m END')} AS med, {r('CASE WHEN n = 63 THEN s END')} AS mad FROM (SELECT date, asset, x, median(x) OVER w AS m, mad(x) OVER w AS s, count(*) OVER w AS n FROM ret WINDOW w AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW))",
    "daily_cov": f"WITH {DX}, ret AS MATERIALIZED (SELECT * FROM (SELECT date, asset, ln(price / lag(price) OVER (PARTITION BY asset ORDER BY date)) AS x FROM dx) WHERE x IS NOT NULL) SELECT CAST(date_trunc('month', a.date) AS DATE) AS month, a.asset AS i, b.asset AS j, {r('sum(a.x * b.x)')} AS cov FROM ret a JOIN ret b ON a.date = b.date AND a.asset <= b.asset GROUP BY 1, 2, 3",
    "validation_outcomes": f"""WITH {PX}, two AS (SELECT * FROM px WHERE asset IN (SELECT DISTINCT asset FROM px ORDER BY asset LIMIT 2)), whole AS MATERIALIZED (SELECT * FROM two WHERE date IN (SELECT date FROM two GROUP BY date HAVING count(*) = 2)),
cases AS (SELECT 'whole' AS name, * FROM whole UNION ALL SELECT 'twice', * FROM whole UNION ALL SELECT 'twice', * FROM (SELECT * FROM whole ORDER BY date, asset LIMIT 1) UNION ALL SELECT 'negative', date, asset, CASE WHEN asset = (SELECT min(asset) FROM whole) THEN -price ELSE price END FROM whole
UNION ALL SELECT 'zero', date, asset, CASE WHEN asset = (SELECT min(asset) FROM whole) THEN 0 ELSE price END FROM whole UNION ALL SELECT 'holes', * FROM whole WHERE asset <> (SELECT min(asset) FROM whole) OR date < DATE '1996-01-01' UNION ALL SELECT 'infinite', date, asset, CASE WHEN asset = (SELECT min(asset) FROM whole) THEN 'Infinity' :: DOUBLE ELSE price END FROM whole
UNION ALL SELECT 'short', * FROM whole WHERE date IN (SELECT DISTINCT date FROM whole ORDER BY date LIMIT 2))
SELECT name AS "case", count(*) = count(DISTINCT (date, asset)) AND count(*) = count(DISTINCT date) * count(DISTINCT asset) AND count(DISTINCT date) >= 3 AND bool_and(isfinite(price) AND price > 0) AS valid FROM cases GROUP BY 1""",
    "month_calendar": f"""WITH {PX}, {calendar('px')} SELECT month AS "Month", eff AS "EffectiveDate", hold_end AS "HoldingEndDate" FROM cal""",
    "active_members": f'WITH {UNIVERSE} SELECT eff AS "EffectiveDate", asset FROM audit',
    "eligibility_audit": f"WITH {UNIVERSE} SELECT {AUDIT_COLUMNS} FROM audit",
    "eligibility_summary": f'WITH {UNIVERSE} SELECT eff AS "EffectiveDate", count(*) AS "ActiveMembers", count(*) FILTER (known AND available = required) AS "EligibleAssets" FROM audit GROUP BY 1',
    "excluded_latest": f'WITH {UNIVERSE} SELECT "EffectiveDate", "Price_Ticker", "EligibilityReason" FROM (SELECT {AUDIT_COLUMNS} FROM audit) WHERE NOT "Eligible" AND "EffectiveDate" = (SELECT max(eff) FROM audit)',
    "monthly_cov": f"{MCOV} SELECT month, i, j, {r('cov')} AS cov FROM mcov",
    "window_cov": f"{WCOV} SELECT month, i, j, {r('cov')} AS cov FROM wcov",
    "correlation": f"{COR} SELECT month, i, j, {r('rho')} AS rho FROM cor",
    "distance": f"{COR} SELECT month, i, j, {r('1 - rho * rho')} AS distance FROM cor",
    "mst_edges": f"""WITH {PIT} SELECT variant, {HEAD}, i AS "AssetLeft", j AS "AssetRight", {r('d')} AS "Distance", {r('rho')} AS "Correlation", {r('a')} AS "AdjacencyWeight" FROM edge JOIN reb USING (rid)""",
    "mst_edges_unweighted": f"""WITH {FIXED}, {network(False, '', '1')} SELECT {HEAD}, i AS "AssetLeft", j AS "AssetRight", {r('d')} AS "Distance", {r('rho')} AS "Correlation", {r('a')} AS "AdjacencyWeight" FROM edge JOIN reb USING (rid)""",
    "mst_degree": f"""WITH {PIT} SELECT variant, eff AS "EffectiveDate", max(n) AS max_degree FROM (SELECT variant, rid, x, count(*) AS n FROM (SELECT variant, rid, i AS x FROM edge UNION ALL SELECT variant, rid, j FROM edge) GROUP BY 1, 2, 3) JOIN reb USING (rid) GROUP BY 1, 2""",
    "centrality": f"""WITH {PIT} SELECT n.variant, eff AS "EffectiveDate", asset AS "Asset", {r('xi')} AS "Centrality", (SELECT count(*) FROM edge e WHERE e.variant = n.variant AND e.rid = n.rid AND (e.i = n.asset OR e.j = n.asset)) AS "Degree" FROM node n JOIN reb USING (rid)""",
    "weights_inverse": f"""WITH {PIT} SELECT variant, {HEAD}, asset AS "Asset", {r('weight')} AS "Weight" FROM node JOIN reb USING (rid)""",
    "weights_softmax": f"""WITH {FIXED}, {network(False, '', 'd', 'softmax')} SELECT {HEAD}, asset AS "Asset", {r('weight')} AS "Weight" FROM node JOIN reb USING (rid)""",
    "turnover": f"""WITH {STUDY} SELECT variant, eff AS "EffectiveDate", {r('turnover')} AS "Turnover" FROM moved JOIN reb USING (rid)""",
    "holding_daily": f"""WITH {STUDY} SELECT variant, date AS "Date", CAST(date_trunc('month', date) AS DATE) AS "Month", {r('gross')} AS "GrossReturn", {r('cost')} AS "TransactionCost", {r('net')} AS "NetReturn", {r('value')} AS "NetValue" FROM days""",
    "end_weights": f"""WITH {STUDY} SELECT variant, eff AS "EffectiveDate", asset AS "Asset", {r('w')} AS "Weight" FROM hend JOIN reb USING (rid)""",
    "monthly_returns": f"""WITH {STUDY} SELECT m.variant, m.month AS "Month", eff AS "EffectiveDate", m0 AS "EstimationStartMonth", m1 AS "EstimationEndMonth", {r('m.gross')} AS "GrossReturn", {r('m.cost')} AS "TransactionCost", {r('m.net')} AS "NetReturn", {r('m.value')} AS "NetValue", d.n AS "EligibleAssets" FROM mon m JOIN reb USING (rid) JOIN diag d ON d.variant = m.variant AND d.rid = m.rid""",
    "rebalance_diagnostics": f"""WITH {STUDY} SELECT d.variant, {HEAD}, m0 AS "EstimationStartMonth", (SELECT count(*) FROM audit a WHERE a.rid = d.rid) AS "ActiveMembers", d.n AS "EligibleAssets", (SELECT count(*) FROM audit a WHERE a.rid = d.rid) - d.n AS "ExcludedAssets", split_part(d.variant, '-', 2) AS "ReturnPreprocessing", {r('hi')} AS "MaximumWeight", {r('lo')} AS "MinimumWeight", {r('eff_n')} AS "EffectiveHoldings",
(SELECT max(n) FROM (SELECT count(*) AS n FROM node x JOIN edge e ON e.variant = x.variant AND e.rid = x.rid AND (e.i = x.asset OR e.j = x.asset) WHERE x.variant = d.variant AND x.rid = d.rid GROUP BY x.asset)) AS "MaximumMSTDegree", {r('t.lambda')} AS "SpectralRadius", {r('turnover')} AS "Turnover" FROM diag d JOIN reb USING (rid) JOIN top t ON t.variant = d.variant AND t.rid = d.rid JOIN moved m ON m.variant = d.variant AND m.rid = d.rid""",
    "metrics_raw": f"WITH {STUDY} SELECT * FROM ({STUDY_METRICS}) WHERE variant = 'NRP-raw'",
    "metrics_dampened": f"WITH {STUDY} SELECT * FROM ({STUDY_METRICS}) WHERE variant = 'NRP-AMAD'",
    "fixed_monthly_returns": f"""WITH {FIXED}, {network(False, 'r_')}, node AS MATERIALIZED (SELECT 'NRP-raw' AS variant, * FROM r_node), {hold(0.0)} SELECT m.month AS "Month", eff AS "EffectiveDate", m0 AS "EstimationStartMonth", m1 AS "EstimationEndMonth", {r('gross')} AS "GrossReturn", {r('cost')} AS "TransactionCost", {r('net')} AS "NetReturn", {r('value')} AS "NetValue" FROM mon m JOIN reb USING (rid)""",
    "benchmark_daily": f"""WITH {PX}, {calendar('px')}, {BENCH} SELECT date AS "Date", {r('x')} AS "GrossReturn", 0.0 :: DOUBLE AS "TransactionCost", {r('x')} AS "NetReturn", {r('value')} AS "GrossValue", {r('value')} AS "NetValue" FROM bday""",
    "benchmark_monthly": f"""WITH {PX}, {calendar('px')}, {BENCH} SELECT month AS "Month", eff AS "EffectiveDate", {r('x')} AS "GrossReturn", 0.0 :: DOUBLE AS "TransactionCost", {r('x')} AS "NetReturn", {r('value')} AS "NetValue" FROM bmon""",
    "benchmark_metrics": f"WITH {PX}, {calendar('px')}, {BENCH} {BENCH_METRICS}",
    "compare_daily": f"{ALL} {COMPARE('days', 'date', 'value', 'bday')}",
    "compare_monthly": f"{ALL} {COMPARE('mon', 'month', 'value', 'bmon')}",
    "compare_metrics": f"{ALL} {STUDY_METRICS} UNION ALL {BENCH_METRICS}",
    "latest_allocation": f"""WITH {PIT}, {LATEST} SELECT variant, "EffectiveDate", "EstimationEndMonth", "Asset", {r('weight')} AS "Weight" FROM ranked""",
    "top_allocation": f"""WITH {PIT}, {LATEST} SELECT variant, "EffectiveDate", "EstimationEndMonth", "Asset", {r('weight')} AS "Weight", "Rank" FROM ranked WHERE "Rank" <= 20""",
    "drawdown": f"""{ALL} SELECT series, date AS "Date", {r(drawdown_sql(False))} AS drawdown FROM sval""",
    "drawdown_base1": f"""{ALL} SELECT series, date AS "Date", {r(drawdown_sql(True))} AS drawdown FROM sval""",
    "performance_table": table_sql(False),
    "performance_table_base1": table_sql(True),
    "diagnostics": f"""WITH {STUDY} SELECT variant, {r('b')} AS "BestDay", {r('w')} AS "WorstDay", {r('h')} AS "AverageMaximumPosition", {r('e')} AS "EffectiveHoldings" FROM (SELECT variant, max(net) AS b, min(net) AS w FROM days GROUP BY 1) JOIN (SELECT variant, avg(hi) AS h, avg(eff_n) AS e FROM diag GROUP BY 1) USING (variant)""",
    "return_histogram": f"""WITH {STUDY}, pct AS (SELECT net * 100 AS x FROM days WHERE variant = 'NRP-AMAD'), mx AS (SELECT max(abs(x)) AS m FROM pct), st AS (SELECT m, pow(10.0, floor(log10(m / 3))) AS p, m / 3 / pow(10.0, floor(log10(m / 3))) AS q FROM mx), ax AS (SELECT ceil(m / (p * f)) * p * f AS lim FROM (SELECT *, CASE WHEN q < 1.5 THEN 1 WHEN q < 3 THEN 2 WHEN q < 7 THEN 5 ELSE 10 END AS f FROM st))
SELECT bin, {r('bin * lim * 2 / 36 - lim', 6)} AS low, {r('(bin + 1) * lim * 2 / 36 - lim', 6)} AS high, count(*) AS n FROM (SELECT CAST(least(greatest(floor((x + lim) / (lim * 2 / 36)), 0), 35) AS INTEGER) AS bin, lim FROM pct, ax) GROUP BY bin, lim""",
    "paired_universe_diff": f"""WITH {UNIVERSE}, reb12 AS MATERIALIZED (SELECT CAST(c.k AS INTEGER) AS rid, c.month, c.eff, c.hold_end, a.month AS m0, b.month AS m1 FROM cal c JOIN cal a ON a.k = c.k - 12 JOIN cal b ON b.k = c.k - 1), {audits('audit12', 'reb12')},
x AS (SELECT eff AS "EffectiveDate", asset AS "Price_Ticker" FROM audit WHERE known AND available = required), y AS (SELECT eff AS "EffectiveDate", asset AS "Price_Ticker" FROM audit12 WHERE known AND available = required)
SELECT *, 'left' AS side FROM (SELECT * FROM x EXCEPT ALL SELECT * FROM y) UNION ALL SELECT *, 'right' FROM (SELECT * FROM y EXCEPT ALL SELECT * FROM x)""",
}

_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
ORACLES["panel_wide"] = f'WITH {TX} SELECT date AS "Date", ' + ", ".join(f"""max(price) FILTER (asset = '{t}') AS "{t}\"""" for t in _TYPES) + " FROM tx GROUP BY 1"
ORACLES["dampened_ranges"] = ORACLES["dampened_daily"]
ORACLES["daily_cov_blocks"] = ORACLES["daily_cov"]
ORACLES["drawdown_ranges"] = ORACLES["drawdown"]
ORACLES["mst_edges_rounds"] = f"WITH {FIXED}, {network(False, '')} SELECT month, i, j, {r('d')} AS distance FROM edge JOIN reb USING (rid)"
ORACLES["tree_messages"] = f"""WITH {FIXED}, {network(False, '')} SELECT month, asset, {r('weight')} AS weight, {r('xi')} AS centrality,
  (SELECT count(*) FROM edge e WHERE e.rid = n.rid AND (e.i = n.asset OR e.j = n.asset)) AS degree, {r('"lambda"')} AS radius FROM node n JOIN top USING (rid) JOIN reb USING (rid)"""
ORACLES["common_dates"] = f"""WITH {UNIVERSE}, {HISTORY_PIT}, com AS MATERIALIZED (SELECT DISTINCT rid, date FROM obs), placed AS (SELECT c.*, reb.m0, reb.eff,
  count(*) OVER (PARTITION BY rid) AS common, count(*) FILTER (c.date < m0) OVER (PARTITION BY rid ORDER BY c.date DESC) AS nth FROM com c JOIN reb USING (rid))
SELECT eff AS "EffectiveDate", date, common FROM placed WHERE date >= m0 OR nth <= 63"""
ORACLES["benchmark_aligned"] = f"""WITH {PX}, {calendar('px')}, {BX}, hol AS (SELECT * FROM bx WHERE day(date) > 7 AND dayofyear(date) % 13 <> 0),
asked AS (SELECT DISTINCT date FROM px WHERE date >= (SELECT min(eff) FROM reb)), dated AS (SELECT date FROM asked UNION SELECT max(date) FROM hol WHERE date < (SELECT min(date) FROM asked)),
priced AS (SELECT d.date, s.price FROM dated d ASOF LEFT JOIN hol s ON s.date <= d.date), moved AS (SELECT date, price / lag(price) OVER (ORDER BY date) - 1 AS x FROM priced),
out AS (SELECT date, x, exp(sum(ln(1 + x)) OVER (ORDER BY date)) AS value FROM moved WHERE date IN (SELECT date FROM asked))
SELECT date AS "Date", {r('x')} AS "GrossReturn", 0.0 :: DOUBLE AS "TransactionCost", {r('x')} AS "NetReturn", {r('value')} AS "GrossValue", {r('value')} AS "NetValue" FROM out"""
ORACLES["membership_records"] = f"""WITH {PX}, {MEMB}, numbered AS (SELECT *, row_number() OVER (ORDER BY asset) - 1 AS k FROM memb),
lines AS (SELECT k, CASE k % 7 WHEN 1 THEN 'soon' WHEN 5 THEN '' ELSE CAST(start AS VARCHAR) END AS a, CASE k % 7 WHEN 2 THEN '1990-01-01' ELSE coalesce(CAST(end_excl AS VARCHAR), '') END AS b, CASE k % 7 WHEN 3 THEN '' ELSE asset END AS c FROM numbered)
SELECT k + 2 AS line, CASE k % 7 WHEN 1 THEN 'not a date' WHEN 2 THEN 'ends before it starts' WHEN 3 THEN 'no ticker' WHEN 4 THEN 'fields' ELSE 'no start' END AS reason,
  a || ',' || b || ',' || c || CASE WHEN k % 7 = 4 THEN ',more' ELSE '' END AS record FROM lines WHERE k % 7 BETWEEN 1 AND 5"""

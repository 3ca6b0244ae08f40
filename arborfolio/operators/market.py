"""Returns, dampening, realized covariances and the month calendar.

Functions with `check` validate their whole input first, by one aggregate, and raise DataValidationError. Without it
nothing is run: a return whose price before is zero is left out, and holes shorten frames and sums.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborfolio.config import EPSILON, CalculationError, DampenConfig, DataValidationError, make_dampen_config
from arborfolio.functions.columns import capped, month_of, ratio
from arborfolio.operators.checks import validate_close_prices, validate_dampening_input, validate_returns
from arborfolio.operators.scan import numbered
from arborfolio.operators.sliding import by_time_range, sliding_medians


def _before(column: str) -> Column:
    return F.lag(column).over(Window.partitionBy("asset").orderBy("date"))


def simple_returns(panel: DataFrame) -> DataFrame:
    r = ratio(F.col("price"), _before("price")) - 1
    return panel.select("date", "asset", r.alias("r")).filter(F.col("r").isNotNull())


def log_returns(panel: DataFrame, check: bool = True) -> DataFrame:
    """check: the panel is complete and its prices are finite and positive."""
    if check:
        validate_close_prices(panel)
    r = F.log(ratio(F.col("price"), _before("price")))
    return panel.select("date", "asset", r.alias("r")).filter(F.col("r").isNotNull())


def _middle(values: Column) -> Column:
    """The median of a sorted array."""
    n = F.size(values)
    return (F.element_at(values, ((n + 1) / 2).cast("int")) + F.element_at(values, (n / 2).cast("int") + 1)) / 2


def trailing_median(returns: DataFrame, config: DampenConfig | dict | None = None, keys: tuple[str, ...] = ("asset",), block_rows: int | None = None) -> DataFrame:
    """Adds med and mad of the window rows that end at each row; null where the frame is shorter. block_rows: as for dampen()."""
    window = make_dampen_config(config).window
    none = F.lit(None).cast("double")
    wide = returns.withColumn("med", none).withColumn("mad", none)

    def medians(rows: pd.DataFrame) -> pd.DataFrame:
        med, mad = sliding_medians(rows["r"].to_numpy(float), window)
        short = [None] * (len(rows) - len(med))
        return rows.assign(med=pd.array([*short, *med], "Float64"), mad=pd.array([*short, *mad], "Float64"))

    if block_rows is not None:
        return by_time_range(wide, keys, block_rows, window - 1, medians)
    return wide.groupBy(*keys).applyInPandas(lambda rows: medians(rows.sort_values("date")), wide.schema)


def dampen_native(returns: DataFrame, config: DampenConfig | dict | None = None, keys: tuple[str, ...] = ("asset",)) -> DataFrame:
    """dampen() by window functions: every row sorts its own frame, which costs much more than the kernel."""
    config = make_dampen_config(config)
    frame = Window.partitionBy(*keys).orderBy("date").rowsBetween(1 - config.window, 0)
    rows = returns.withColumn("frame", F.array_sort(F.collect_list("r").over(frame)))
    rows = rows.withColumn("med", F.when(F.size("frame") == config.window, _middle(F.col("frame"))))
    spread = F.array_sort(F.transform("frame", lambda x: F.abs(x - F.col("med"))))
    rows = rows.withColumn("mad", F.when(F.col("med").isNotNull(), _middle(spread)))
    r = F.when(F.col("med").isNull(), F.col("r")).otherwise(capped(F.col("med"), F.col("mad"), F.col("r"), config.threshold))
    return rows.withColumn("r", r).drop("med", "mad", "frame")


def dampen(returns: DataFrame, config: DampenConfig | dict | None = None, keys: tuple[str, ...] = ("asset",), check: bool = True, block_rows: int | None = None) -> DataFrame:
    """The same rows, r drawn towards its trailing median where it is far away. Frames hold the raw series. A group is the
    series of one asset, which has a row per date; with block_rows it is a time range of about so many rows of it, with the
    window - 1 rows before them."""
    config = make_dampen_config(config)
    if check:
        validate_dampening_input(returns)

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.assign(r=dampen_series(rows["r"].to_numpy(float), config))

    if block_rows is not None:
        return by_time_range(returns, keys, block_rows, config.window - 1, draw)
    return returns.groupBy(*keys).applyInPandas(lambda rows: draw(rows.sort_values("date")), returns.schema)


def dampen_series(r: np.ndarray, config: DampenConfig) -> np.ndarray:
    w, out = config.window, r.copy()
    med, mad = sliding_medians(r, w)
    off = r[w - 1 :] - med
    far = (mad > EPSILON) & (np.abs(off) > config.threshold * mad)
    z = np.abs(off[far]) / mad[far]
    out[w - 1 :][far] = med[far] + np.sign(off[far]) * mad[far] * (config.threshold + np.log(np.maximum(z - (config.threshold - 1), 1)))
    return out


def dampen_matrix(r: np.ndarray, config: DampenConfig) -> np.ndarray:
    """Columns are assets."""
    return np.stack([dampen_series(x, config) for x in r.T], axis=1) if r.size else r.copy()


def monthly_realized_cov(returns: DataFrame, check: bool = True) -> DataFrame:
    """Rows month, i, j (i <= j), cov: sums of products of returns, not demeaned."""
    if check:
        validate_returns(returns)
    a = returns.select("date", F.col("asset").alias("i"), F.col("r").alias("x"))
    b = returns.select("date", F.col("asset").alias("j"), F.col("r").alias("y"))
    pairs = a.join(b, "date").filter("i <= j")
    return pairs.groupBy(month_of(F.col("date")).alias("month"), "i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("cov"))


def window_cov(monthly: DataFrame, months: int) -> DataFrame:
    """Rows month, i, j, cov: sums over the given number of months before each month that has so many."""
    index = numbered(monthly, "month")
    rows = monthly.join(F.broadcast(index), "month")  # a row per month
    frame = Window.partitionBy("i", "j").orderBy("k").rangeBetween(-months, -1)
    return rows.withColumn("cov", F.sum("cov").over(frame)).filter(F.col("k") > months).select("month", "i", "j", "cov")


def correlation(cov: DataFrame, key: str = "month", check: bool = True) -> DataFrame:
    """Rows key, i, j (i < j), rho, distance (1 - rho squared). Without check both are null where a variance is zero."""
    if check and (bad := cov.filter(f"i = j and (cov <= {EPSILON} or isnan(cov) or cov is null)").limit(1).collect()):
        raise CalculationError("a variance is zero", asset=bad[0].i)
    variance = cov.filter("i = j").select(key, F.col("i").alias("v"), F.col("cov").alias("var"))
    left, right = variance.select(key, F.col("v").alias("i"), F.col("var").alias("vi")), variance.select(key, F.col("v").alias("j"), F.col("var").alias("vj"))
    rows = cov.filter("i < j").join(left, [key, "i"]).join(right, [key, "j"])
    raw = ratio(F.col("cov"), F.sqrt(F.col("vi") * F.col("vj")))
    rho = F.when(raw.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw)))
    return rows.select(key, "i", "j", rho.alias("rho")).withColumn("distance", 1 - F.col("rho") * F.col("rho"))


def month_calendar(dates: DataFrame) -> DataFrame:
    """Rows k, Month, EffectiveDate, HoldingEndDate of the months that have dates."""
    months = dates.select("date").distinct().groupBy(month_of(F.col("date")).alias("Month")).agg(F.min("date").alias("EffectiveDate"), F.max("date").alias("HoldingEndDate"))
    rows = months.agg(F.array_sort(F.collect_list(F.struct("Month", "EffectiveDate", "HoldingEndDate"))).alias("m"))  # a row per month
    return rows.select(F.posexplode("m").alias("k", "x")).select("x.*", (F.col("k") + 1).alias("k"))


def combine_panels(base: DataFrame, supplemental: DataFrame) -> DataFrame:
    """Base rows and, on the base's dates, the supplemental's. A date that the supplemental lacks has no cell, which
    counts as a missing price wherever the base's calendar is asked for."""
    both = base.select("asset").distinct().intersect(supplemental.select("asset").distinct())
    if names := [r.asset for r in both.limit(20).collect()]:
        raise DataValidationError("assets are in both panels", assets=names)
    extra = supplemental.join(base.select("date").distinct(), "date", "left_semi")
    if not extra.filter("price is not null").limit(1).count():
        raise DataValidationError("the panels have no date in common")
    return base.select("date", "asset", "price").unionByName(extra.select("date", "asset", "price"))

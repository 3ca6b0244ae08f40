"""Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lossy_double(c: Column) -> Column:
    """As a double; null if it isn't a number (bad texts, NaN)."""
    return F.nanvl(c.try_cast("double"), F.lit(None).cast("double"))


def lenient_date(c: Column) -> Column:
    """The date in the first ten characters (yyyy-MM-dd), or null."""
    return F.try_to_date(F.substring(c.cast("string"), 1, 10), "yyyy-MM-dd") if hasattr(F, "try_to_date") else F.to_date(F.try_to_timestamp(F.substring(c.cast("string"), 1, 10), F.lit("yyyy-MM-dd")))


def not_finite(c: Column) -> Column:
    return F.isnan(c) | (F.abs(c) == float("inf"))


def month_of(c: Column) -> Column:
    return F.trunc(c, "MM")


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


def rounded(c: Column, digits: int = 8) -> Column:
    """Rounded, without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def capped(median: Column, mad: Column, r: Column, threshold: float) -> Column:
    """r, drawn towards the median where it is more than threshold deviations away."""
    z = ratio(F.abs(r - median), mad)
    drawn = median + F.signum(r - median) * mad * (threshold + F.log(F.greatest(z - (threshold - 1), F.lit(1.0))))
    return F.when((mad > 1e-12) & (F.abs(r - median) > threshold * mad), drawn).otherwise(r)

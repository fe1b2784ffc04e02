"""Null-safe arithmetic on columns.  Nodata is NULL, never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def safe_divide(a, b) -> Column:
    """a / b, and 0 where b is 0; NULL where b, or a with another b, is NULL."""
    a, b = as_col(a), as_col(b)
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def clip(x: Column, low, high) -> Column:
    """x within [low, high]; NULL stays NULL (least and greatest would skip it)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, as_col(low)), as_col(high)))


def finite(x: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def at_least(x, low) -> Column:
    """The larger of both; NULL if x is NULL."""
    x = as_col(x)
    return F.when(x.isNotNull(), F.greatest(x, as_col(low)))

"""Null-safe scalar expressions.

Engine invariant: missing is SQL NULL. NaN becomes NULL at every source,
division by zero is NULL (``try_divide``), bad text is NULL (``try_cast``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: str | Column) -> Column:
    c = col(c)
    return F.when(~F.isnan(c), c)


def to_double(c: str | Column) -> Column:
    """Numeric coercion, bad values to NULL (pd.to_numeric(errors='coerce'))."""
    c = col(c)
    return nan_to_null(c.try_cast("double"))


def safe_div(a: Column, b: Column) -> Column:
    """a / b with NULL for a zero or NULL divisor (never +-inf, never an error)."""
    return F.try_divide(a, b)


def clip(c: str | Column, lower: Column, upper: Column) -> Column:
    """Clip into [lower, upper]; NULL stays NULL (greatest/least skip NULLs)."""
    c = col(c)
    return F.when(c.isNotNull(), F.greatest(lower, F.least(upper, c)))


def bool_int(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


def iso_ts(c: str | Column) -> Column:
    """ISO-8601 text with microseconds (stable across engines)."""
    return F.date_format(col(c), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")

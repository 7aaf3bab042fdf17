"""Scalar and aggregate column functions with explicit rules for missing values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def climate_band(score: str | Column) -> Column:
    """Low up to 1, Medium up to 2, High up to 5, otherwise NULL."""
    s = _c(score)
    return F.when(s <= 1, "Low").when(s <= 2, "Medium").when(s <= 5, "High")


def yes_flag(col: str | Column) -> Column:
    """1 for "Yes", 0 for any other text, NULL stays NULL."""
    return (_c(col) == "Yes").cast("int")


def default_zero(col: str | Column) -> Column:
    return F.coalesce(_c(col), F.lit(0))


def to_event_date(col: str | Column) -> Column:
    return F.to_date(_c(col))


def in_set(col: str | Column, values) -> Column:
    """Membership that is never NULL: a missing value belongs to no set."""
    return F.coalesce(_c(col).isin(*values), F.lit(False))


def is_text(col: str | Column) -> Column:
    """Neither NULL nor the text "NA"."""
    c = _c(col)
    return c.isNotNull() & (c != "NA")


def n_distinct(col: str | Column) -> Column:
    """Distinct count in which a missing value counts as one more value."""
    c = _c(col)
    return F.count_distinct(c) + F.coalesce(F.max(c.isNull().cast("int")), F.lit(0))


def strict_mean(col: str | Column) -> Column:
    """Mean that is NULL as soon as one value is missing."""
    c = _c(col)
    return F.when(F.count(c) == F.count(F.lit(1)), F.avg(c))


def strict_sum(col: str | Column) -> Column:
    """Sum that is NULL as soon as one value is missing."""
    c = _c(col)
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))

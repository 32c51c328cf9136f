"""Numeric expressions shared by operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: str | Column) -> Column:
    """The value, or null where it is NaN or infinite."""
    c = F.col(c) if isinstance(c, str) else c
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def measurement(c: str | Column) -> Column:
    """A measurement: null for null, NaN, infinite and values that aren't positive (-999 marks a missing one)."""
    v = finite(c)
    return F.when(v > 0, v)


def decimal_comma(c: str | Column) -> Column:
    """Text to double, a comma counting as decimal point; null where it isn't a number, ``NaN`` included."""
    c = F.col(c) if isinstance(c, str) else c
    return finite(F.replace(F.trim(c.cast("string")), F.lit(","), F.lit(".")).try_cast("double"))

"""Scaling numbers to the unit interval and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INTEGERS = ("tinyint", "smallint", "int", "bigint")


def scale(column: Column, low: float, span: float) -> Column:
    """``(x - low) / span``; values outside the fitted range fall outside [0, 1]."""
    if span == 0:
        raise ValueError("a range of one value cannot be scaled to; drop the column or keep it as it is")
    return (column.cast("double") - F.lit(float(low))) / F.lit(float(span))


def unscale(column: Column, low: float, span: float, dtype: str) -> Column:
    """Undo :func:`scale` and return to the source type.

    A cast to an integer truncates. Float noise is rounded off first, so that an
    integer that was scaled comes back as itself.
    """
    value = column * F.lit(float(span)) + F.lit(float(low))
    return (F.round(value, 6) if dtype in INTEGERS else value).cast(dtype)


def cycle_scale(column: Column, low: float = 0, cycle: float = 1440) -> Column:
    """A time on a cycle (by default minutes of a day) as a share of the cycle."""
    if cycle <= 0:
        raise ValueError(f"give the cycle a positive length instead of {cycle}")
    return scale(column, low, cycle)


def cycle_unscale(column: Column, dtype: str, low: float = 0, cycle: float = 1440) -> Column:
    if cycle <= 0:
        raise ValueError(f"give the cycle a positive length instead of {cycle}")
    return unscale(column, low, cycle, dtype)

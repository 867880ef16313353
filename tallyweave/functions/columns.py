"""Naming helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(name: str) -> Column:
    """A top-level column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def text(column: Column, null: str = "null") -> Column:
    """The value as display text, nulls spelled out."""
    return F.coalesce(column.cast("string"), F.lit(null))

"""The registry the query modules add themselves to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DIGITS = 9


def query(sql: str | None = None):
    """Register a function of (spark, folder) under its own name."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(column: Column | str) -> Column:
    """Sums of doubles depend on their order beyond about twelve digits."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column, DIGITS)


def round_doubles(df: DataFrame) -> DataFrame:
    doubles = [name for name, kind in df.dtypes if kind == "double"]
    return df.withColumns({name: rounded(name) for name in doubles}) if doubles else df

"""Tables laid out in buckets of a key, so that pairing and checking them moves no row.

A bucket is one sorted file. Tables with the same key and number of buckets are joined bucket by bucket, each in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions.columns import col

#: Rows of the other side that an error names.
SHOWN = 10


def store(df: DataFrame, name: str, path: str, key: str, buckets: int) -> DataFrame:
    """Write the rows below ``path`` in buckets of ``key``, as table ``name`` of the session; it must not exist.

    They are shuffled once, by the hash that Spark puts them into buckets by, so that each bucket is one file.
    """
    dealt = df.repartition(buckets, col(key))
    dealt.write.bucketBy(buckets, key).sortBy(key).option("path", path).mode("error").saveAsTable(name)
    return df.sparkSession.table(name)


def open_stored(spark: SparkSession, name: str, path: str, key: str, buckets: int) -> DataFrame:
    """Rows that :func:`store` wrote, as table ``name`` of another session."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    spark.sql(
        f"CREATE TABLE `{name}` ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`)"
        f" INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return spark.table(name)


def _sides(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows per key in each table; a null key is one that the other table cannot have."""
    count = F.count(F.lit(1))
    ours = left.groupBy(col(key)).agg(count.alias("__left"))
    theirs = right.groupBy(col(key)).agg(count.alias("__right"))
    return ours.hint("merge").join(theirs, key, "full").fillna(0, ["__left", "__right"])


def key_gaps(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that one table only has, with the ``side`` (facts or lookup) that has them."""
    side = F.when(F.col("__right") == 0, "facts").when(F.col("__left") == 0, "lookup")
    return _sides(left, right, key).select(col(key), side.alias("side")).where("side is not null")


def pair(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Join two stored tables row by row on a key that both must hold exactly once."""
    odd = _sides(left, right, key).where("__left <> 1 or __right <> 1").take(SHOWN)
    if odd:
        raise ValueError(f"rows do not pair up, for example {[tuple(r) for r in odd]}")
    return left.hint("merge").join(right, key)


def paired(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The rows of both stored tables whose key both hold, where each must hold it once; the others are left out."""
    twice = _sides(left, right, key).where("__left > 1 or __right > 1").take(SHOWN)
    if twice:
        raise ValueError(f"keys repeat, for example {[tuple(r) for r in twice]}")
    return left.hint("merge").join(right, key)

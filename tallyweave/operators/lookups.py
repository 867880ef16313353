"""Lookups and key checks.

A lookup is broadcast only when a pass over it shows that it is small, in rows and
in bytes. Beyond that, the rows of the most frequent keys (a fixed number of keys, found by counting) take
a broadcast of their few lookup rows, and the rest is joined by shuffling, where
no key can be hot any more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.columns import col

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 << 20
HOT_KEYS = 1_000


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes the values of a row take: texts by length, nested values as JSON."""
    total = F.lit(8 * len(df.columns))
    for field in df.schema:
        kind, column = field.dataType.typeName(), col(field.name)
        if kind in ("string", "char", "varchar", "binary"):
            total += F.coalesce(F.octet_length(column), F.lit(0))
        elif kind in ("array", "map", "struct", "variant"):
            total += F.octet_length(F.to_json(F.struct(column)))
    return total.cast("bigint")


def checked_size(lookup: DataFrame, key: str) -> tuple[int, int]:
    """Rows and bytes of a lookup, whose keys must be unique; null keys match nothing and may repeat."""
    per_key = lookup.where(col(key).isNotNull()).groupBy(col(key)).agg(
        F.count(F.lit(1)).alias("__n"), F.sum(row_bytes(lookup)).alias("__bytes")
    )
    got = per_key.agg(F.sum("__n"), F.sum("__bytes"), F.max("__n")).first()
    rows, size, most = (n or 0 for n in got)
    if most > 1:
        raise ValueError(f"lookup key {key!r} is not unique")
    return rows, size


def look_up(
    df: DataFrame, lookup: DataFrame, key: str, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Left join on ``key``: adds the lookup's other columns behind those of ``df``, null where unmatched."""
    lookup = lookup.where(col(key).isNotNull())
    rows, size = checked_size(lookup, key)
    if rows <= broadcast_rows and size <= BROADCAST_BYTES:
        added = [c for c in lookup.columns if c != key]
        joined = df.join(F.broadcast(lookup), key, "left")
        return joined.select(*map(col, df.columns), *map(col, added))
    hot = (
        df.where(col(key).isNotNull())
        .groupBy(col(key))
        .agg(F.count(F.lit(1)).alias("__n"))
        .orderBy(F.desc("__n"), col(key))
        .limit(HOT_KEYS)
        .select(col(key))
    )
    return split_join(df, lookup, key, hot)


def split_join(df: DataFrame, lookup: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Left join of a large lookup, with the at most ``HOT_KEYS`` keys in ``hot`` broadcast."""
    added = [c for c in lookup.columns if c != key]
    few = hot.limit(HOT_KEYS)
    matched = lookup.join(F.broadcast(few), key, "left_semi").select(
        col(key), F.struct(*map(col, added)).alias("__few")
    )
    hot_rows = few.join(F.broadcast(matched), key, "left").withColumnRenamed(key, "__hot")
    # Always 0, but not a literal: the optimizer would take that out of the join keys.
    zero = F.pmod(F.xxhash64(col(key)), F.lit(1)).cast("int")
    rest = lookup.select(
        col(key).alias("__key"),
        zero.alias("__spread"),
        F.struct(*map(col, added)).alias("__many"),
    )
    first = df.join(F.broadcast(hot_rows), col(key) == F.col("__hot"), "left")
    # Rows already served (and null keys) match nothing and are dealt out evenly: by their
    # values, and by where they are read, since a third of them may be the same.
    served = F.col("__hot").isNotNull() | col(key).isNull()
    place = F.pmod(F.xxhash64(F.spark_partition_id(), *map(col, df.columns)), F.lit(4096))
    dealt = first.withColumns(
        {
            "__key": F.when(~served, col(key)),
            "__spread": F.when(served, place).otherwise(0).cast("int"),
        }
    )
    joined = dealt.join(rest, ["__key", "__spread"], "left")
    found = F.coalesce("__few", "__many")
    return joined.select(
        *map(col, df.columns), *[found.getField(c).alias(c) for c in added]
    )


def _key_sides(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows per key in each table."""
    sides = left.select(col(key), F.lit(1).alias("__l"), F.lit(0).alias("__r")).unionByName(
        right.select(col(key), F.lit(0).alias("__l"), F.lit(1).alias("__r"))
    )
    return sides.groupBy(col(key)).agg(F.sum("__l").alias("__left"), F.sum("__r").alias("__right"))


def key_gaps(facts: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """Keys found in one table only, with the ``side`` that has them; empty means covered."""
    side = F.when(F.col("__right") == 0, "facts").when(F.col("__left") == 0, "lookup")
    sides = _key_sides(facts, lookup, key).select(col(key), side.alias("side"))
    return sides.where(F.col("side").isNotNull())


def require_same_keys(facts: DataFrame, lookup: DataFrame, key: str) -> None:
    found = key_gaps(facts, lookup, key).take(10)
    if found:
        raise ValueError(f"keys of the two tables differ, for example {[tuple(r) for r in found]}")


def pair(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Join two tables row by row on a key that both must hold exactly once."""
    odd = _key_sides(left, right, key).where((F.col("__left") != 1) | (F.col("__right") != 1))
    found = odd.take(10)
    if found:
        raise ValueError(f"rows do not pair up, for example {[tuple(r) for r in found]}")
    return left.join(right, key)

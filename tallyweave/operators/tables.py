"""Choosing, renaming and checking columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.columns import col
from tallyweave.session import cut_lineage

# Identifier columns that are never encoded.
IDENTIFIERS = ("pid", "iid", "hid")


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{missing} not found; the table has {df.columns}")


def require_same_columns(left: DataFrame, right: DataFrame) -> None:
    """Both tables must have the same set of columns; the error lists the difference."""
    difference = set(left.columns) ^ set(right.columns)
    if difference:
        raise ValueError(f"the columns of the tables differ; add or drop {sorted(difference)}")


def require_numeric(df: DataFrame, columns: Sequence[str]) -> None:
    numeric = {"byte", "short", "integer", "long", "float", "double", "decimal"}
    require_columns(df, columns)
    wrong = [c for c in columns if df.schema[c].dataType.typeName() not in numeric]
    if wrong:
        raise ValueError(f"cast {wrong} to a numeric type, or treat them as categorical")


def rename_select(df: DataFrame, columns: Mapping[str, str] | None = None) -> DataFrame:
    """Keep the mapped columns under their new names, in the map's order; no map keeps all."""
    if not columns:
        return df
    require_columns(df, list(columns))
    return df.select([col(old).alias(new) for old, new in columns.items()])


def split_columns(df: DataFrame, controls: Sequence[str]) -> tuple[list[str], list[str]]:
    """Names of the controls and of the features, all the other columns."""
    require_columns(df, controls)
    return list(controls), [c for c in df.columns if c not in controls]


def encodable_columns(
    columns: Sequence[str],
    include: Sequence[str] | None = None,
    exclude: Sequence[str] | None = None,
) -> list[str]:
    """All columns but identifiers, then only the included ones, then without the excluded."""
    kept = [
        c
        for c in columns
        if c not in IDENTIFIERS
        and (include is None or c in include)
        and (exclude is None or c not in exclude)
    ]
    if not kept:
        raise ValueError("no columns are left; include one that is no identifier, or exclude fewer")
    return kept


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)


def with_row_ids(df: DataFrame, order_by: Sequence, name: str = "pid") -> DataFrame:
    """Number the rows 0..N-1 in the order of ``order_by``.

    Rows are range-partitioned and sorted once, and written to the shared folder
    so that their places stay fixed; a row's number is its place in the
    partition plus the sizes of the partitions before. No task sees more than its
    own range; rows that are equal in all columns share one. Give it only the columns that are needed.
    """
    # Rows that are equal in ``order_by`` are told apart by what else they hold.
    order = [*order_by, F.xxhash64(*map(col, df.columns))]
    ordered = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order))
    # monotonically_increasing_id is the partition above bit 33 and the place below.
    place = F.monotonically_increasing_id()
    placed = ordered.withColumn("__place", place).withColumn(
        "__part", F.shiftright("__place", 33).cast("int")
    )
    # One entry per partition, summed on the driver.
    starts, rows = {}, 0
    for part, n in sorted(placed.groupBy("__part").count().collect()):
        starts[part] = rows
        rows += n
    # As many rows as partitions.
    table = df.sparkSession.createDataFrame(list(starts.items()), "__part int, __start bigint")
    within = F.col("__place").bitwiseAND(F.lit((1 << 33) - 1).cast("long"))
    return placed.join(F.broadcast(table), "__part").select(
        (within + F.col("__start")).alias(name), *[col(c) for c in df.columns]
    )

"""What the operators of this subpackage share: words, row keys and stored tables."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.session import scratch

#: Between alphanumeric words, after A-Z has been lower-cased.
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Between words that white space separates.
SPACES = r"[\x20\x09-\x0D]+"


def lowered(text: Column) -> Column:
    """``text`` with A-Z in lower case and every other character as it is.

    ``lower`` does that to pure ASCII text several times faster than ``translate``.
    """
    ascii_only = F.octet_length(text) == F.char_length(text)
    upper = string.ascii_uppercase
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


#: Rows of a table that is broadcast, and bytes of its values that have no fixed size.
SMALL, SMALL_BYTES = 200_000, 16_000_000


def alnum_words(text: Column) -> Column:
    """Words of ASCII letters, digits and all non-ASCII characters, A-Z lowered; none for null."""
    return F.array_remove(F.split(lowered(F.coalesce(text, F.lit(""))), NOT_ALNUM), "")


def space_words(text: Column) -> Column:
    """Words between white space; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def keyed(docs: DataFrame) -> DataFrame:
    """With ``doc``, a key that is never null and so serves plain equality joins.

    Rows that are equal in id and text are one document.
    """
    known = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return docs.withColumn(
        "doc", F.struct(known.alias("id"), F.col("doc_id").isNull().alias("no_id"), F.xxhash64("text").alias("text"))
    )


def stored(df: DataFrame, paths: list[str] | None = None) -> DataFrame:
    """``df`` written to the shared folder and read from there.

    Cuts the lineage, so that a lost executor costs a read and not the work before
    it. The files go when the session ends, or before if the folder, which is added to ``paths``, is removed.
    """
    spark = df.sparkSession
    path = scratch(spark, "llm")
    df.write.parquet(path)
    if paths is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def running(df: DataFrame, group: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` in the rows of its group that come before it in ``order``, which has no ties.

    Rows are dealt out by ranges of group and order and the sums of ranges added up, so a group of most rows is
    not one task. ``value`` is a whole number, so that sums do not depend on the ranges.
    """
    by = [*group, *order]
    placed = stored(df.repartitionByRange(*by).withColumn("__part", F.spark_partition_id()))
    sums = placed.groupBy("__part", *group).agg(F.sum(value).alias("__sum"))
    earlier = Window.unboundedPreceding, -1
    # A row for each range and group in it.
    parts = Window.partitionBy(*group).orderBy("__part") if group else Window.orderBy("__part")
    begin = F.coalesce(F.sum("__sum").over(parts.rowsBetween(*earlier)), F.lit(0))
    begins = stored(sums.withColumn("__begin", begin).drop("__sum"))
    within = Window.partitionBy("__part", *group).orderBy(*order).rowsBetween(*earlier)
    inner = placed.withColumn("__inner", F.coalesce(F.sum(value).over(within), F.lit(0)))
    summed = (F.col("__begin") + F.col("__inner")).alias(name)
    return inner.join(begins, ["__part", *group]).select(*df.columns, summed)


def if_small(df: DataFrame, *sizes: Column) -> DataFrame:
    """``df``, stored, and marked for broadcast if its rows and its ``sizes`` in bytes are few enough in all.

    Beyond that, a join with it is Spark's to plan.
    """
    df = stored(df)
    rows, *sums = df.agg(F.count("*"), *[F.sum(size) for size in sizes]).first()
    return F.broadcast(df) if rows <= SMALL and sum(n or 0 for n in sums) <= SMALL_BYTES else df


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` without the documents whose key ``doc`` is in ``dropped``."""
    dropped = if_small(dropped.select("doc").distinct(), F.octet_length("doc.id"))
    return keyed(docs).join(dropped, "doc", "left_anti").select(docs.columns)

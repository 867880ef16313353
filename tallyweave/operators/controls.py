"""Control totals from a population projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.columns import col
from tallyweave.functions.recode import AGE_BANDS, SEX_CODES, null_count, recode
from tallyweave.operators.lookups import look_up, require_same_keys

CONTROLS = ("zone", "region", "sex", "age_group")


def recode_projection(
    projection: DataFrame, zone_regions: DataFrame, check_zones: bool = True
) -> DataFrame:
    """``geogcode, Gender, Age, value`` rows as ``zone, region, sex, age_group, value``.

    ``zone_regions`` holds ``zone, region``. With ``check_zones`` both tables must
    have the same zones.
    """
    zoned = projection.select(
        F.col("geogcode").alias("zone"),
        recode(F.col("Gender"), SEX_CODES).alias("sex"),
        recode(F.col("Age"), AGE_BANDS).alias("age_group"),
        F.col("value").cast("bigint").alias("value"),
    )
    if check_zones:
        require_same_keys(zoned, zone_regions, "zone")
    return look_up(zoned, zone_regions, "zone").select(*CONTROLS, "value")


def unmapped(recoded: DataFrame) -> DataFrame:
    """Nulls per control after the recodes."""
    return recoded.agg(*[null_count(col(c)).alias(c) for c in CONTROLS])


def control_totals(recoded: DataFrame) -> DataFrame:
    """One row per zone, region, sex and age group."""
    return recoded.groupBy(*CONTROLS).agg(F.sum("value").alias("value"))


def expand_controls(
    totals: DataFrame, count: str = "value", number: str = "person", chunk: int = 10_000
) -> DataFrame:
    """One row per counted person, numbered from 1 within its row of totals (one per group).

    A large count is first cut into chunks that are dealt out over the cluster,
    so that no task writes out a whole city.
    """
    keys = [col(c) for c in totals.columns if c != count]
    n = col(count).cast("bigint")
    partitions = int(totals.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    firsts = F.sequence(F.lit(1).cast("bigint"), n, F.lit(chunk).cast("bigint"))
    chunks = totals.where(n > 0).select(
        *keys, n.alias("__n"), F.explode(firsts).alias("__from")
    )
    dealt = chunks.repartition(partitions, *keys, F.col("__from"))
    last = F.least(F.col("__from") + (chunk - 1), F.col("__n"))
    return dealt.select(*keys, F.explode(F.sequence(F.col("__from"), last)).alias(number))

"""Renames, lookups, recodes and control totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.functions.recode import AGE_BANDS, apply_labels, null_count, recode, zero_if_null
from tallyweave.operators import controls, lookups, tables
from tallyweave.queries.registry import query, table

PERSON = {
    "c_custkey": "pid",
    "c_mktsegment": "segment",
    "c_nationkey": "zone",
    "c_acctbal": "balance",
}


def persons(spark, folder):
    return tables.rename_select(table(spark, folder, "customer"), PERSON)


@query(
    """SELECT c_custkey AS pid, c_mktsegment AS segment, c_nationkey AS zone,
        c_acctbal AS balance FROM customer"""
)
def rename_select(spark, folder):
    return persons(spark, folder)


@query(
    """SELECT c_nationkey AS zone, c_mktsegment AS segment, c_acctbal AS balance FROM customer"""
)
def split_controls(spark, folder):
    """Controls first, then the features that can be encoded."""
    df = persons(spark, folder)
    ys, xs = tables.split_columns(df, ["zone", "segment"])
    return df.select(*ys, *tables.encodable_columns(xs))


def zone_regions(spark, folder):
    regions = table(spark, folder, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return lookups.look_up(table(spark, folder, "nation"), regions, "n_regionkey").select(
        F.col("n_nationkey").alias("zone"), F.col("r_name").alias("region")
    )


@query(
    """SELECT c_custkey AS pid, c_nationkey AS zone, r_name AS region FROM customer
    LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"""
)
def zone_region_lookup(spark, folder):
    df = persons(spark, folder).select("pid", "zone")
    return lookups.look_up(df, zone_regions(spark, folder), "zone")


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, p_brand, p_size FROM lineitem
    LEFT JOIN part ON l_partkey = p_partkey"""
)
def large_lookup(spark, folder):
    """The way of a lookup too large to broadcast: frequent keys apart from the rest."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    parts = table(spark, folder, "part").select(
        F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size"
    )
    return lookups.look_up(lines, parts, "l_partkey", broadcast_rows=0)


@query(
    """SELECT l_orderkey AS key, 'facts' AS side FROM
        (SELECT DISTINCT l_orderkey FROM lineitem) l
        ANTI JOIN orders ON l_orderkey = o_orderkey
    UNION ALL
    SELECT o_orderkey AS key, 'lookup' AS side FROM orders
        ANTI JOIN lineitem ON o_orderkey = l_orderkey"""
)
def key_coverage(spark, folder):
    facts = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("key"))
    known = table(spark, folder, "orders").select(F.col("o_orderkey").alias("key"))
    return lookups.key_gaps(facts, known, "key")


# One priority is left out on purpose.
PRIORITY_BANDS = {
    "1-URGENT": "high",
    "2-HIGH": "high",
    "3-MEDIUM": "middle",
    "4-NOT SPECIFIED": "middle",
}
_BAND_SQL = """CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'high'
    WHEN '3-MEDIUM' THEN 'middle' WHEN '4-NOT SPECIFIED' THEN 'middle' END"""


@query(f"SELECT o_orderkey, {_BAND_SQL} AS band FROM orders")
def recode_bands(spark, folder):
    band = recode(F.col("o_orderpriority"), PRIORITY_BANDS).alias("band")
    return table(spark, folder, "orders").select("o_orderkey", band)


@query("SELECT doc_id, coalesce(toxic, 0) AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def zero_filled(spark, folder):
    """The label of every document, 0 where it has none."""
    labels = table(spark, folder, "labels").select("doc_id", "toxic")
    found = lookups.look_up(table(spark, folder, "documents").select("doc_id"), labels, "doc_id")
    return found.select("doc_id", zero_if_null(F.col("toxic")).alias("toxic"))


@query(f"SELECT count(*) AS rows, count(*) - count({_BAND_SQL}) AS missing FROM orders")
def recode_nulls(spark, folder):
    return recode_bands(spark, folder).agg(
        F.count(F.lit(1)).alias("rows"), null_count(F.col("band")).alias("missing")
    )


@query(
    """SELECT l_orderkey, l_quantity, CASE l_returnflag WHEN 'A' THEN 'accepted'
            WHEN 'N' THEN 'none' END AS l_returnflag,
        CASE l_linenumber WHEN 1 THEN 'first' WHEN 2 THEN 'second' WHEN 3 THEN 'third' END
            AS l_linenumber
    FROM lineitem"""
)
def label_codes(spark, folder):
    lines = table(spark, folder, "lineitem")
    labels = {
        "l_returnflag": {"A": "accepted", "N": "none"},
        "l_linenumber": {1: "first", 2: "second", 3: "third"},
    }
    return apply_labels(
        lines.select("l_orderkey", "l_quantity", "l_returnflag", "l_linenumber"), labels
    )


# Each customer stands for one row of a projection; the nineteenth band is unknown.
BANDS = [*AGE_BANDS, "Aged 200"]
_BANDS_SQL = "[" + ", ".join(f"'{b}'" for b in BANDS) + "]"
_GROUPS_SQL = "[" + ", ".join(f"'{AGE_BANDS.get(b)}'" for b in BANDS) + "]"
_PROJECTED_SQL = f"""projected AS (
    SELECT 'Z' || c_nationkey AS zone, r_name AS region,
        CAST(CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 2 END AS INTEGER) AS sex,
        nullif(({_GROUPS_SQL})[c_custkey % 19 + 1], 'None') AS age_group,
        CAST(greatest(floor(c_acctbal / 500), 0) AS BIGINT) AS value
    FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
    LEFT JOIN region ON n_regionkey = r_regionkey)"""


def projection(spark, folder, keep=()):
    bands = F.array(*[F.lit(b) for b in BANDS])
    return table(spark, folder, "customer").select(
        F.concat(F.lit("Z"), F.col("c_nationkey")).alias("geogcode"),
        F.when(F.col("c_custkey") % 3 == 0, "Female").otherwise("Male").alias("Gender"),
        F.get(bands, (F.col("c_custkey") % 19).cast("int")).alias("Age"),
        F.greatest(F.floor(F.col("c_acctbal") / 500), F.lit(0)).cast("bigint").alias("value"),
        *keep,
    )


def recoded_projection(spark, folder):
    zones = zone_regions(spark, folder).select(
        F.concat(F.lit("Z"), F.col("zone")).alias("zone"), "region"
    )
    return controls.recode_projection(projection(spark, folder), zones)


@query(
    f"""WITH {_PROJECTED_SQL} SELECT count(*) - count(zone) AS zone, count(*) - count(region) AS region,
        count(*) - count(sex) AS sex, count(*) - count(age_group) AS age_group FROM projected"""
)
def control_nulls(spark, folder):
    return controls.unmapped(recoded_projection(spark, folder))


_TOTALS_SQL = f"""WITH {_PROJECTED_SQL}, totals AS (
    SELECT zone, region, sex, age_group, CAST(sum(value) AS BIGINT) AS value
    FROM projected GROUP BY zone, region, sex, age_group)"""


@query(f"{_TOTALS_SQL} SELECT * FROM totals")
def control_totals(spark, folder):
    return controls.control_totals(recoded_projection(spark, folder))


@query(
    f"""{_TOTALS_SQL} SELECT zone, region, sex, age_group, unnest(range(1, value + 1)) AS person
    FROM totals WHERE value > 0"""
)
def expand_controls(spark, folder):
    return controls.expand_controls(control_totals(spark, folder))

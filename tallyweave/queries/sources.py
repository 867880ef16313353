"""Sinks and sources, written to and read back from the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyweave.operators import density, lookups, sample
from tallyweave.queries.density import _errors_sql, populations
from tallyweave.queries.registry import query, rounded, table
from tallyweave.session import shared_dir
from tallyweave.sources import files

_CSV_SCHEMA = "o_orderkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string"


def scratch(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def csv_roundtrip(spark, folder):
    path = scratch(spark, "orders")
    orders = table(spark, folder, "orders")
    files.write_csv(
        orders.select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"), path
    )
    return files.read_csv(spark, path, _CSV_SCHEMA)


@query("SELECT c_custkey, c_mktsegment, c_nationkey FROM customer")
def csv_inferred(spark, folder):
    """Types inferred from the text: small numbers come back as int."""
    path = scratch(spark, "customers")
    customers = table(spark, folder, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    files.write_csv(customers, path)
    return files.read_csv(spark, path).withColumn("c_custkey", F.col("c_custkey").cast("bigint"))


@query(
    """SELECT round(sqrt(-2 * ln(1 - ('0x' || substr(a, 1, 8))::UBIGINT / 4294967296.0::DOUBLE))
            * cos(2 * pi() * ('0x' || substr(a, 9, 8))::UBIGINT / 4294967296.0::DOUBLE), 9) AS z0,
        round(sqrt(-2 * ln(1 - ('0x' || substr(b, 1, 8))::UBIGINT / 4294967296.0::DOUBLE))
            * cos(2 * pi() * ('0x' || substr(b, 9, 8))::UBIGINT / 4294967296.0::DOUBLE), 9) AS z1
    FROM (SELECT md5('5:' || o_orderkey || ':0') AS a, md5('5:' || o_orderkey || ':1') AS b FROM orders)"""
)
def latents_csv(spark, folder):
    path = scratch(spark, "latents")
    orders = table(spark, folder, "orders").select("o_orderkey")
    files.write_latents(sample.with_latents(orders, ["o_orderkey"], 2, seed=5), path, 2)
    back = spark.read.schema("z0 double, z1 double").csv(path)
    return back.select(rounded("z0").alias("z0"), rounded("z1").alias("z1"))


@query(
    _errors_sql(
        ["l_returnflag", "l_linenumber"],
        (1, 2),
        'SELECT combo, cells, round(mae, 9) AS mae FROM errors',
    )
)
def metrics_sink(spark, folder):
    path = scratch(spark, "metrics")
    errors = density.evaluate(*populations(spark, folder, ["l_returnflag", "l_linenumber"]), [1, 2])
    files.write_losses(errors.select("combo", "cells", rounded("mae").alias("mae")), path)
    return spark.read.schema("combo string, cells bigint, mae double").json(path)


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def lookup_csv(spark, folder):
    """Customers with their nation, from a lookup file as spreadsheets write it: with a byte order mark and CRLF."""
    path = scratch(spark, "nations")
    nations = table(spark, folder, "nation").select(F.concat_ws(",", "n_nationkey", "n_name").alias("value"))
    head = spark.createDataFrame([("\ufeffc_nationkey,n_name",)], "value string")
    lines = head.unionByName(nations).select(F.concat("value", F.lit("\r")).alias("value"))
    # A lookup of a few rows, in one file, its head first.
    lines.coalesce(1).write.text(path)
    lookup = files.read_csv(spark, path, "c_nationkey int, n_name string")
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    return lookups.look_up(customers, lookup, "c_nationkey").drop("c_nationkey")


_BROKEN_SQL = """CASE WHEN o_orderstatus = 'P' THEN o_orderkey || ',P'
    WHEN o_orderpriority = '5-LOW' THEN o_orderkey || ',' || o_orderstatus || ',unknown,5-LOW' END"""


@query(
    f"""SELECT CASE WHEN line IS NULL THEN o_orderkey END AS o_orderkey, CASE WHEN line IS NULL THEN o_orderstatus END AS o_orderstatus,
        CASE WHEN line IS NULL THEN o_totalprice END AS o_totalprice, CASE WHEN line IS NULL THEN o_orderpriority END
        AS o_orderpriority, line FROM (SELECT *, {_BROKEN_SQL} AS line FROM orders)"""
)
def csv_rejects(spark, folder):
    """Orders from a file in which lines of some are cut off and prices of others are no numbers, and those lines."""
    path = scratch(spark, "broken")
    orders = table(spark, folder, "orders")
    price = F.when(F.col("o_orderpriority") == "5-LOW", "unknown").otherwise(F.col("o_totalprice").cast("string"))
    short = F.concat_ws(",", "o_orderkey", "o_orderstatus")
    whole = F.concat_ws(",", "o_orderkey", "o_orderstatus", price, "o_orderpriority")
    orders.select(F.when(F.col("o_orderstatus") == "P", short).otherwise(whole).alias("value")).write.text(path)
    rows, rejects = files.read_csv_checked(spark, path, _CSV_SCHEMA, header=False)
    return rows.withColumn("line", F.lit(None).cast("string")).unionByName(
        rejects.select("line"), allowMissingColumns=True
    )

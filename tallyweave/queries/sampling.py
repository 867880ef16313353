"""Repeatable splits, draws, row ids and pairing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.operators import bucketed, lookups, sample, tables
from tallyweave.queries.registry import ORACLES, query, rounded, table
from tallyweave.session import scratch, spread

_U_SQL = "('0x' || substr(md5('1234:' || o_orderkey), 1, 8))::UBIGINT / 4294967296.0::DOUBLE"


@query(
    f"""SELECT o_orderkey, CASE WHEN {_U_SQL} < 0.7 THEN 'train' WHEN {_U_SQL} < 0.9 THEN 'val'
        ELSE 'test' END AS split FROM orders"""
)
def hash_split(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey")
    return sample.split(orders, ["o_orderkey"], seed=1234, val=0.2, test=0.1)


@query(
    """SELECT o_orderkey, CASE WHEN place <= n - floor(n * 0.1 + 1e-9) THEN 'train' ELSE 'val' END AS split
    FROM (SELECT o_orderkey, count(*) OVER () AS n, row_number() OVER (
        ORDER BY md5('1234:' || o_orderkey) || ':' || o_orderkey) AS place FROM orders)"""
)
def exact_split(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey")
    return sample.exact_split(orders, ["o_orderkey"], seed=1234, val=0.1)


@query(
    """SELECT o_orderkey, CAST(dim AS INTEGER) AS dim, round(sqrt(-2 * ln(1 -
            ('0x' || substr(h, 1, 8))::UBIGINT / 4294967296.0::DOUBLE))
        * cos(2 * pi() * ('0x' || substr(h, 9, 8))::UBIGINT / 4294967296.0::DOUBLE), 9) AS z
    FROM (SELECT o_orderkey, dim, md5('99:' || o_orderkey || ':' || dim) AS h
        FROM orders, range(4) r(dim))"""
)
def latent_draws(spark, folder):
    orders = spread(table(spark, folder, "orders")).select("o_orderkey")
    drawn = sample.with_latents(orders, ["o_orderkey"], size=4, seed=99)
    return drawn.select("o_orderkey", F.posexplode("z").alias("dim", "z")).withColumn(
        "z", rounded("z")
    )


@query(
    """SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pid, o_orderkey
    FROM orders"""
)
def row_ids(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderdate", "o_orderkey")
    return tables.with_row_ids(orders, ["o_orderdate", "o_orderkey"]).select("pid", "o_orderkey")


@query(
    """SELECT doc_id, lang, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id)"""
)
def pair_rows(spark, folder):
    """Documents and labels that have each other."""
    documents = table(spark, folder, "documents").select("doc_id", "lang", "n_chars")
    labels = table(spark, folder, "labels")
    return lookups.pair(
        documents.join(labels.select("doc_id"), "doc_id", "left_semi"),
        labels.join(documents.select("doc_id"), "doc_id", "left_semi"),
        "doc_id",
    )


@query(
    """SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'facts' ELSE 'lookup' END AS side
    FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)
    WHERE d.doc_id IS NULL OR l.doc_id IS NULL"""
)
def unpaired_rows(spark, folder):
    """Ids that only the documents or only the labels have."""
    return lookups.key_gaps(table(spark, folder, "documents"), table(spark, folder, "labels"), "doc_id")


@query(ORACLES["pair_rows"])
def paired_stored(spark, folder):
    """The same from tables that lie in buckets of their key."""
    documents, labels = _stored_pair(spark, folder)
    return bucketed.paired(documents, labels, "doc_id")


@query(ORACLES["unpaired_rows"])
def unpaired_stored(spark, folder):
    """The ids that one of them only has."""
    return bucketed.key_gaps(*_stored_pair(spark, folder), "doc_id")


def _stored_pair(spark, folder, buckets=16):
    path = scratch(spark, "buckets")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    documents = table(spark, folder, "documents").select("doc_id", "lang", "n_chars")
    return (
        bucketed.store(documents, f"{name}_documents", f"{path}/documents", "doc_id", buckets),
        bucketed.store(table(spark, folder, "labels"), f"{name}_labels", f"{path}/labels", "doc_id", buckets),
    )

"""Connected components of an edge table, by alternating large and small stars.

Every round replaces edges by edges to the smallest neighbour, in joins and
grouped minima; the rounds grow as the logarithm of the longest path. No
component is gathered anywhere, and a node with very many edges is split by
Spark's handling of skewed joins, since its edges are never grouped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.shared import stored
from tallyweave.session import delete


def _large_star(edges: DataFrame, paths: list[str]) -> DataFrame:
    both = stored(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), paths)
    least = stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("least")), paths)
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(edges: DataFrame, paths: list[str]) -> DataFrame:
    least = stored(edges.groupBy("a").agg(F.min("b").alias("least")), paths)
    moved = edges.join(least, "a").filter("b > least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(least.withColumnRenamed("least", "b")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge; the root is the smallest node of its component.

    ``edges`` has columns ``a`` and ``b`` of one integer type. Direction, repetition, loops and nulls
    do not matter, and an empty table gives no rows.
    """
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    paths: list[str] = []
    edges = stored(pairs.filter("a > b").distinct(), paths)
    state = None
    while state != (now := _state(edges)):
        state, old = now, paths
        paths = []
        edges = stored(_small_star(stored(_large_star(edges, old), old), old), paths)
        # Nothing reads the tables of a round once the next edges are there.
        for path in old:
            delete(edges.sparkSession, path)
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)

import hashlib
import math

import duckdb
import numpy as np
import pytest
from hypothesis import given as cases
from hypothesis import settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyweave.llm import bitplanes
from tallyweave.llm.registry import ORACLES


def brute(rows, k=8, rounds=10):
    """(vec_id, cluster, distance, cluster_inertia, inertia, sha) by the definition, in whole numbers."""
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(map(fine, v))]
    order = sorted(kept, key=lambda r: hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest())
    centroids = [v for _, v in order[:k]]

    def assign():
        away = [[sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids] for _, v in kept]
        return [(min(range(len(d)), key=lambda c: (d[c], c)), min(d)) for d in away]

    for _ in range(rounds):
        mine = assign()
        for c in range(len(centroids)):
            own = [v for (_, v), (which, _) in zip(kept, mine, strict=True) if which == c]
            if own:
                centroids[c] = [sum(column) // len(own) for column in zip(*own, strict=True)]
    mine = assign()
    total = sum(d for _, d in mine)
    inside = {c: sum(d for which, d in mine if which == c) for c, _ in mine}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, c, d, inside[c], total, sha[c]) for (i, _), (c, d) in zip(kept, mine, strict=True)]


def fine(x):
    return x is not None and math.isfinite(x)


def test_query_against_sql_and_brute_force(spark, folder, given):
    got = bitplanes.op13_bitplane_clusters(spark, folder)
    assert [t for _, t in got.dtypes] == ["bigint", "int", "bigint", "bigint", "bigint", "string"]
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(brute([(r["vec_id"], r["embedding"]) for r in given("embeddings")]))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    cursor = con.execute(ORACLES["op13_bitplane_clusters"])
    assert [d[0] for d in cursor.description] == got.columns
    assert sorted(cursor.fetchall()) == rows


numbers = st.one_of(st.integers(-3, 3), st.integers(-(2**26), 2**26), st.sampled_from([1 - bitplanes.LIMIT, bitplanes.LIMIT - 1]))


@settings(max_examples=100, deadline=None)
@cases(st.lists(st.lists(numbers, min_size=64, max_size=64), min_size=1, max_size=4))
def test_products_of_planes_are_exact(rows):
    whole = np.array(rows, dtype=np.int64)
    planes = bitplanes.pack(whole, 28)
    assert np.array_equal(bitplanes.unpack(planes), whole)
    want = [[sum(a * b for a, b in zip(x, y, strict=True)) for y in rows] for x in rows]
    assert bitplanes.dots(planes, planes).tolist() == want
    assert bitplanes.lengths(planes).tolist() == [want[i][i] for i in range(len(rows))]
    which, away = bitplanes.nearest(planes, bitplanes.lengths(planes), planes[:1])
    assert away.tolist() == [sum((a - b) ** 2 for a, b in zip(x, rows[0], strict=True)) for x in rows]
    assert not which.any()


def clustered(spark, rows, kind="vec_id long, embedding array<float>"):
    df = spark.createDataFrame(rows, kind).withColumns({c: F.lit("clash") for c in ("planes", "square", "cluster", "hash")})
    return sorted(map(tuple, bitplanes.Clusters(df).report().collect()), key=repr)


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(n, rng.normal(size=64).astype(np.float32).tolist()) for n in range(30)]
    bad = rng.normal(size=64).tolist()
    rows += [(50, None), (51, []), (52, bad[:63]), (53, [*bad, 1.0]), (54, [None, *bad[1:]])]
    rows += [(55, [float("nan"), *bad[1:]]), (56, [float("inf"), *bad[1:]]), (57, [-float("inf"), *bad[1:]])]
    rows += [(None, rows[3][1]), rows[4], rows[4]]
    assert clustered(spark, rows) == sorted(brute(rows), key=repr)


@pytest.mark.parametrize("count", [1, 5, 20])
def test_equal_vectors_and_few_vectors(spark, count):
    """Equal centroids: the smaller number gets all, and the others stay as they are."""
    rows = [(n, [0.5] * 64) for n in range(count)]
    got = clustered(spark, rows)
    assert got == sorted(brute(rows), key=repr) and {r[1] for r in got} == {0}
    zero = [(n, [0.0] * 64) for n in range(count)]
    assert clustered(spark, zero) == sorted(brute(zero), key=repr)


def test_doubles_and_negative_means(spark):
    rng = np.random.default_rng(4)
    rows = [(n, (rng.normal(size=64) * 40 - 20).tolist()) for n in range(25)]
    assert clustered(spark, rows, "vec_id long, embedding array<double>") == sorted(brute(rows), key=repr)


def test_an_empty_table_and_too_large_numbers(spark):
    assert clustered(spark, []) == []
    assert clustered(spark, [(1, None), (2, [1.0])]) == []
    with pytest.raises(ValueError, match="scale vectors"):
        clustered(spark, [(1, [1e30] * 64)])

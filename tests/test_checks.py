"""Checks by the job that encodes, and numbers in bins."""

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import bins, checks, encode


def test_checks_take_no_job_of_their_own(spark):
    known = spark.createDataFrame([(i, f"v{i % 3}", float(i), i % 2) for i in range(30)], "id int, a string, x double, b int")
    plan = encode.fit(known, include=["a", "b", "x"])
    rows = [(1, "v0", 5.0, 1, "7"), (2, "new", 40.0, 1, "x"), (3, None, -1.0, 5, None), (4, "new", None, 0, "1e3")]
    df = spark.createDataFrame(rows, "id int, a string, x double, b int, n string")
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    passed = df.mapInArrow(count, df.schema)
    encoded, report = checks.encode_checked(passed, plan, ["id"], numeric=["n", "x"], like=["id", "a", "x", "b", "k"])
    assert [r["a"] for r in sorted(encoded.collect())] == [0, -1, -1, -1]
    assert reads.value == 4
    assert {(c, n): k for c, n, k in report.rows() if k} == {
        ("different columns", "n"): 4,
        ("different columns", "k"): 4,
        ("not a number", "n"): 1,
        ("outside the range", "x"): 2,
        ("unseen value", "a"): 3,
        ("unseen value", "b"): 1,
    }
    with pytest.raises(ValueError, match=r"unseen value: b \(1 rows\)"):
        report.require()
    good, report = checks.encode_checked(known, plan, ["id"], numeric=["x"])
    assert good.count() == 30
    report.require()
    assert all(k == 0 for _, _, k in report.rows())


def test_missing_and_constant_columns_and_identifiers(spark):
    known = spark.createDataFrame([(i, float(i)) for i in range(40)], "a int, x double")
    plan = encode.fit(known, include=["a", "x"], overrides={"a": "categorical"})
    same = known.withColumn("x", F.lit(3.0))
    encoded, report = checks.encode_checked(same, plan)
    encoded.collect()
    assert {(c, n): k for c, n, k in report.rows() if k} == {("no range", "x"): 40, ("identifier", "a"): 40}
    encoded, report = checks.encode_checked(known.drop("a"), plan)
    assert encoded.columns == ["x"] and encoded.count() == 40
    assert {(c, n): k for c, n, k in report.rows() if k} == {("missing column", "a"): 40}
    encoded, report = checks.encode_checked(known.limit(0), plan)
    encoded.collect()
    assert all(k == 0 for _, _, k in report.rows())


def test_unknown_tokens_are_null(spark):
    known = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "t string, x double")
    plan = encode.fit(known, include=["t", "x"], overrides={"x": "continuous"})
    tokens = spark.createDataFrame([(1, 0, 0.0), (2, 2, 1.0), (3, -1, 0.5), (4, None, 0.5), (5, 1, 0.5)], "id int, t int, x double")
    rows, report = checks.decode_checked(tokens, plan, ["id"])
    got = {r["id"]: (r["t"], r["x"]) for r in rows.collect()}
    assert got == {1: ("a", 1.0), 2: (None, 3.0), 3: (None, 2.0), 4: (None, 2.0), 5: ("b", 2.0)}
    assert report.rows() == [("unseen token", "t", 3)]


def test_bins(spark):
    values = [float(i % 100) for i in range(1000)] + [7.0] * 900 + [None] * 10
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "x double, i int").repartition(4)
    edges = bins.fit_bins(df, ["x"], 5)["x"]
    known = sorted(v for v in values if v is not None)
    want = sorted({known[int((len(known) - 1) * i / 5 + 0.5)] for i in range(6)})
    # A value that takes more than a bin leaves fewer bins.
    assert edges == want and edges[:2] == [0.0, 7.0] and len(edges) < 6
    other = spark.createDataFrame([(-1.0,), (0.0,), (7.0,), (99.0,), (99.5,), (float("nan"),), (None,)], "x double")
    assert [r["x"] for r in bins.binned(other, {"x": edges}).collect()] == [-1, 0, 1, len(edges) - 2, len(edges) - 1, len(edges) - 1, None]
    assert [r["x"] for r in bins.binned(other, {"x": [7.0]}).collect()] == [-1, -1, 0, 1, 1, 1, None]
    assert [r["x"] for r in bins.binned(other, {"x": []}).collect()] == [-1] * 6 + [None]


def test_cells_do_not_grow_with_rows(spark):
    for rows in (1_000, 20_000):
        df = spark.range(rows).select(F.rand(3).alias("x"), F.randn(4).alias("y"))
        found = bins.evaluate(df, df.withColumn("x", F.col("x") * 2 - 1), [1, 2], bins=8)
        assert all(r["cells"] <= 11 ** r["order"] for r in found.collect())
    same = bins.evaluate(df, df, [1, 2], bins=8).collect()
    assert {r["mae"] for r in same} == {0.0}

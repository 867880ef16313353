"""Profiles, quantiles and kind inference."""

import math
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import encode, profile


@pytest.mark.parametrize("few", [10, 100, 10_000_000])
def test_quantiles_are_exact(spark, few):
    """Also when most values must be narrowed away, and when a third of them are the same."""
    rng = random.Random(3)
    rows = [(rng.random(), 7 if i % 3 == 0 else rng.randrange(1000), None) for i in range(5000)]
    df = spark.createDataFrame(rows, "x double, y int, z double").repartition(6)
    got = profile.quantiles(df, ["x", "y", "z"], [0.0, 0.25, 0.5, 0.75, 1.0], accuracy=50, few=few)
    for i, name in enumerate(["x", "y"]):
        values = sorted(r[i] for r in rows)
        want = [values[math.floor(4999 * q + 0.5)] for q in (0.0, 0.25, 0.5, 0.75, 1.0)]
        assert got[name] == want
    assert got["z"] == [None] * 5


def test_quantiles_where_a_sketch_is_wrong(spark, monkeypatch):
    """A rank that its bracket does not hold is found between farther ends."""
    rng = random.Random(4)
    values = sorted(rng.random() for _ in range(4000))
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(3)
    plain = profile._ranks

    def ranks(name, n, found, shares, accuracy):
        return [
            replace(r, ends=((values[10], values[20]), (values[3000], values[3900]), (None, None)))
            for r in plain(name, n, found, shares, accuracy)
        ]

    monkeypatch.setattr(profile, "_ranks", ranks)
    want = [values[math.floor(3999 * q + 0.5)] for q in (0.25, 0.9)]
    assert profile.quantiles(df, ["x"], [0.25, 0.9]) == {"x": want}


def counted(spark, df):
    """The rows with an accumulator that counts how often any of them is read."""
    reads = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    return df.mapInArrow(run, df.schema), reads


@pytest.mark.parametrize("few", [50, 100_000])
def test_a_summary_scans_twice(spark, few):
    rng = random.Random(6)
    rows = [(rng.gauss(0, 1), rng.randrange(5), None, f"t{rng.randrange(9)}", i % 7 == 0) for i in range(9000)]
    rows[5] = (None, None, None, None, None)
    given = spark.createDataFrame(rows, "x double, y int, z double, t string, b boolean").repartition(5)
    df, reads = counted(spark, given)
    got = {r["column"]: r for r in profile.summary(df, accuracy=500, few=few).collect()}
    assert reads.value == 2 * len(rows)
    for i, name in enumerate("xy"):
        values = sorted(r[i] for r in rows if r[i] is not None)
        quartiles = [values[math.floor((len(values) - 1) * q + 0.5)] for q in (0.25, 0.5, 0.75)]
        assert [got[name][c] for c in ("minimum", "q25", "q50", "q75", "maximum")] == [values[0], *quartiles, values[-1]]
        assert got[name]["mean"] == pytest.approx(sum(values) / len(values))
        assert (got[name]["n"], got[name]["n_null"], got[name]["least"]) == (8999, 1, None)
    assert (got["z"]["n"], got["z"]["q50"], got["z"]["mean"]) == (0, None, None)
    assert (got["t"]["least"], got["t"]["greatest"], got["b"]["least"], got["b"]["greatest"]) == ("t0", "t8", "false", "true")
    assert profile.summary(given.limit(0)).where("n = 0").count() == 5


def test_profile(spark):
    df = spark.createDataFrame([(1, "a"), (-8, "a"), (None, "b")], "n int, t string")
    got = {r["column"]: r for r in profile.profile(df, exact=True).collect()}
    assert got["n"]["n_distinct"] == 3 and got["n"]["n_null"] == 1 and got["n"]["has_sentinel"]
    assert (got["n"]["minimum"], got["n"]["maximum"], got["n"]["span"]) == (-8, 1, 9)
    assert got["n"]["mean"] == -3.5
    assert got["t"]["n_distinct"] == 2 and got["t"]["mean"] is None and not got["t"]["has_sentinel"]
    approximate = {r["column"]: r["n_distinct"] for r in profile.profile(df).collect()}
    assert approximate == {"n": 3, "t": 2}
    assert profile.identifier_like(profile.profile(df, exact=True)).count() == 1


def test_kinds(spark):
    """Text, few values, many values, the sentinel among many, one value."""
    rows = spark.range(25).select(
        F.col("id").cast("string").alias("text"),
        (F.col("id") % 24).cast("int").alias("few"),
        F.col("id").alias("many"),
        F.when(F.col("id") == 0, -8).otherwise(F.col("id")).alias("marked"),
        F.lit(5).alias("same"),
        F.when(F.col("id") > 0, F.col("id")).cast("double").alias("many_with_null"),
    )
    got = {r["column"]: r["kind"] for r in encode.infer_kinds(rows).collect()}
    assert got == {
        "text": "categorical",
        "few": "categorical",
        "many": "continuous",
        "marked": "categorical",
        "same": "categorical",
        "many_with_null": "continuous",
    }
    older = encode.infer_kinds(rows, max_categories=100, overrides={"many": "continuous"})
    assert {r["column"]: r["kind"] for r in older.collect()}["many"] == "continuous"
    dates = spark.range(25).select(F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    with pytest.raises(ValueError, match="not supported"):
        encode.infer_kinds(dates)
    assert encode.infer_kinds(dates.limit(24)).first()["kind"] == "categorical"
    with pytest.raises(ValueError, match="nested"):
        encode.infer_kinds(spark.createDataFrame([([1],)], "a array<int>"))
    with pytest.raises(ValueError, match="numeric"):
        encode.infer_kinds(rows, overrides={"text": "continuous"})

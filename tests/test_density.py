"""Marginals on hand-computed tables."""

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import density


@pytest.fixture(scope="module")
def pairs(spark):
    target = spark.createDataFrame(
        [("F", "a"), ("F", "a"), ("F", "b"), ("M", "a")], "sex string, age string"
    )
    synthetic = spark.createDataFrame(
        [("F", "a"), ("M", "a"), ("M", "a"), ("M", "b")], "sex string, age string"
    )
    return target, synthetic


SIZES = {"sex": 2, "age": 2}


@pytest.mark.parametrize("options", [{}, {"sizes": SIZES}, {"sizes": SIZES, "max_cells": 1}])
def test_hand_computed(pairs, options):
    rows = density.evaluate(*pairs, orders=[1, 2], **options).collect()
    got = {r["combo"]: r for r in rows}
    want = {
        "sex": (2, 0.5, 0.5, 1.1116412886),
        "age": (2, 0.0, 0.0, 0.5623351444),
        "sex_age": (4, 0.25, 0.6666666667, 6.6228967079),
    }
    assert set(got) == set(want)
    for combo, (cells, mae, mnae, entropy) in want.items():
        row = got[combo]
        assert row["cells"] == cells
        assert row["mae"] == pytest.approx(mae)
        assert row["mnae"] == pytest.approx(mnae)
        assert row["cross_entropy"] == pytest.approx(entropy)


def test_means(pairs):
    assert density.mean_mean_absolute_error(*pairs) == pytest.approx(0.25)
    assert density.mean_mean_absolute_error(*pairs, order=2) == pytest.approx(0.25)
    with pytest.raises(ValueError, match="order 3"):
        density.mean_mean_absolute_error(*pairs, order=3)
    assert density.mean_mean_absolute_error(pairs[0], pairs[0]) == 0


@pytest.mark.parametrize("sizes", [None, {"x": 2, "y": 1}])
def test_null_is_a_value(spark, sizes):
    rows = spark.createDataFrame([(None, "a"), ("x", "a")], "x string, y string")
    got = density.joint_probs(rows, rows, [2], sizes=sizes).collect()
    assert sorted(r["cell"] for r in got) == ["null_a", "x_a"]
    assert all(r["p"] == r["q"] == 0.5 for r in got)


@pytest.mark.parametrize("sizes", [None, {"x": 2, "y": 2}])
def test_text_of_cells_may_collide(spark, sizes):
    rows = spark.createDataFrame([("a_b", "c"), ("a", "b_c")], "x string, y string")
    got = density.joint_probs(rows, rows, [2], sizes=sizes)
    assert got.count() == 2
    assert density.errors_by_combo(got).first()["mae"] == 0


def test_shares_sum_to_one(spark):
    left = spark.range(300).select(*[(F.col("id") % k).alias(f"c{k}") for k in range(2, 9)])
    right = spark.range(100).select(*[(F.col("id") * 7 % k).alias(f"c{k}") for k in range(2, 9)])
    probs = density.joint_probs(left, right, [1, 2, 3])
    sums = probs.groupBy("combo").agg(F.sum("p").alias("p"), F.sum("q").alias("q")).collect()
    assert len(sums) == 7 + 21 + 35
    assert all(r["p"] == pytest.approx(1) and r["q"] == pytest.approx(1) for r in sums)
    sizes = {f"c{k}": k for k in range(2, 9)}
    for cells in (1, 100, 10_000):
        rolled = density.joint_probs(left, right, [1, 2, 3], sizes=sizes, max_cells=cells)
        assert rolled.exceptAll(probs).count() == 0 and rolled.count() == probs.count()


def test_partitions_and_hot_cells_do_not_matter(spark):
    """A third of the rows in one cell, on one partition and on many."""
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 17).alias("a"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("b"), "id")).alias("b"),
    )
    other = spark.range(500).select((F.col("id") % 17).alias("a"), F.lit("hot").alias("b"))
    one = density.joint_probs(rows.repartition(1), other, [1, 2])
    many = density.joint_probs(rows.repartition(13), other.repartition(5), [1, 2])
    assert one.exceptAll(many).count() == 0 and many.exceptAll(one).count() == 0
    hot = one.where("combo = 'a_b' and cell = '0_hot'").first()
    assert (hot["n_target"], hot["n_synth"]) == (1000, 30)


def test_columns_named_like_our_own(spark):
    names = ["set", "n", "n_target", "combo", "order", "p", "a.b", "cell"]
    rows = spark.range(20).select(*[(F.col("id") % 3).alias(n) for n in names])
    for sizes in (None, dict.fromkeys(names, 3)):
        got = density.evaluate(rows, rows, [1, 2], sizes=sizes)
        assert got.count() == 8 + 28
        assert got.agg(F.max("mae")).first()[0] == 0


def test_many_columns(spark):
    """More columns and sets than one job counts."""
    rows = spark.range(10).select(*[(F.col("id") % 2).alias(f"c{k}") for k in range(70)])
    assert density.evaluate(rows, rows, [1]).count() == 70
    sizes = {f"c{k}": 2 for k in range(70)}
    assert density.evaluate(rows, rows, [1], sizes=sizes, max_cells=1000).count() == 70


def test_cover_keeps_every_combination():
    columns = list("abcdef")
    combos = density.column_combinations(columns, [1, 2, 3])
    sizes = dict(zip(columns, [2, 3, 5, 7, 11, 1000]))
    covers = density.cover(combos, sizes, 500)
    members = [m for _, group in covers for m in group]
    assert sorted(members) == sorted(combos)
    assert all(set(m) <= set(columns) for columns, group in covers for m in group)
    assert len(covers) < len(combos) / 2


def test_mixed_types_meet_as_text(spark):
    left = spark.createDataFrame([(1,), (2,)], "c int")
    right = spark.createDataFrame([("1",), ("2",)], "c string")
    assert density.mean_mean_absolute_error(left, right) == 0


def test_guards(spark, pairs):
    with pytest.raises(ValueError, match="age"):
        density.evaluate(pairs[0], pairs[1].drop("age"))
    with pytest.raises(Exception, match="empty"):
        density.evaluate(pairs[0], pairs[1].where("sex = 'X'"), [1]).collect()


def test_ranks(pairs):
    errors = density.evaluate(*pairs, orders=[1, 2])
    assert [r["combo"] for r in density.rank_combos(errors).collect()] == ["age", "sex_age", "sex"]
    assert density.worst_combos(errors).first()["combo"] == "sex"


def test_unique_share(pairs):
    row = density.unique_row_share(pairs[0]).first()
    assert (row["distinct_rows"], row["rows"], row["share"]) == (3, 4, 0.75)

"""Results do not depend on the cluster, and what the driver holds is bounded."""

import zipfile

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import encode, lookups, sample, tables
from tallyweave.plans import model as modelling
from tallyweave.plans import stored, synthesis, trials
from tallyweave.sources import files


@pytest.fixture
def partitions(spark):
    """Sets the number of shuffle partitions, and puts it back."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", n)
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_training_does_not_depend_on_the_cluster(spark, partitions):
    rows = spark.range(3000).select(
        "id",
        F.when(F.col("id") % 2 == 0, "F").otherwise("M").alias("sex"),
        F.when(F.col("id") % 2 == 0, "tea").otherwise("coffee").alias("drink"),
        (F.col("id") % 3).cast("int").alias("job"),
    )
    settings = modelling.Settings(2, 8, lr=0.02, batch_size=64, max_epochs=2, min_epochs=2, rows_per_task=500)
    losses = []
    for shuffled, layout in ((2, rows.repartition(1)), (8, rows.repartition(11)), (5, rows.orderBy(F.desc("id")))):
        partitions(shuffled)
        prepared = synthesis.prepare(layout, ["sex"], ["id"], seed=3, val=0.2)
        model, history = synthesis.train(prepared, settings, seed=3)
        assert history[0]["tasks"] > 1
        found = modelling.split_losses(prepared.encoded, model, ["id"], 3).orderBy("split").collect()
        losses.append([round(r["loss"], 9) for r in found])
    assert losses[0] == losses[1] == losses[2]


def test_columns_of_a_lookup_of_any_size(spark):
    df = spark.createDataFrame([(1, "x", "a"), (2, "y", None), (3, "z", "b")], "id int, k2 string, k string")
    words = spark.createDataFrame([("a", 1), (None, 5), (None, 6)], "k string, v int")
    small, large = lookups.look_up(df, words, "k"), lookups.look_up(df, words, "k", broadcast_rows=0)
    assert small.columns == large.columns == ["id", "k2", "k", "v"]
    assert sorted(small.collect()) == sorted(large.collect()) and small.count() == 3


def test_exact_split_refines_its_bins(spark, monkeypatch):
    df = spark.range(5000)
    want = {r["id"]: r["split"] for r in sample.exact_split(df, ["id"], 7, 0.3, 0.1).collect()}
    monkeypatch.setattr(sample, "DIGITS", 1)
    monkeypatch.setattr(sample, "FEW", 3)
    got = {r["id"]: r["split"] for r in sample.exact_split(df, ["id"], 7, 0.3, 0.1).collect()}
    assert got == want
    assert sum(s == "val" for s in got.values()) == 1500 and sum(s == "test" for s in got.values()) == 500


def test_row_ids_of_equal_places(spark):
    rows = spark.range(1000).select((F.col("id") % 2).alias("k"), F.col("id").alias("v"))
    got = tables.with_row_ids(rows, ["k"]).collect()
    assert sorted(r["pid"] for r in got) == list(range(1000))
    assert [r["k"] for r in sorted(got)] == [0] * 500 + [1] * 500
    assert tables.with_row_ids(rows.limit(0), ["k"]).collect() == []


def test_sizes_that_the_driver_refuses(spark, monkeypatch):
    df = spark.range(40).select("id", F.col("id").cast("string").alias("name"))
    plan = encode.fit(df, include=["name"])
    monkeypatch.setattr(modelling, "MAX_PARAMETERS", 100)
    with pytest.raises(ValueError, match="'name' has 40 categories"):
        modelling.build(plan, None, modelling.Settings(), 1)
    monkeypatch.setattr(encode, "MAX_WEIGHTS", 30)
    with pytest.raises(ValueError, match="'name' has 40"):
        plan.weights()
    monkeypatch.setattr(encode, "MAX_VALUES", 20)
    with pytest.raises(ValueError, match="name"):
        encode.fit(df, include=["name"])


def test_a_time_with_its_own_cycle(spark):
    df = spark.createDataFrame([(6.0,), (12.0,), (18.0,)], "hour double")
    plan = encode.fit(df, overrides={"hour": ("time", 6.0, 24.0)})
    assert (plan["hour"].low, plan["hour"].span) == (6.0, 24.0)


def test_trials_of_another_study_are_refused(spark, tmp_path):
    path = str(tmp_path / "trials")
    tree, score = {"x": trials.IntRange(0, 4)}, lambda settings, trial: settings["x"]
    cut = trials.run_trials(spark, tree, score, path, trials=3, timeout=-1, grid=True)
    assert [(r["trial"], r["objective"]) for r in cut.orderBy("trial").collect()] == [(0, None), (1, None), (2, None)]
    assert trials.run_trials(spark, tree, score, path, trials=3, grid=True).where("objective is null").count() == 0
    for other, seed in (({"x": trials.IntRange(0, 5)}, 0), (tree, 1)):
        with pytest.raises(ValueError, match="own path"):
            trials.run_trials(spark, other, score, path, trials=3, seed=seed, grid=True)


def test_numbers_are_not_compared_as_cells(spark):
    rows = spark.range(500).select("id", (F.col("id") % 2).cast("int").alias("a"), (F.col("id") * 1.5).alias("price"))
    prepared = synthesis.prepare(rows, ["a"], ["id"], seed=1)
    assert {r["combo"] for r in synthesis.compare(prepared, rows, [1, 2]).collect()} == {"a"}


def test_archives_with_folders_and_other_columns(spark, tmp_path):
    for name, text in (("one", "a,b\n1,x\n"), ("two", "b,c\ny,2\n")):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as archive:
            archive.writestr("inner/", "")
            archive.writestr("inner/rows.csv", text)
    got = files.read_zipped_csv(spark, str(tmp_path / "*.zip"), schema="a int, b string")
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "x"), (None, "y")]


def test_a_model_is_stored_onto_its_own_path(spark, tmp_path):
    df = spark.range(30).select("id", (F.col("id") % 3).cast("string").alias("name"))
    model = modelling.build(encode.fit(df, include=["name"]), None, modelling.Settings(2, 4), 1)
    path = str(tmp_path / "model")
    stored.save_model(spark, model, path)
    stored.save_model(spark, stored.load_model(spark, path), path)
    again = stored.load_model(spark, path)
    assert again.vector.tolist() == model.vector.tolist()
    assert again.features.vocabulary.count() == 3

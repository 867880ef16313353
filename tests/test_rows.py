"""Splits, row ids, draws, recodes, control totals, columns and files."""

import time
import zipfile
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import draws, recode
from tallyweave.operators import controls, sample, tables
from tallyweave.plans import synthesis, trials
from tallyweave.plans.model import Settings
from tallyweave.sources import files


def test_uniform(spark):
    row = spark.range(1).select(draws.uniform(42, F.lit(7))).first()
    assert row[0] == 0.32816208130680025


def test_normals(spark):
    z = spark.range(20_000).select(F.explode(draws.normals(2, 1, F.col("id"))).alias("z"))
    mean, std = z.agg(F.avg("z"), F.stddev("z")).first()
    assert abs(mean) < 0.02 and abs(std - 1) < 0.02


def test_splits(spark):
    rows = spark.range(1003)
    names = sample.split(rows, ["id"], 5, val=0.2, test=0.1)
    sizes = {r["split"]: r["count"] for r in names.groupBy("split").count().collect()}
    assert sum(sizes.values()) == 1003 and set(sizes) == {"train", "val", "test"}
    moved = sample.split(rows.repartition(7), ["id"], 5, val=0.2, test=0.1)
    assert moved.exceptAll(names).count() == 0
    for val, test in ((0.2, 0.1), (0.1, None), (0.0, 0.0), (1.0, None)):
        exact = sample.exact_split(rows, ["id"], 5, val, test)
        sizes = {r["split"]: r["count"] for r in exact.groupBy("split").count().collect()}
        want = {name: n for name, n in sample.split_sizes(1003, val, test) if n}
        assert sizes == want
    assert sample.split_sizes(1003, 0.2, 0.1) == [("train", 703), ("val", 200), ("test", 100)]
    with pytest.raises(ValueError, match="fractions"):
        sample.split(rows, ["id"], 5, val=0.8, test=0.5)


def test_row_ids(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(5)
    got = tables.with_row_ids(rows, ["x"]).collect()
    assert sorted((r["pid"], r["x"]) for r in got) == [(i, i) for i in range(1000)]
    assert tables.with_row_ids(rows.where("x < 0"), ["x"]).count() == 0


def test_age_bands(spark):
    rows = spark.createDataFrame([("Aged 15-19",), ("Aged 85+",), ("Aged 200",)], "a string")
    got = rows.select(recode.recode(F.col("a"), recode.AGE_BANDS).alias("g"))
    assert [r["g"] for r in got.collect()] == ["16-24", "65+", None]
    assert got.agg(recode.null_count(F.col("g"))).first()[0] == 1
    with pytest.raises(ValueError, match="not found"):
        recode.apply_labels(rows, {"b": {1: "x"}})
    ages = spark.createDataFrame([(-8,), (1,), (9,)], "age int")
    labelled = recode.apply_labels(ages, {"age": recode.AGE_GROUP_LABELS}).collect()
    assert [r["age"] for r in labelled] == ["NA", "0-15", None]


def test_control_totals(spark):
    projection = spark.createDataFrame(
        [("z1", "Male", "Aged 5-9", 3), ("z1", "Male", "Aged 10-14", 4), ("z2", "Female", "Aged 85+", 0)],
        "geogcode string, Gender string, Age string, value int",
    )
    zones = spark.createDataFrame([("z1", "north"), ("z2", "south")], "zone string, region string")
    recoded = controls.recode_projection(projection, zones)
    assert controls.unmapped(recoded).first().asDict() == dict.fromkeys(controls.CONTROLS, 0)
    totals = controls.control_totals(recoded)
    assert {tuple(r) for r in totals.collect()} == {
        ("z1", "north", 2, "0-15", 7),
        ("z2", "south", 1, "65+", 0),
    }
    for chunk in (1, 3, 7, 10_000):
        people = controls.expand_controls(totals, chunk=chunk)
        assert sorted(r["person"] for r in people.collect()) == list(range(1, 8))
    with pytest.raises(ValueError, match="differ"):
        controls.recode_projection(projection, zones.where("zone = 'z1'"))
    loose = controls.recode_projection(projection, zones.where("zone = 'z1'"), check_zones=False)
    assert controls.unmapped(loose).first()["region"] == 1


def test_large_counts_spread(spark):
    one = spark.createDataFrame([("z", 100_000)], "zone string, value bigint")
    people = controls.expand_controls(one, chunk=1000)
    sizes = people.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 8 and people.distinct().count() == 100_000


def test_columns(spark):
    df = spark.createDataFrame([(1, "a", 2)], "pid int, x string, y int")
    assert tables.split_columns(df, ["x"]) == (["x"], ["pid", "y"])
    assert tables.encodable_columns(df.columns, exclude=["y"]) == ["x"]
    with pytest.raises(ValueError, match="no columns"):
        tables.encodable_columns(df.columns, include=["pid"])
    assert tables.rename_select(df, {"y": "b", "x": "a"}).columns == ["b", "a"]
    assert tables.rename_select(df).columns == df.columns
    with pytest.raises(ValueError, match="not found"):
        tables.rename_select(df, {"q": "b"})
    with pytest.raises(ValueError, match="numeric"):
        tables.require_numeric(df, ["x"])
    assert tables.preview(df, 1).count() == 1


LOOKUP = '﻿zone,name,region\r\nz1,"Town, of one",north\r\nz2,Two,\r\n'


def test_lookup_csv(spark, tmp_path):
    """Byte order mark, quoted commas, Windows line ends, empty fields."""
    (tmp_path / "l.csv").write_bytes(LOOKUP.encode())
    got = files.read_csv(spark, str(tmp_path / "l.csv"))
    assert got.columns == ["zone", "name", "region"]
    assert [tuple(r) for r in got.collect()] == [("z1", "Town, of one", "north"), ("z2", "Two", None)]


def test_zipped_csv(spark, tmp_path):
    for name, start in (("a", 0), ("b", 100)):
        lines = "".join(f"z{i}\t{i}\t\"t\tx\"\t{i / 4}\r\n" for i in range(start, start + 100))
        with zipfile.ZipFile(tmp_path / f"{name}.tsv.zip", "w") as archive:
            archive.writestr("data.tsv", "﻿zone\tvalue\tnote\tshare\r\n" + lines)
    path = str(tmp_path / "*.zip")
    got = files.read_zipped_csv(spark, path, sep="\t", chunk_rows=30)
    assert got.dtypes == [("zone", "string"), ("value", "bigint"), ("note", "string"), ("share", "double")]
    assert got.count() == 200 and got.agg(F.sum("value")).first()[0] == 19_900
    assert {r["note"] for r in got.select("note").distinct().collect()} == {"t\tx"}
    some = files.read_zipped_csv(spark, path, schema="zone string, value int", sep="\t")
    assert some.dtypes == [("zone", "string"), ("value", "int")] and some.count() == 200


def test_projection_archive_to_people(spark, tmp_path):
    """The whole way from a zipped projection to one row per person."""
    lines = ["geogcode\tname\tGender\tAge\tvalue"]
    for zone in ("z1", "z2"):
        for sex in ("Male", "Female"):
            lines += [f"{zone}\tx\t{sex}\t{age}\t2" for age in recode.AGE_BANDS]
    with zipfile.ZipFile(tmp_path / "p.tsv.zip", "w") as archive:
        archive.writestr("p.tsv", "\n".join(lines))
    (tmp_path / "l.csv").write_bytes(LOOKUP.encode())
    columns = ["geogcode", "Gender", "Age", "value"]
    projection = files.read_zipped_csv(spark, str(tmp_path / "p.tsv.zip"), columns, sep="\t")
    assert projection.dtypes[3] == ("value", "bigint")
    zones = files.read_csv(spark, str(tmp_path / "l.csv")).select("zone", "region")
    totals = controls.control_totals(controls.recode_projection(projection, zones))
    assert totals.count() == 2 * 2 * 7
    assert totals.where("zone = 'z1' and sex = 2 and age_group = '65+'").first()["value"] == 10
    assert controls.expand_controls(totals).count() == 2 * 2 * 18 * 2


SPACE = {
    "lr": trials.FloatRange(0.0001, 1, log=True),
    "beta": trials.FloatRange(0.1, 0.9, step=0.1),
    "encoder": {"depth": trials.IntRange(1, 4), "fixed": 3},
    "decoder": {"depth": trials.IntRange(2, 24, step=2)},
    "width": trials.Choice([16, 32, 64]),
}


def test_draws_of_trials(spark):
    drawn = trials.draw_trials(spark, SPACE, 300, seed=1)
    rows = drawn.collect()
    assert drawn.columns == ["trial", "lr", "beta", "encoder.depth", "decoder.depth", "width"]
    assert {r["encoder.depth"] for r in rows} == {1, 2, 3, 4}
    assert {r["decoder.depth"] for r in rows} == set(range(2, 25, 2))
    assert {r["beta"] for r in rows} == {i / 10 for i in range(1, 10)}
    assert all(0.0001 <= r["lr"] <= 1 for r in rows) and sum(r["lr"] < 0.01 for r in rows) > 100
    # Two blocks with a setting of the same name draw apart.
    assert len({(r["encoder.depth"], r["decoder.depth"]) for r in rows}) > 40
    assert trials.draw_trials(spark, SPACE, 30, seed=1).exceptAll(drawn).count() == 0
    resolved = trials.resolve(SPACE, rows[0].asDict())
    assert resolved["encoder"] == {"depth": rows[0]["encoder.depth"], "fixed": 3}
    grid = trials.draw_trials(spark, {"a": trials.IntRange(1, 3), "b": trials.Choice("xy")}, 99, 0, True)
    assert sorted((r["a"], r["b"]) for r in grid.collect()) == [(a, b) for a in (1, 2, 3) for b in "xy"]
    with pytest.raises(ValueError, match="logarithmic"):
        trials.FloatRange(0, 1, log=True)


def test_trials_resume(spark, tmp_path):
    path, scored = str(tmp_path / "trials"), []

    def score(settings, trial):
        scored.append(trial)
        return abs(settings["x"] - 2)

    tree = {"x": trials.IntRange(0, 4)}
    trials.run_trials(spark, tree, score, path, trials=2, grid=True)
    trials.run_trials(spark, tree, score, path, trials=9, timeout=-1, grid=True)
    assert scored == [0, 1]
    found = trials.run_trials(spark, tree, score, path, trials=9, grid=True)
    assert scored == [0, 1, 2, 3, 4]
    best = trials.best_trials(found).first()
    assert (best["trial"], best["objective"], best["settings"]) == (2, 0.0, {"x": "2"})
    ties = trials.best_trials(found, 3).collect()
    assert [r["trial"] for r in ties] == [2, 1, 3]


def test_whole_run(spark, tmp_path):
    source = spark.range(3000).select(
        F.col("id").alias("resident"),
        (F.col("id") % 2 + 1).cast("int").alias("s"),
        (F.col("id") % 4).cast("int").alias("a"),
        (F.col("id") % 2 * 3 - 8).cast("int").alias("j"),
    )
    files.write_csv(source, str(tmp_path / "in"))
    people = files.read_csv(spark, str(tmp_path / "in"), "resident bigint, s int, a int, j int")
    names = {"resident": "pid", "s": "sex", "a": "age_group", "j": "job"}
    prepared = synthesis.prepare(people, ["sex", "age_group"], ["pid"], 3, names, test=0.1)
    settings = Settings(2, 8, lr=0.05, batch_size=64, max_epochs=3, min_epochs=3)
    got = synthesis.run(prepared, settings, 3, out=str(tmp_path / "out"))
    assert {r["split"] for r in got["losses"].collect()} == {"train", "val", "test"}
    assert got["errors"].groupBy("order").count().count() == 3
    written = files.read_csv(spark, str(tmp_path / "out" / "synthetic"))
    assert written.count() == 3000 and written.columns == ["pid", "sex", "age_group", "job"]
    mae = {r["combo"]: r["mae"] for r in got["errors"].collect()}
    assert mae["sex_age_group"] == 0 and mae["sex_job"] < 0.05
    zs = spark.read.csv(str(tmp_path / "out" / "latents"))
    assert len(zs.columns) == 2 and zs.count() == 3000
    assert spark.read.json(str(tmp_path / "out" / "losses")).count() == 3


def slow(spark, seconds):
    """A score that takes a job of so many seconds on one core."""

    def wait(batches):
        time.sleep(seconds)
        yield from batches

    def score(settings, trial):
        return float(spark.range(1, numPartitions=1).mapInArrow(wait, "id long").count() * settings["x"] % 4)

    return score


def test_trials_at_once(spark, tmp_path):
    """The same table as one after the other, in less time; a failing trial fails the study and keeps the others."""
    tree, found, took = {"x": trials.IntRange(0, 9)}, {}, {}
    for workers in (1, 4):
        began = time.monotonic()
        path = str(tmp_path / f"of-{workers}")
        got = trials.run_trials(spark, tree, slow(spark, 1.0), path, trials=8, grid=True, workers=workers)
        found[workers] = [(r["trial"], r["objective"], r["settings"]) for r in got.collect()]
        took[workers] = time.monotonic() - began
    assert found[1] == found[4] and [t for t, _, _ in found[4]] == list(range(8))
    assert took[4] < 0.7 * took[1]

    def failing(settings, trial):
        if trial == 2:
            raise RuntimeError("no luck")
        return 0.0

    path = str(tmp_path / "failing")
    with pytest.raises(RuntimeError, match="no luck"):
        trials.run_trials(spark, tree, failing, path, trials=4, grid=True, workers=2)
    assert {0, 1} <= {r["trial"] for r in trials.read_trials(spark, path).collect()} <= {0, 1, 3}


def test_two_writers_store_each_trial_once(spark, tmp_path):
    path, tree = f"file://{tmp_path}/both", {"x": trials.IntRange(0, 5)}

    def study(value):
        def score(settings, trial):
            time.sleep(0.1)
            return value

        return trials.run_trials(spark, tree, score, path, trials=6, grid=True)

    with ThreadPoolExecutor(2) as pool:
        list(pool.map(study, [1.0, 2.0]))
    found = trials.read_trials(spark, path).collect()
    assert sorted(r["trial"] for r in found) == list(range(6))
    row = (3, 9.0, 0.0, {"x": "3"}, found[0]["study"])
    assert not trials.put_trial(spark, path, row)
    assert trials.read_trials(spark, path).where("objective = 9").count() == 0
    # What a killed writer leaves is no trial.
    (tmp_path / "both" / ".trial=7-1234").mkdir()
    assert trials.read_trials(spark, path).count() == 6
    assert trials.put_trial(spark, path, (7, *row[1:])) and trials.read_trials(spark, path).count() == 7

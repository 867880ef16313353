"""Bucketed tables, guide tables and rejected lines."""

import uuid

import pytest
from pyspark.sql import functions as F

from tallyweave import session
from tallyweave.functions import draws
from tallyweave.operators import bucketed, guide
from tallyweave.sources import files


def nodes(df):
    """The nodes of a plan, of adaptive ones too."""
    found, waiting = [], [df._jdf.queryExecution().executedPlan()]
    while waiting:
        node = waiting.pop()
        found.append(node)
        children = node.children()
        waiting += [children.apply(i) for i in range(children.length())]
        if node.nodeName() == "AdaptiveSparkPlan":
            waiting.append(node.inputPlan())
    return found


def test_stored_pairs_move_no_row(spark, tmp_path):
    name = f"t{uuid.uuid4().hex[:8]}"
    left = spark.range(1000).select("id", (F.col("id") * 2).alias("x"))
    right = spark.range(0, 1000, 3).select("id", (F.col("id") * 5).alias("y"))
    a = bucketed.store(left, f"{name}_a", str(tmp_path / "a"), "id", 4)
    b = bucketed.store(right, f"{name}_b", str(tmp_path / "b"), "id", 4)
    made = bucketed.paired(a, b, "id")
    for df in (made, bucketed.key_gaps(a, b, "id")):
        names = [node.nodeName() for node in nodes(df)]
        assert not any("Exchange" in n for n in names) and any("Join" in n for n in names)
    assert sorted(map(tuple, made.collect())) == [(i, 2 * i, 5 * i) for i in range(0, 1000, 3)]
    gaps = bucketed.key_gaps(a, b, "id").collect()
    assert {r["side"] for r in gaps} == {"facts"} and len(gaps) == 1000 - 334
    with pytest.raises(ValueError, match="pair up"):
        bucketed.pair(a, b, "id")
    assert bucketed.pair(a, a.withColumnRenamed("x", "z"), "id").count() == 1000
    again = bucketed.open_stored(spark, f"{name}_c", str(tmp_path / "b"), "id", 4)
    other = bucketed.pair(b, again.withColumnRenamed("y", "z"), "id")
    assert not any("Exchange" in node.nodeName() for node in nodes(other)) and other.count() == 334
    twice = bucketed.store(left.union(left.limit(1)), f"{name}_d", str(tmp_path / "d"), "id", 4)
    with pytest.raises(ValueError, match="repeat"):
        bucketed.paired(twice, b, "id")
    nulls = spark.createDataFrame([(1,), (None,)], "id long")
    e = bucketed.store(nulls, f"{name}_e", str(tmp_path / "e"), "id", 4)
    assert [tuple(r) for r in bucketed.key_gaps(e, a.where("id = 1"), "id").collect()] == [(None, "facts")]
    for letter in "abcde":
        spark.sql(f"DROP TABLE {name}_{letter}")


@pytest.mark.parametrize("chunk", [65_536, 3])
@pytest.mark.parametrize("broadcast", [True, False])
def test_guided_draws_equal_folded_ones(spark, monkeypatch, chunk, broadcast):
    monkeypatch.setattr(guide, "CHUNK", chunk)
    monkeypatch.setattr(guide, "BROADCAST_ROWS", 100_000 if broadcast else 0)
    # Peaks, tokens without a share, one token only, a null group; halves, so that sums are exact.
    groups = {"a": [1, 0, 0, 7, 0.5, 0.5, 0], "b": [0, 0, 3], "c": [0.25] * 40, None: [2, 6]}
    rows = [(g, t, float(p)) for g, ps in groups.items() for t, p in enumerate(ps)]
    shares = spark.createDataFrame(rows, "g string, token int, share double")
    df = spark.range(4000).select("id", F.get(F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.lit(None), F.lit("no")), (F.col("id") % 5).cast("int")).alias("g"))
    got = guide.draw(df, shares, ["g"], 3, ["id"], "t")
    assert got.columns == ["id", "g", "t"] and got.count() == 4000
    arrays_in = [n.nodeName() for n in nodes(got) if "ArrayType" in n.schema().toString() and n.nodeName() == "Project"]
    assert arrays_in == []
    picks = df.withColumn("u", draws.uniform(3, F.lit("t"), F.col("id"))).collect()
    drawn = {r["id"]: r["t"] for r in got.collect()}
    for r in picks:
        ps = groups.get(r["g"])
        if ps is None:
            assert drawn[r["id"]] is None
            continue
        limit, run, below = r["u"] * sum(ps), 0.0, 0
        for p in ps:
            run += p
            below += run <= limit
        assert drawn[r["id"]] == below


def test_rejected_lines_are_kept(spark, tmp_path):
    lines = ["id,name,x", "1,a,1.5", "2,b", "three,c,2.5", "4,d,4.5", '5,"e, f",5.5', "6,g,6.5,more", "7,,7.5", ""]
    (tmp_path / "in.csv").write_text("﻿" + "\r\n".join(lines))
    path = str(tmp_path / "in.csv")
    rows, rejects = files.read_csv_checked(spark, path, "id int, name string, x double")
    assert [tuple(r) for r in rows.orderBy("id").collect()] == [(1, "a", 1.5), (4, "d", 4.5), (5, "e, f", 5.5), (7, None, 7.5)]
    assert sorted(r["line"] for r in rejects.collect()) == ["2,b", "6,g,6.5,more", "three,c,2.5"]
    assert {r["file"] for r in rejects.collect()} == {"in.csv"}
    assert rows.select("id").count() == 4 and rows.select("name").where("name = 'd'").count() == 1
    rows, rejects = files.read_csv_checked(spark, path, "id int, name string, x double", required=["name"])
    assert rows.count() == 3 and "7,,7.5" in [r["line"] for r in rejects.collect()]


def test_a_writer_that_is_overtaken_leaves_the_other_ones_folder(spark, tmp_path):
    path = f"file://{tmp_path}/trial=1"

    def late(folder):
        spark.range(3).write.parquet(folder)
        # Another writer is done meanwhile.
        spark.range(5).write.parquet(path)

    assert not session.put_if_absent(spark, path, late)
    assert spark.read.parquet(path).count() == 5
    assert session.names_below(spark, f"file://{tmp_path}") == ["trial=1"]
    assert not session.put_if_absent(spark, path, late)

    def failing(folder):
        spark.range(3).write.parquet(folder)
        raise RuntimeError("no luck")

    with pytest.raises(RuntimeError, match="no luck"):
        session.put_if_absent(spark, f"file://{tmp_path}/trial=2", failing)
    assert session.names_below(spark, f"file://{tmp_path}") == ["trial=1"]
    assert session.names_below(spark, f"file://{tmp_path}/nowhere") == []

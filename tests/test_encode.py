"""Vocabularies, encoding and decoding."""

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import arrays, scale
from tallyweave.operators import encode, lookups, profile


def words(plan, name):
    return [r["value"] for r in plan.words(name).orderBy("token").collect()]


def test_weights(spark):
    rows = spark.createDataFrame([("a",)] * 6 + [("b",)] * 3 + [("c",)], "x string")
    plan = encode.fit(rows)
    assert plan.weights()["x"] == pytest.approx([0.5555555556, 1.1111111111, 3.3333333333])
    counted = plan.vocabulary.agg(F.sum(F.col("weight") * F.col("n")) / F.sum("n")).first()[0]
    assert counted == pytest.approx(1)


def test_native_order_nulls_first(spark):
    rows = spark.createDataFrame([(None,), (-8,), (10,), (2,), (2,)], "x int")
    plan = encode.fit(rows)
    assert words(plan, "x") == [None, "-8", "2", "10"]
    assert plan["x"].size == 4
    tokens = [r["x"] for r in encode.encode(rows, plan).collect()]
    assert tokens == [0, 1, 3, 2, 2]
    assert encode.decode(encode.encode(rows, plan), plan).collect() == rows.collect()


def test_order_beyond_doubles(spark):
    big = 2**53
    rows = spark.createDataFrame([(big + 2,), (big + 1,), (big,)], "x bigint")
    assert words(encode.fit(rows), "x") == [str(big), str(big + 1), str(big + 2)]


@pytest.mark.parametrize("types", ["boolean", "date", "timestamp", "double"])
def test_roundtrip_of_types(spark, types):
    values = {
        "boolean": "id % 2 = 0",
        "date": "date_add(date '2019-12-30', cast(id as int))",
        "timestamp": "timestamp_millis(id * 1001)",
        "double": "id / 8",
    }
    rows = spark.range(12).selectExpr("id as pid", f"{values[types]} as x")
    plan = encode.fit(rows)
    assert plan.kinds() == ["categorical"]
    tokens = encode.encode(rows, plan, keep=["pid"])
    ordered = rows.join(tokens.withColumnRenamed("x", "t"), "pid").orderBy("x").collect()
    assert [r["t"] for r in ordered] == sorted(r["t"] for r in ordered)
    assert encode.decode(tokens, plan, keep=["pid"]).exceptAll(rows).count() == 0


@pytest.fixture(scope="module")
def names(spark):
    """200 categories, one of them in a third of the rows, and nulls."""
    return spark.range(900).select(
        F.col("id").alias("pid"),
        F.when(F.col("id") % 3 == 0, "hot")
        .when(F.col("id") % 50 == 1, None)
        .otherwise(F.concat(F.lit("n"), F.col("id") % 199))
        .alias("name"),
    )


def exchanged(df, name):
    """Shuffles in the plan whose rows have a column of that name."""
    found, nodes = 0, [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        children = node.children()
        nodes += [children.apply(i) for i in range(children.length())]
        if node.nodeName() == "Exchange":
            found += f"{name}#" in node.output().mkString(",")
    return found


def test_several_large_columns_take_one_shuffle_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(encode, "HOT_KEYS", 3)
    monkeypatch.setattr(encode, "LITERALS", 2)
    rows = [(i, f"a{i % 50}", i % 40, (i % 30) / 4 - 1, None if i % 9 == 0 else f"c{i % 7}", "rest") for i in range(900)]
    rows += [(900 + i, "a0", 0, -0.0, None, "rest") for i in range(300)]
    df = spark.createDataFrame(rows, "id int, a string, b int, d double, c string, payload string")
    names = ["a", "b", "c", "d"]
    plan = encode.fit(df, include=names, overrides={n: "categorical" for n in names})
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        wide = encode.encode(df, plan, keep=["id", "payload"], broadcast_rows=0)
        assert exchanged(wide, "payload") <= 1
        back = encode.decode(wide, plan, keep=["id", "payload"], broadcast_rows=0)
        assert exchanged(back, "payload") <= 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    want = encode.encode(df, plan, keep=["id", "payload"])
    assert wide.exceptAll(want).count() == 0 and wide.count() == 1200
    assert back.select("id", *names).exceptAll(df.select("id", *names)).count() == 0 and back.count() == 1200
    other = df.withColumn("a", F.when(F.col("id") == 5, "new").otherwise(F.col("a")))
    coded = encode.encode(other, plan, keep=["id"], unseen="code", broadcast_rows=0)
    assert [r["id"] for r in coded.where("a = -1").collect()] == [5]
    with pytest.raises(Exception, match="not in the vocabulary: new"):
        encode.encode(other, plan, keep=["id"], broadcast_rows=0).collect()


def test_large_columns_are_neither_melted_nor_grouped(spark, monkeypatch):
    """Joins by one value of its own type, for values of all types, there and back, with hot words and without."""
    monkeypatch.setattr(encode, "LITERALS", 2)
    df = spark.range(600).select(
        "id",
        F.when(F.col("id") % 7 > 0, F.col("id") % 31).alias("whole"),
        F.when(F.col("id") % 9 == 0, F.lit(-0.0)).when(F.col("id") % 9 == 1, F.lit(float("nan"))).otherwise(F.col("id") / 8).alias("real"),
        (F.col("id") / 4).cast("float").alias("short"),
        (F.col("id") % 50 / 100).cast("decimal(10,2)").alias("price"),
        F.concat(F.lit("t"), F.col("id") % 40).alias("text"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 70).cast("int")).alias("day"),
        F.timestamp_seconds(F.col("id") % 90 * 1801).alias("at"),
    )
    names = df.columns[1:]
    plan = encode.fit(df, include=names, overrides={n: "categorical" for n in names})
    want = encode.encode(df, plan, keep=["id"])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        # With 20, some words of the numbers are hot; with 1, none are.
        for hot in (1, 20):
            monkeypatch.setattr(encode, "HOT_KEYS", hot)
            wide = encode.encode(df, plan, keep=["id"], broadcast_rows=0)
            back = encode.decode(wide, plan, keep=["id"], broadcast_rows=0)
            for made in (wide.select("id", "whole", "real", "text"), back):
                steps = made._jdf.queryExecution().executedPlan().toString()
                assert "Generate" not in steps and "Aggregate(keys=[__row" not in steps
            assert wide.count() == 600 and wide.exceptAll(want).count() == 0
            assert back.count() == 600 and back.exceptAll(df.withColumn("real", F.col("real") + 0.0)).count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("size", [encode.HASHED_BYTES, 0])
def test_numbers_and_values_go_from_join_to_join(spark, monkeypatch, size):
    """One shuffle for each large column and two by the number, hashed where words are few enough for it."""
    monkeypatch.setattr(encode, "LITERALS", 2)
    monkeypatch.setattr(encode, "HASHED_BYTES", size)
    rows = [(i, i % 90, 2**53 + i % 80, f"c{i % 70}", None if i % 3 else i / 4, "rest") for i in range(800)]
    df = spark.createDataFrame(rows, "id int, a int, b long, c string, d double, payload string")
    names = ["a", "b", "c", "d"]
    plan = encode.fit(df, include=names, overrides={n: "categorical" for n in names})
    want = encode.encode(df, plan, keep=["id", "payload"])
    alone = encode.encode(df, plan, broadcast_rows=0)
    monkeypatch.setattr(encode, "HOT_KEYS", 1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wide = encode.encode(df, plan, keep=["id", "payload"], broadcast_rows=0)
        back = encode.decode(wide, plan, keep=["id", "payload"], broadcast_rows=0)
        for made in (wide, back):
            assert exchanged(made, "__row") == len(names) + 2
        assert ("SortMergeJoin" in wide._jdf.queryExecution().executedPlan().toString()) == (size == 0)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert wide.exceptAll(want).count() == 0 and wide.count() == 800
    assert back.select("id", *names).exceptAll(df.select("id", *names)).count() == 0 and back.count() == 800
    assert alone.exceptAll(want.select(*names)).count() == 0 and alone.count() == 800


def test_columns_of_many_values_are_counted_alike_by_themselves(spark):
    df = spark.range(500).select(
        F.when(F.col("id") % 7 > 0, F.lit(2**62) + F.col("id") % 31).alias("whole"),
        F.when(F.col("id") % 9 == 0, F.lit(-0.0)).when(F.col("id") % 9 == 1, F.lit(float("nan"))).otherwise(F.col("id") % 5).alias("real"),
        F.concat(F.lit("t"), F.col("id") % 40).alias("text"),
        F.timestamp_seconds(F.col("id") % 90 * 1801).alias("at"),
        (F.col("id") % 2 == 0).alias("flag"),
    )
    want = profile.column_values(df, df.columns)
    for many in (["real"], ["whole", "text", "at"], df.columns):
        got = profile.column_values(df, df.columns, many)
        assert got.exceptAll(want).count() == 0 and got.count() == want.count()


@pytest.mark.parametrize("broadcast_rows", [1_000, 10])
def test_wide_vocabulary(spark, names, monkeypatch, broadcast_rows):
    """By broadcast join, and by numbering and joining without any broadcast."""
    want = {v: i for i, v in enumerate(sorted({r["name"] or "" for r in names.collect()}))}
    monkeypatch.setattr(encode, "BROADCAST_ROWS", broadcast_rows)
    monkeypatch.setattr(encode, "HOT_KEYS", 3)
    plan = encode.fit(names)
    assert plan["name"].size == len(want) == 201
    tokens = encode.encode(names, plan, keep=["pid"])
    got = names.join(tokens.withColumnRenamed("name", "token"), "pid").collect()
    assert len(got) == 900
    assert all(want[r["name"] or ""] == r["token"] for r in got)
    decoded = encode.decode(tokens, plan, keep=["pid"])
    assert decoded.exceptAll(names).count() == 0 and decoded.count() == 900


@pytest.mark.parametrize("literals", [64, 0])
def test_unseen(spark, monkeypatch, literals):
    monkeypatch.setattr(encode, "LITERALS", literals)
    plan = encode.fit(spark.createDataFrame([("a",), ("b",)], "x string"))
    other = spark.createDataFrame([("a",), ("z",), (None,)], "x string")
    coded = encode.encode(other, plan, unseen="code").collect()
    assert sorted(r["x"] for r in coded) == [-1, -1, 0]
    with pytest.raises(Exception, match="not in the vocabulary: "):
        encode.encode(other, plan).collect()
    missing = encode.unseen_values(other, plan).collect()
    assert {(r["column"], r["value"], r["n"]) for r in missing} == {("x", "z", 1), ("x", None, 1)}
    for token in (5, -1):
        with pytest.raises(Exception, match=f"token not in the vocabulary: {token}"):
            encode.decode(spark.createDataFrame([(token,)], "x int"), plan).collect()


def test_scaling(spark):
    rows = spark.createDataFrame([(10,), (20,), (30,)], "x int")
    plan = encode.fit(rows, overrides={"x": "continuous"})
    assert (plan["x"].low, plan["x"].span, plan["x"].mean, plan["x"].std) == (10, 20, 20, 10)
    later = spark.createDataFrame([(20,), (40,)], "x int")
    scaled = encode.encode(later, plan, as_vector="row")
    assert [r["x"] for r in scaled.collect()] == [0.5, 1.5]
    assert [r["row"] for r in scaled.collect()] == [[0.5], [1.5]]
    decoded = encode.decode(scaled, plan)
    assert decoded.dtypes == [("x", "int")] and decoded.collect() == later.collect()
    assert plan.weights() == {"x": None}
    timed = encode.fit(rows, overrides={"x": "time"})
    noon = spark.createDataFrame([(720,)], "x int")
    assert encode.encode(noon, timed).first()["x"] == 0.5
    assert encode.decode(encode.encode(noon, timed), timed).first()["x"] == 720
    with pytest.raises(ValueError, match="cycle"):
        scale.cycle_scale(F.col("x"), cycle=0)
    with pytest.raises(ValueError, match="range"):
        encode.fit(rows.where("x = 10"), overrides={"x": "continuous"})


def test_integers_survive_scaling(spark):
    rows = spark.range(10_007).select((F.col("id") * 3 - 76).cast("int").alias("x"))
    plan = encode.fit(rows)
    assert plan.kinds() == ["continuous"]
    assert encode.decode(encode.encode(rows, plan), plan).exceptAll(rows).count() == 0


def test_plan(spark):
    rows = spark.createDataFrame([(1, "a", 2), (2, "b", 3)], "pid int, x string, y int")
    plan = encode.fit(rows)
    assert plan.names() == ["x", "y"] and len(plan) == 2
    assert plan.sizes() == {"x": 2, "y": 2}
    assert plan.frame(spark).count() == 2
    assert encode.encode_column(rows, plan, "y").columns == ["y"]
    with pytest.raises(ValueError, match="not part"):
        encode.encode_column(rows, plan, "pid")
    with pytest.raises(ValueError, match="different value"):
        encode.fit(rows, forbid_identifiers=True)
    with pytest.raises(ValueError, match="not found"):
        encode.encode(rows.drop("x"), plan)


def test_tokens_from_probabilities(spark):
    probs = spark.createDataFrame([([0.1, 0.7, 0.7],)], "p array<double>")
    assert probs.select(arrays.most_likely(F.col("p"))).first()[0] == 1
    rows = spark.createDataFrame(
        [([0.2, 0.3, 0.5], u) for u in (0.1, 0.2, 0.99)], "p array<double>, u double"
    )
    got = rows.select(arrays.sampled(F.col("p"), F.col("u"))).collect()
    assert [r[0] for r in got] == [0, 1, 2]


def test_large_lookup_keeps_every_row(spark, monkeypatch):
    """Hot keys with and without a partner, cold ones with and without, and nulls."""
    monkeypatch.setattr(lookups, "HOT_KEYS", 2)
    facts = spark.range(1000).select(
        F.col("id").alias("pid"),
        F.when(F.col("id") % 3 == 0, 1)
        .when(F.col("id") % 3 == 1, 99)
        .when(F.col("id") % 7 == 0, None)
        .otherwise(F.col("id") % 40)
        .alias("k"),
    )
    table = spark.range(20).select(F.col("id").alias("k"), F.concat(F.lit("v"), "id").alias("v"))
    got = lookups.look_up(facts, table, "k", broadcast_rows=0)
    want = facts.join(table, "k", "left").select("pid", "k", "v")
    assert got.columns == ["pid", "k", "v"]
    assert got.exceptAll(want).count() == 0 and got.count() == 1000
    with pytest.raises(ValueError, match="not unique"):
        lookups.look_up(facts, table.union(table), "k")


def test_rows_of_a_hot_key_spread(spark):
    """Equal rows of a hot key land on many partitions of the join."""
    facts = spark.range(0, 40_000, 1, 64).select(F.when(F.col("id") % 3 > 0, 7).alias("k"))
    table = spark.range(20).select(F.col("id").alias("k"), F.lit("v").alias("v"))
    hot = spark.createDataFrame([(7,)], "k bigint")
    # Kept from being broadcast, as a large lookup would be.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        got = lookups.split_join(facts, table, "k", hot)
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 40_000 and got.where("v = 'v'").count() == 26_666
        assert len(sizes) == 8 and max(sizes) < 3 * 40_000 / 8
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_wide_values_are_not_broadcast(spark, monkeypatch):
    """Few rows, but more bytes than may be broadcast or written into a query."""
    monkeypatch.setattr(lookups, "BROADCAST_BYTES", 1_000)
    monkeypatch.setattr(encode, "BROADCAST_BYTES", 1_000)
    monkeypatch.setattr(encode, "LITERAL_BYTES", 500)
    facts = spark.range(40).select("id", (F.col("id") % 8).alias("k"))
    table = spark.range(6).select(F.col("id").alias("k"), F.repeat(F.lit("v"), 300).alias("v"))
    assert lookups.checked_size(table, "k") == (6, 6 * (16 + 300))
    got = lookups.look_up(facts, table, "k")
    assert got.count() == 40 and got.where("v is null").count() == 10
    texts = facts.select("id", F.concat(F.col("k"), F.repeat(F.lit("x"), 300)).alias("t"))
    plan = encode.fit(texts, include=["t"])
    assert plan["t"].bytes == 8 * 301
    assert not plan["t"].is_literal() and not plan["t"].is_small()
    tokens = encode.encode(texts, plan, keep=["id"])
    assert tokens.join(facts, "id").where("t <> k").count() == 0
    assert encode.decode(tokens, plan, keep=["id"]).exceptAll(texts).count() == 0


def test_pairs(spark):
    left = spark.range(5).select("id", F.lit("x").alias("a"))
    right = spark.range(5).select("id", F.lit("y").alias("b"))
    assert lookups.pair(left, right, "id").count() == 5
    for wrong in (right.where("id < 4"), right.union(right.limit(1))):
        with pytest.raises(ValueError, match="pair up"):
            lookups.pair(left, wrong, "id")
    assert lookups.key_gaps(left, right, "id").count() == 0
    with pytest.raises(ValueError, match="keys of the two tables differ"):
        lookups.require_same_keys(left, right.where("id < 4"), "id")

"""Every stage against brute force on its own input."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyweave.llm import mixing, toxicity
from test_decontaminate import brute
from test_mixing import brute_targets
from test_simhash import brute_classes, brute_fp

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def steps(spark, folder, tmp_path_factory):
    """Rows before and after every stage, each written and read again."""
    place = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{place}/{n}")
        docs = spark.read.parquet(f"{place}/{n}")
        out.append(docs)
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns(steps):
    assert all(df.columns == steps[0].columns for df in steps[:-1])
    assert steps[-1].columns == [*steps[0].columns, "shard"]


def test_rejected_documents_go(spark, folder, steps):
    model = toxicity.fit(steps[0], spark.read.parquet(f"{folder}/labels.parquet"))
    scores = toxicity.scored(steps[0], model).collect()
    assert ids(steps[1]) == sorted(r.doc_id for r in scores if r.score < 0.5)
    assert 0 < steps[1].count() < steps[0].count()


def test_one_of_each_class_stays(steps):
    rows = {r.doc_id: r.text for r in steps[1].collect()}
    classes = brute_classes({i: brute_fp(t) for i, t in rows.items()})
    assert ids(steps[2]) == sorted(set(classes.values()))


def test_contaminated_documents_go(steps, given):
    items = [(r["item_id"], r["text"]) for r in given("benchmark")]
    rows = [(r.doc_id, r.text) for r in steps[2].collect()]
    hit = {k[0] for k, v in brute(rows, items).items() if v[1]}
    assert ids(steps[3]) == sorted(i for i, _ in rows if i not in hit)


def test_mix_follows_what_it_takes(steps):
    taken = {r.doc_id: (r.taken, r["size"], r.source) for r in mixing.mix(steps[3]).collect()}
    copies = Counter(ids(steps[4]))
    assert all(abs(copies[i] - n / size) < 1 for i, (n, size, _) in taken.items() if size)
    sizes, got = defaultdict(int), defaultdict(int)
    for i, (_, size, source) in taken.items():
        sizes[source] += size
        got[source] += copies[i] * size
    targets = brute_targets(sizes)
    assert sum(abs(got[s] - targets[s]) for s in sizes) < 0.25 * sum(sizes.values())


def test_shards_are_even(steps):
    assert Counter(ids(steps[5])) == Counter(ids(steps[4]))
    rows = steps[5].select("shard", (F.octet_length("text") + 8).alias("size")).collect()
    load = Counter()
    for r in rows:
        load[r.shard] += r["size"]
    # Copies of a document stay together.
    assert max(load.values()) - min(load.values()) <= 3 * max(r["size"] for r in rows)


def test_run_is_the_stages(spark, folder, steps):
    got = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, r.shard) for r in got) == Counter((r.doc_id, r.shard) for r in steps[-1].collect())


ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, "same words here again", "en", "a", 1),
    (3, "same words here again", "en", "a", 1),
    (4, "same words here again", "en", "b", 1),
    (None, "something else entirely", "en", None, 1),
    (None, "and one without id", None, "b", 1),
    (5, "long " * 100_000, "en", "b", 1),
]


def test_odd_rows_and_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame(ODD, DOC)
    docs = docs.withColumns({c: F.lit("clash") for c in ("score", "fp", "doc", "size", "row", "copy")})
    for name, rows in (("odd", docs), ("empty", docs.limit(0))):
        rows.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
        spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(
            str(tmp_path / name / "benchmark.parquet")
        )
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert Counter((r.doc_id, r.text and r.text[:9]) for r in kept) == Counter(
        [(1, None), (3, "same word"), (None, "something"), (None, "and one w"), (5, "long long")]
    )
    assert kept[0].fp == "clash" and list(kept[0].asDict()) == docs.columns
    out = corpus_pipeline.run(spark, str(tmp_path / "odd"))
    assert out.columns == [*docs.columns, "shard"]
    # Documents without words give nothing to a mix.
    assert {r.doc_id for r in out.collect()} <= {3, 5, None}
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).collect() == []

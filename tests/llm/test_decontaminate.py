import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyweave.llm import decontaminate, shared

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, width=10):
    """{(id, text): (n_words, hit places, ids of items)}."""
    windows = {}
    for item, text in items:
        words = split(text)
        for at in range(max(1, len(words) - width + 1) if words else 0):
            windows.setdefault(tuple(words[at : at + width]), set()).add(item)
    lengths = {len(w) for w in windows}
    out = {}
    for doc, text in docs:
        words, hit, found = split(text), set(), set()
        for size in lengths:
            for at in range(len(words) - size + 1):
                if (key := tuple(words[at : at + size])) in windows:
                    hit.update(range(at, at + size))
                    found |= windows[key]
        out[doc, text] = (len(words), hit, {str(i) for i in found if i is not None})
    return out


def brute_near(docs, items, width=10, terms=5, span=20):
    """{(id, text): ids of items near}."""
    counts = Counter(w for d, t in set(docs) for w in split(t))
    needs = {}
    for item, text in items:
        words = split(text)
        for at in range(max(1, len(words) - width + 1) if words else 0):
            own = set(words[at : at + width])
            known = sorted((w for w in own if counts[w]), key=lambda w: (counts[w], w.encode()))
            if len(known) >= (least := min(terms, len(own))):
                needs.setdefault(frozenset(known[:least]), set()).add(item)
    out = {}
    for doc, text in docs:
        words = split(text)
        have, near = set(words), set()
        for need, found in needs.items():
            if need <= have and any(need <= set(words[s : s + span]) for s in range(len(words))):
                near |= found
        out[doc, text] = {str(i) for i in near if i is not None}
    return out


def test_query_against_brute_force(spark, folder, given):
    docs = [(r["doc_id"], r["text"]) for r in given("documents")]
    want = {k[0]: v for k, v in brute(docs, [(r["item_id"], r["text"]) for r in given("benchmark")]).items()}
    near = {k[0]: v for k, v in brute_near(docs, [(r["item_id"], r["text"]) for r in given("benchmark")]).items()}
    got = decontaminate.op1_decontaminate(spark, folder).collect()
    assert len(got) == len(docs)
    assert sum(r.contaminated for r in got) > 0
    for r in got:
        n_words, hit, items = want[r.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n_words, len(hit), len(items), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        # Every exact match is a proximity match.
        assert items <= near[r.doc_id] and r.n_near == len(near[r.doc_id])
        assert r.near_sha256 == hashlib.sha256(",".join(sorted(near[r.doc_id])).encode()).hexdigest()


LINE = "one two three four five six seven eight nine ten eleven twelve"
ITEMS = [
    (1, LINE),
    (2, "Short Item"),
    (3, "the the the the the the the the the the the"),
    (4, None),
    (5, "..."),
    (6, LINE.upper()),
    (None, "no id here"),
    (1, "one other text"),
    (7, "É a e i o u y é b c d"),
]
DOCS = [
    (1, f"x {LINE} y {LINE}"),
    (2, LINE.replace("three", "3")),
    (3, "short. item! a SHORT item"),
    (4, "the " * 40),
    (5, None),
    (6, ""),
    (7, "no id here, one other text"),
    (None, "short item"),
    (None, None),
    (8, "short item"),
    (8, "short item"),
    (8, "é a e i o u y é b c d"),
    (9, "É a e i o u y é b c"),
    (10, "word " * 100_000 + LINE),
]


@pytest.mark.parametrize("small", [200_000, 0])
def test_odd_rows(spark, monkeypatch, small):
    """Also with every table joined instead of broadcast."""
    monkeypatch.setattr(shared, "SMALL", small)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("doc", F.lit("clash"))
    search = decontaminate.Search(docs, items)
    got = [(r.doc_id, r.n_words, r.n_hit, sorted(r["items"])) for r in search.report().collect()]
    want = [(k[0], n, len(hit), sorted(ids)) for k, (n, hit, ids) in brute(DOCS, ITEMS).items()]
    assert sorted(got, key=str) == sorted(want, key=str)
    near = [(r.doc_id, r.n_words, sorted(r.near)) for r in search.report().collect()]
    want = [(k[0], len(split(k[1])), sorted(ids)) for k, ids in brute_near(DOCS, ITEMS).items()]
    assert sorted(near, key=str) == sorted(want, key=str)
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns
    hit = {k for k, v in brute(DOCS, ITEMS).items() if v[1]}
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, (d for d in DOCS if d not in hit)))


def test_proximity(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha omega")], "item_id long, text string")
    rows = [(1, "x gamma y beta z alpha"), (2, "alpha " + "x " * 30 + "beta gamma"), (3, "alpha beta"), (4, "omega alpha")]
    search = decontaminate.Search(spark.createDataFrame(rows, "doc_id long, text string"), items)
    assert sorted((r.doc_id, r.item_id, r.start) for r in search.near().collect()) == [(1, 1, 0), (4, 2, 0)]


def test_shuffled_items_are_near(spark, folder, given):
    """Copies of items with their words in another order, and some words put between."""
    rng, words = random.Random(4), {r["item_id"]: split(r["text"]) for r in given("benchmark")}
    items = {i: w for i, w in words.items() if len(w) >= 10}
    docs = []
    for i, w in items.items():
        at = rng.randrange(len(w) - 9)
        window = w[at : at + 10]
        rng.shuffle(window)
        mixed = [x for n, word in enumerate(window) for x in ([word, "zwischen"] if n % 2 else [word])]
        docs.append((i, " ".join(["vorher"] * 30 + mixed + ["danach"] * 30)))
    docs += [(10_000, "vorher zwischen danach " * 40)]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    search = decontaminate.Search(rows, spark.read.parquet(f"{folder}/benchmark.parquet"))
    near = {r.doc_id: {int(i) for i in r.near} for r in search.report().collect()}
    assert all(i in near[i] for i in items) and near[10_000] == set()
    assert search.phrases().count() < len(items) // 4


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.Search(docs.limit(0), items).report().collect() == []
    assert {r.n_hit for r in decontaminate.Search(docs, items.limit(0)).report().collect()} == {0}

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given as cases
from hypothesis import settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyweave.llm import runs


def brute_lyndon(ranks):
    """By definition: the longest prefix of every suffix that is smaller than all of its own suffixes."""
    return [
        max(
            size
            for size in range(1, len(ranks) - i + 1)
            if all(ranks[i : i + size] < ranks[j : i + size] for j in range(i + 1, i + size))
        )
        for i in range(len(ranks))
    ]


def brute_runs(words, least, exponent):
    """Every stretch of equal words a period apart, without those that a smaller period has."""
    _, w = np.unique(np.array(words, dtype=object).astype(str), return_inverse=True) if words else (None, np.zeros(0))
    n, found = len(words), []
    for q in range(1, n // exponent + 1):
        same = np.concatenate(([False], w[:-q] == w[q:], [False]))
        starts, stops = np.flatnonzero(~same[:-1] & same[1:]), np.flatnonzero(same[:-1] & ~same[1:])
        for s, e in zip(starts.tolist(), stops.tolist(), strict=True):
            size = e - s + q
            if size >= max(least, exponent * q) and not any((s, size, p) in found for p in range(1, q) if q % p == 0):
                found.append((s, size, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute_runs(words, 6, 4)
    dropped = {i for s, size, q in found for i in range(s + q, s + size)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in found)
    left = " ".join(w for i, w in enumerate(words) if i not in dropped)
    sha = [hashlib.sha256(t.encode()).hexdigest() for t in (lines, left)]
    return (doc_id, len(found), *(best or [None] * 3), 1000 * best[1] // best[2] if best else None, *sha)


def test_query_against_brute_force(spark, folder, given):
    want = sorted(brute_row(r["doc_id"], r["text"]) for r in given("documents"))
    got = runs.op12_runs(spark, folder)
    assert [t for _, t in got.dtypes] == ["bigint"] * 6 + ["string"] * 2
    assert sorted(map(tuple, got.collect())) == want
    assert sum(r[1] > 0 for r in want) > 5


@settings(max_examples=400, deadline=None)
@cases(st.lists(st.integers(0, 3), max_size=12))
def test_lyndon_array(text):
    kinds = sorted(set(text))
    ranks = [kinds.index(t) for t in text]
    assert runs.lyndon(ranks) == brute_lyndon(ranks)


def test_lyndon_array_of_long_texts():
    """By next smaller suffixes, which end the longest Lyndon words."""
    rng = np.random.default_rng(3)
    for size, kinds in ((400, 2), (400, 50), (300, 1)):
        ranks = np.unique(rng.integers(0, kinds, size), return_inverse=True)[1].tolist()
        nearest = [next((j for j in range(i + 1, size) if ranks[j:] < ranks[i:]), size) for i in range(size)]
        assert runs.lyndon(ranks) == [j - i for i, j in enumerate(nearest)]


texts = st.lists(st.sampled_from("abc"), max_size=30)


@settings(max_examples=400, deadline=None)
@cases(texts, texts, texts, st.integers(1, 6), st.integers(1, 8), st.integers(2, 4))
def test_runs_of_any_text(head, root, tail, times, least, exponent):
    words = head + root * times + tail
    assert runs.runs_of(words, least, exponent) == brute_runs(words, least, exponent)


def test_few_passes_find_the_same(monkeypatch):
    rng = np.random.default_rng(5)
    words = rng.integers(0, 4, 3000).tolist() + list(range(40)) * 5
    want = runs.runs_of(words)
    monkeypatch.setattr(runs, "PASSES", 1)
    assert runs.runs_of(words) == want == brute_runs(words, 6, 4)


def test_long_texts_of_one_word_and_of_all_words():
    assert runs.runs_of(["x"] * 200_000) == [(0, 200_000, 1)]
    words = list(range(20_000))
    assert runs.runs_of(words) == []
    assert runs.runs_of(words * 4) == [(0, 80_000, 20_000)] == runs.runs_of(words[::-1] * 4)


def test_words_of_several_runs_go_once():
    # "a" four times in a row, within a period that stands four times.
    words = (["a"] * 4 + ["b"]) * 4
    found = runs.runs_of(words, least=4)
    assert found == [(0, 4, 1), (0, 20, 5), (5, 4, 1), (10, 4, 1), (15, 4, 1)]
    assert runs.kept_words(words, found) == ["a", "b"]


def test_longest_run_and_digest(spark):
    rows = [[], [(3, 8, 2), (1, 16, 4), (1, 12, 3)], [(0, 9, 2), (5, 13, 3)], [(0, 13, 3), (5, 9, 2)]]
    kind = "array<struct<start: bigint, length: bigint, period: bigint>>"
    df = spark.createDataFrame([(n, r) for n, r in enumerate(rows)], f"n int, runs {kind}")
    got = df.select(runs.longest_run().alias("best"), runs.digest_of().alias("sha")).orderBy("n").collect()
    assert [r.best and tuple(r.best) for r in got] == [None, (1, 12, 3), (0, 9, 2), (5, 9, 2)]
    assert [r.sha for r in got[:3]] == [
        hashlib.sha256(t).hexdigest() for t in (b"", b"3,8,2\n1,16,4\n1,12,3\n", b"0,9,2\n5,13,3\n")
    ]


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, "x " * 9), (4, "y\u00a0y " * 5), (5, "same " * 30), (5, "same " * 30)]
    rows.append((6, " ".join(map(str, range(300_000)))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("runs", "start", "collapsed")})
    got = sorted((r.doc_id or 0, [tuple(x) for x in r.runs], r.collapsed[:10]) for r in runs.collapsed(docs).collect())
    assert got == [
        (0, [(0, 9, 1)], "x"),
        (1, [], ""),
        (2, [], ""),
        (3, [], ""),
        (4, [], "y\u00a0y y\u00a0y y\u00a0"),
        (5, [(0, 30, 1)], "same"),
        (5, [(0, 30, 1)], "same"),
        (6, [], "0 1 2 3 4 "),
    ]
    assert runs.collapsed(docs.limit(0)).collect() == []
    kept = runs.collapsed(docs, keep=("doc_id", "start")).filter("doc_id = 2").first()
    assert (kept.start, kept.runs) == ("clash", [])


def test_query_on_rows_without_an_id_and_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([(None, "a b " * 8), (12, None)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "odd" / "documents.parquet"))
    docs.limit(0).write.parquet(str(tmp_path / "empty" / "documents.parquet"))
    got = {r.doc_id: r for r in runs.op12_runs(spark, str(tmp_path / "odd")).collect()}
    assert (got[None].n_runs, got[None].length, got[None].exponent_milli) == (1, 16, 8000)
    assert tuple(got[12]) == brute_row(12, None)
    assert runs.op12_runs(spark, str(tmp_path / "empty")).collect() == []

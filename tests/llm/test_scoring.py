import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyweave.llm import lattice, scoring

DOC = "doc_id long, text string"


def segmentations(word, pieces, weights):
    """Weight and piece numbers of every segmentation of a word with its beginning."""
    table = np.exp(weights.piece)
    if not word:
        yield 1.0, []
        return
    spelt = [int(n) for n in pieces.bytes[list(word[0].encode())]]
    arcs = [(1, float(np.prod(table[spelt])), spelt)]
    arcs += [(len(t), float(table[n]), [n]) for n, t in enumerate(pieces.texts) if word.startswith(t)]
    for length, weight, numbers in arcs:
        for rest, more in segmentations(word[length:], pieces, weights):
            yield weight * rest, numbers + more


@pytest.fixture(scope="module")
def small():
    texts = ["▁a", "▁ab", "▁", "a", "b", "c", "ab", "bc", "abc", "é", "cab", "a▁"]
    pieces = lattice.make_pieces(texts, [-float(n) for n in range(len(texts))])
    rng = np.random.default_rng(3)
    return pieces, lattice.normalise(pieces, rng.random(len(texts) + 256) * 5000, 900.0)


WORDS = ["a", "abc", "cabab", "é", "bé", "abcab", "x", "", "aaaa"]


def test_sums_over_all_segmentations(small):
    pieces, weights = small
    got = lattice.Lattice(pieces, weights, WORDS).probabilities()
    for word, p in zip(WORDS, got, strict=True):
        want = sum(w for w, _ in segmentations(lattice.BEGIN + word, pieces, weights)) * math.exp(weights.stop)
        assert p == pytest.approx(math.log(want), rel=1e-9)


def test_expected_uses(small):
    pieces, weights = small
    counts = np.arange(1.0, len(WORDS) + 1)
    want = np.zeros(len(weights.piece))
    for word, n in zip(WORDS, counts, strict=True):
        found = list(segmentations(lattice.BEGIN + word, pieces, weights))
        total = sum(w for w, _ in found)
        for w, numbers in found:
            for number in numbers:
                want[number] += n * w / total
    assert np.allclose(lattice.Lattice(pieces, weights, WORDS).uses(counts), want)


def test_batches_hold_every_word_once():
    rng = random.Random(1)
    words = ["x" * rng.randint(0, 40) for _ in range(500)] + ["y" * 5000]
    groups = list(lattice.batches(words, cells=1000))
    assert sorted(i for g in groups for i in g) == list(range(len(words)))


def longhand(texts, learn, model):
    """Scores of all texts from the model's weights, word by word."""
    train = Counter(w for t, yes in zip(texts, learn, strict=True) if yes for w in (t or "").encode().split())
    ends = sum(learn)
    total, kinds = sum(train.values()) + ends, len(train) + (ends > 0)
    words = sorted({w for t in texts for w in (t or "").encode().split()})
    spelled = {}
    for group in lattice.batches([w.decode() for w in words]):
        made = lattice.Lattice(model.pieces, model.weights, [words[i].decode() for i in group]).probabilities()
        spelled |= {words[i]: p for i, p in zip(group, made.tolist(), strict=True)}

    def share(w):
        """Natural logarithm; words that are too unlikely for a float are in pieces only."""
        left = model.discount * kinds / total if total else 0.5
        own = max(0, train[w] - model.discount) / total if total else 0.0
        return math.log(own + left * math.exp(spelled[w])) if own else math.log(left) + spelled[w]

    end = (ends - model.discount) / total if total else 0.5
    out = []
    for text in texts:
        own = (text or "").encode().split()
        base = sum(math.log10((train[w] + 1) / (total + kinds + 1)) for w in own)
        base += math.log10((ends + 1) / (total + kinds + 1))
        drawn, score = Counter(), 0.0
        for n, w in enumerate(own):
            if drawn[w]:
                score += math.log10(scoring.URN * math.exp(share(w)) + drawn[w])
            else:
                score += math.log10(scoring.URN) + share(w) / math.log(10)
            score -= math.log10(scoring.URN + n)
            drawn[w] += 1
        score += math.log10(scoring.URN * end / (scoring.URN + len(own)))
        known = sum(train[w] > 0 for w in own) + (ends > 0)
        alone = sum(spelled[w] / math.log(10) + math.log10(1 - end) for w in own) + math.log10(end)
        out.append((len(own) + 1, known, total, base, score, alone))
    return out


@pytest.mark.parametrize("head", [50_000, 100])
def test_query_against_longhand(spark, folder, given, monkeypatch, head):
    monkeypatch.setattr(scoring, "HEAD", head)
    rows = given("documents")
    held_out = [zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2 for r in rows]
    learn = F.coalesce(scoring.fold(F.col("doc_id")) != scoring.HELD_OUT, F.lit(True))
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("text", learn.alias("learn"))
    model = scoring.Model(docs)
    want = longhand([r["text"] for r in rows], [not h for h in held_out], model)
    got = {r.doc_id: r for r in scoring.op3_lm_score(spark, folder).collect()}
    assert len(got) == len(rows)
    for r, h, (n, known, total, base, score, alone) in zip(rows, held_out, want, strict=True):
        g = got[r["doc_id"]]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (h, n, known, total)
        assert g.base_score == pytest.approx(base, rel=1e-9)
        assert g.score == pytest.approx(score, rel=1e-9)
        assert g.lattice_score == pytest.approx(alone, rel=1e-9)


def test_corpus_words_are_likelier_than_others(spark):
    rows = [("the cat sat on the mat", True)] * 20 + [("the cat sat on the mat", False), ("qzx vvk wq jjk the xx", False)]
    docs = spark.createDataFrame(rows, "text string, learn boolean")
    got = scoring.score(docs, scoring.Model(docs)).filter("not learn").orderBy("score").collect()
    assert (got[0].n_known, got[1].n_known) == (2, 7)
    assert got[0].score < got[1].score - 10


ODD = [(None, None), (1, ""), (2, " \n\t"), (3, "x" * 20_000 + " y" * 50_000), (None, "a \x0b b"), (4, "a a a"), (4, "a a a"), (5, "　 é é")]


@pytest.mark.parametrize("learn", [True, False])
def test_odd_rows(spark, learn):
    docs = spark.createDataFrame(ODD, DOC).withColumn("learn", F.lit(learn))
    docs = docs.withColumns({c: F.lit("clash") for c in ("word", "rest", "times", "score2")})
    model = scoring.Model(docs.select("text", "learn"))
    want = longhand([t for _, t in ODD], [learn] * len(ODD), model)
    got = scoring.score(docs.select("doc_id", "text", "learn"), model).collect()
    key = lambda r: (r[0], round(r[1], 6), round(r[2], 6))
    assert sorted(key((r.n_tokens, r.base_score, r.score)) for r in got) == sorted(key((w[0], w[3], w[4])) for w in want)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "text string, learn boolean")
    assert scoring.score(docs, scoring.Model(docs)).collect() == []


def test_frequent_words_teach_pieces_no_more_than_rare_ones(spark):
    """Pieces go by different words, so repeating a text changes none of their weights."""
    once = [("alpha beta gamma", True), ("delta", True)]
    models = [scoring.Model(spark.createDataFrame(rows, "text string, learn boolean")) for rows in (once, once + once[:1] * 50)]
    assert np.allclose(models[0].weights.piece, models[1].weights.piece) and models[0].weights.stop == models[1].weights.stop


def test_query_counts_words_in_lower_case(spark, tmp_path):
    """Only A-Z is folded, in learnt and in held out texts, and other letters stay as they are."""
    texts = ["The the THE cat", "É é Cat", "the CAT sat", None, "Dog", "ΣAs", "cAt\u2028x Sat"] * 3
    spark.createDataFrame(list(enumerate(texts)), DOC).write.parquet(str(tmp_path / "documents.parquet"))
    held_out = [zlib.crc32(str(n).encode()) % 7 == 2 for n in range(len(texts))]
    fold = str.maketrans({chr(n): chr(n + 32) for n in range(ord("A"), ord("Z") + 1)})
    words = [re.findall("[^\x20\x09-\x0d]+", (t or "").translate(fold)) for t in texts]
    train = Counter(w for own, h in zip(words, held_out, strict=True) if not h for w in [*own, None])
    total, kinds = sum(train.values()), len(train)
    assert any(held_out) and train["the"] > 3 and train["É"] and train["é"]
    got = {r.doc_id: r for r in scoring.op3_lm_score(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for n, (own, h) in enumerate(zip(words, held_out, strict=True)):
        tokens, g = [*own, None], got[n]
        known = sum(train[w] > 0 for w in tokens)
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (h, len(tokens), known, total)
        base = sum(math.log10((train[w] + 1) / (total + kinds + 1)) for w in tokens)
        assert g.base_score == pytest.approx(base, rel=1e-9)
    # The score is of the folded text too.
    folded = tmp_path / "folded"
    low = [(n, t and t.translate(fold)) for n, t in enumerate(texts)]
    spark.createDataFrame(low, DOC).write.parquet(str(folded / "documents.parquet"))
    for r in scoring.op3_lm_score(spark, str(folded)).collect():
        assert got[r.doc_id].score == pytest.approx(r.score, rel=1e-9)


def test_words_are_those_between_ascii_white_space():
    texts = [None, "", " \n\t", "  a \x0b B\r\x0c", "　 é É Ab\x1cC\u0085d e  f", "A a A"]
    want = [(text or "").encode().lower().split() for text in texts]
    for start in (0, 3):
        rows, words, codes = scoring._words(pa.array(texts, pa.string()).slice(start))
        got = [[] for _ in texts[start:]]
        for row, code in zip(rows.tolist(), codes.tolist(), strict=True):
            got[row].append(words[code].as_py())
        assert got == want[start:] and len(set(words.to_pylist())) == len(words)


@pytest.mark.parametrize("counted", [1, 40, 10**6])
def test_counts_of_many_batches(spark, monkeypatch, counted):
    monkeypatch.setattr(scoring, "COUNTED", counted)
    rows = [(None if i % 11 == 0 else f"W{i % 3} w{i % 7} w{i % 7}\tx{i}", i % 4 != 0) for i in range(60)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        docs = spark.createDataFrame(rows, "text string, learn boolean").coalesce(2)
        got = {bytes(r.word).decode(): (r.train, r.all) for r in scoring.word_counts(docs).collect()}
        scored = scoring.score(docs, scoring.Model(docs)).select("n_tokens", "n_known").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    every = Counter(w for t, _ in rows for w in (t or "").lower().split())
    train = Counter(w for t, learn in rows if learn for w in (t or "").lower().split())
    assert got == {w: (train[w], n) for w, n in every.items()}
    want = [((t or "").lower().split()) for t, _ in rows]
    assert sorted(map(tuple, scored)) == sorted((len(w) + 1, sum(train[x] > 0 for x in w) + 1) for w in want)

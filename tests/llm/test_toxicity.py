import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.llm import toxicity

DOC, LABEL = "doc_id long, text string", "doc_id long, toxic int"


def counted(words):
    """Grams of (word, toxic) rows, as the Spark job counts them."""
    grams = {}
    for word, toxic in words:
        line = toxicity.START * (toxicity.ORDER - 1) + word + toxicity.END
        for at in range(len(word) + 1):
            row = grams.setdefault(line[at : at + toxicity.ORDER], [0, 0])
            row[0 if toxic else 1] += 1
    return [(g, a, b) for g, (a, b) in grams.items()]


def kneser_ney(grams, side):
    """P(character | context) of a class by the textbook recursion."""

    def kinds_before(context, character, n):
        """Different characters before a gram of length n, in the class or (from SHARED down) in both."""
        own = [g for g, a, b in grams if n <= toxicity.SHARED or (a, b)[side]]
        end = context[len(context) - n + 1 :] + character
        return len({g[-n - 1 :] for g in own if g.endswith(end)})

    def count(context, character, n):
        if n == toxicity.ORDER:
            return sum((a, b)[side] for g, a, b in grams if g == context + character)
        return kinds_before(context, character, n)

    letters = {g[-1] for g, _, _ in grams}

    def p(context, character, n):
        if n == 0:
            return 1 / (len(letters) + 1)
        counts = {c: count(context, c, n) for c in letters}
        lower = p(context, character, n - 1)
        if not (total := sum(counts.values())):
            return lower
        kinds = sum(1 for v in counts.values() if v)
        return (max(0, counts.get(character, 0) - 0.75) + 0.75 * kinds * lower) / total

    return p


def test_evidence_against_the_textbook():
    rng = random.Random(1)
    words = [("".join(rng.choices("abc", k=rng.randint(1, 4))), n % 3 == 0) for n in range(40)] + [("idiot", True)]
    grams = counted(words)
    model = toxicity.build([g for g, _, _ in grams], *(np.array([g[n] for g in grams]) for n in (1, 2)))
    toxic, plain = kneser_ney(grams, 0), kneser_ney(grams, 1)
    for word in ("abc", "idiot", "idio", "cab", "zz"):
        line = toxicity.START * (toxicity.ORDER - 1) + word + toxicity.END
        whole = 0.0
        for at in range(len(word) + 1):
            gram = line[at : at + toxicity.ORDER]
            want = [p(gram[:-1], gram[-1], toxicity.ORDER) for p in (toxic, plain)]
            found = model.evidence(toxicity._codes([gram]).reshape(1, -1))[0]
            assert found == pytest.approx(math.log(want[0] / want[1]), abs=1e-9)
            whole += found
        assert model.of_words(["zz", word, "a"])[1] == pytest.approx(whole)


def test_grams_are_counted_once_a_text(spark):
    rows = [("Ab ab 12", 1), ("ab 99", 0), (None, 0), ("", 1)]
    got = toxicity._grams(spark.createDataFrame(rows, "text string, toxic int")).collect()
    want = counted([("ab", True), ("00", True), ("ab", False), ("00", False)])
    assert sorted(tuple(r) for r in got) == sorted(want)


def made(n, seed=3):
    """Texts of invented words, a third of them with one word of a toxic family; labels of all."""
    rng = random.Random(seed)
    parts = ["on", "er", "th", "ing", "re", "an"]
    word = lambda: "".join(rng.choices(parts, k=rng.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        words, toxic = [word() for _ in range(rng.randint(5, 60))], int(i % 3 == 0)
        if toxic:
            words[rng.randrange(len(words))] = "zorg" + word()
            words.append("Zorg" + word())
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    return docs, labels


def test_held_out_accuracy(spark, tmp_path):
    docs, labels = made(600)
    spark.createDataFrame(docs, DOC).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, LABEL).write.parquet(str(tmp_path / "labels.parquet"))
    got = toxicity.op10_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(docs)
    truth = dict(labels)
    held = [r for r in got if r.held_out]
    assert 80 < len(held) < 160
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_held_out_labels_are_not_read(spark):
    docs, labels = made(200)
    frame = spark.createDataFrame(docs, DOC)
    rows = spark.createDataFrame(labels, LABEL)
    flipped = rows.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = toxicity.fit(frame, rows), toxicity.fit(frame, flipped)
    assert one.weights == two.weights
    for a, b in zip(one.tables, two.tables, strict=True):
        assert np.array_equal(a.grams, b.grams) and np.array_equal(a.shares, b.shares)


def test_odd_rows(spark):
    docs, labels = made(120)
    docs += [(1000, None), (1001, ""), (None, "zorgon"), (1002, "on " * 200_000 + "zorger zorgth"), (1002, "on")]
    labels += [(None, 1), (5, None), (1001, 0), (1001, 1), (9999, 1)]
    frame = spark.createDataFrame(docs, DOC).withColumns({c: F.lit("clash") for c in ("score", "toxic", "features", "fold")})
    model = toxicity.fit(frame, spark.createDataFrame(labels, LABEL))
    got = toxicity.scored(frame, model).collect()
    assert len(got) == len(docs)
    assert all(0 <= r.score <= 1 and r.features == "clash" for r in got)
    empty = {r.score for r in got if not r.text}
    assert len(empty) == 1


@pytest.mark.parametrize("labels,rate", [([], 0.0), ([(1, 0), (2, 0), (3, 0)], 0.0), ([(1, 1), (2, 1), (3, 1)], 1.0)])
def test_too_few_labels(spark, labels, rate):
    docs = spark.createDataFrame([(i, "a b") for i in range(5)], DOC)
    model = toxicity.fit(docs, spark.createDataFrame(labels, LABEL))
    assert {r.score for r in toxicity.scored(docs, model).collect()} == {rate}
    assert toxicity.scored(docs.limit(0), model).collect() == []
    # Nothing is known to tell documents apart by, so none is rejected.
    assert toxicity.reject(docs, model).count() == 5


def longhand(model, text):
    """The score of a text, character by character."""
    low_tail, high_tail = toxicity.TAILS
    alike = str.maketrans(*toxicity.ALIKE)
    lowered = "".join(c.lower() if c < "\x80" else c for c in (text or "").translate(alike))
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)

    def evidence(word):
        line = toxicity.START * (toxicity.ORDER - 1) + word + toxicity.END
        grams = [line[at : at + toxicity.ORDER] for at in range(len(word) + 1)]
        return sum(model.evidence(toxicity._codes([g]).reshape(1, -1))[0] for g in grams)

    found = {w: evidence(w) for w in words}
    kinds = max(1, len(found))
    capped = [min(e, toxicity.MOST) for e in found.values() if e > low_tail]
    low, high = sum(e - low_tail for e in capped), sum(max(0.0, e - high_tail) for e in capped)
    features = [
        sum(found[w] for w in words) / max(1, sum(len(w) + 1 for w in words)),
        max(capped, default=0.0),
        math.log1p(len(words)),
        math.log1p(low),
        low / kinds,
        math.log1p(high),
        high / kinds,
    ]
    z = model.weights[0] + sum(w * f for w, f in zip(model.weights[1:], features, strict=True))
    return 1 / (1 + math.exp(-z))


def test_every_score_of_the_query_longhand(spark, folder, given):
    rows = given("documents")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    got = {r.doc_id: r for r in toxicity.op10_toxicity(spark, folder).collect()}
    assert len(got) == len(rows)
    for r in rows:
        want, row = longhand(model, r["text"]), got[r["doc_id"]]
        assert row.score == pytest.approx(want, abs=1e-9)
        assert row.held_out == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and row.predicted == (row.score >= 0.5)


def few(spark, toxic_folds, n=200):
    """The model and texts where toxic labels are kept in some folds only, and as many as given there."""
    docs, labels = made(n)
    left = dict(toxic_folds)
    kept = []
    for i, toxic in labels:
        fold = zlib.crc32(str(i).encode()) % 5
        if toxic and not left.get(fold, 0):
            continue
        left[fold] = left.get(fold, 0) - toxic
        kept.append((i, toxic))
    frame = spark.createDataFrame(docs, DOC)
    model = toxicity.fit(frame, spark.createDataFrame(kept, LABEL))
    return model, {r.doc_id: r.score for r in toxicity.scored(frame, model).collect()}, dict(labels)


@pytest.mark.parametrize("toxic_folds", [{2: 9, 3: 9}, {1: 12}, {0: 5, 2: 1}])
def test_a_class_that_the_regression_lacks(spark, toxic_folds):
    """No toxic label to calibrate by, or none to model, or a single one in all: texts are told apart all the same."""
    model, scores, truth = few(spark, toxic_folds)
    assert model.base_rate is None and len(set(scores.values())) > 50
    toxic, plain = ([scores[i] for i in scores if truth[i] == t] for t in (1, 0))
    above = sum(a > b for a in toxic for b in plain) / (len(toxic) * len(plain))
    assert above > (0.9 if len(toxic_folds) < 2 or 3 in toxic_folds else 0.7)

"""Toxicity by class-conditional Kneser-Ney models.

Two models of the characters of words, one of toxic and one of ordinary texts, are compared by their
length-normalised log-likelihoods. Each is an interpolated Kneser-Ney model: the longest grams by their counts, shorter
ones by how many different characters come before them in texts of the class. The shortest share the
continuation counts of all texts, so an expression that is rare in both classes is as
likely in both and says nothing.

A few expressions in a long text would drown in its mean, so the evidence of its words beyond ``TAILS`` counts
too, each word once. A logistic regression turns these, by length and in all, into a score.

The models are fitted on a bounded sample of the labelled rows: ``ROWS`` texts of each class, and
``FOLD_ROWS`` others for the regression, chosen by hash. So the model has a bounded size, however many
rows there are to score, and is sent to the tasks once. Scoring reads every text whole, in one pass without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm.registry import query, table
from tallyweave.llm.shared import NOT_ALNUM, alnum_words, stored

ORDER = 6
#: Orders above this one are counted by class.
SHARED = 3
DISCOUNT = 0.75
START, END = "\x02", "\x03"
#: Labelled texts of each class that the models and the regression are fitted on.
ROWS, FOLD_ROWS = 6000, 2000
#: Of ``FOLDS`` parts of the ids, labels of ``HELD_OUT`` are never read and ``CALIBRATE`` fits the regression.
FOLDS, HELD_OUT, CALIBRATE = 5, 0, 1
#: A text with this score or more is taken for toxic.
LIMIT = 0.5
#: Weight of the mean evidence of a character where labels are too few for a regression.
SLOPE = 20.0
#: Words whose evidence a task remembers, texts that it takes at a time, and characters of words looked up at a time.
REMEMBERED, TEXTS, CHARACTERS = 200_000, 500, 500_000
#: Evidence of a word, in nats, is counted beyond each of these and up to ``MOST``.
TAILS, MOST = (1.0, 3.0), 12.0
FEATURES = ("mean", "top", "size", "all_1", "rate_1", "all_3", "rate_3")
#: Upper case and digits of a word, made alike.
ALIKE = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000")


def fold(doc_id: Column) -> Column:
    """The part that an id belongs to; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


@dataclass
class Table:
    """Of one order: sorted hashes of grams with their discounted shares in their contexts, and sorted hashes of
    contexts with what these leave for shorter grams. Shares and rests have a row for toxic and one for ordinary texts.
    """

    grams: np.ndarray
    shares: np.ndarray
    contexts: np.ndarray
    rests: np.ndarray


@dataclass
class Model:
    """``tables`` by order from 1, and the probability of a character that no text has.

    ``weights`` are the regression's, beginning with the constant; ``base_rate`` is the score of every text if a
    class has no labels to learn from.
    """

    tables: list[Table]
    unseen: float
    weights: tuple[float, ...] = ()
    base_rate: float | None = None

    def evidence(self, codes: np.ndarray) -> np.ndarray:
        """log P(last character | those before) of toxic less that of ordinary texts, for rows of ``ORDER`` code points."""
        p = np.full((2, len(codes)), self.unseen)
        for n, known in enumerate(self.tables, 1):
            own = _found(known.grams, known.shares, _hashes(codes[:, -n:]), 0.0)
            p = own + _found(known.contexts, known.rests, _hashes(codes[:, -n:-1]), 1.0) * p
        return np.log(p[0] / p[1])

    def of_words(self, words: list[str]) -> np.ndarray:
        """The evidence of every word: the sum over its characters and its end."""
        lines = [START * (ORDER - 1) + word + END for word in words]
        sizes = np.array([len(line) for line in lines])
        codes = _codes(lines)
        windows = np.lib.stride_tricks.sliding_window_view(codes, ORDER)
        # Windows that reach into the next word are left out.
        ends = np.cumsum(sizes)
        starts = np.arange(len(windows))
        inside = starts + ORDER <= np.repeat(ends, sizes)[: len(windows)]
        windows = windows[inside]
        _, first, where = np.unique(_hashes(windows), return_index=True, return_inverse=True)
        found = self.evidence(windows[first])[where]
        word = np.repeat(np.arange(len(words)), sizes)[: len(inside)][inside]
        return np.bincount(word, found, minlength=len(words))


def _codes(lines: list[str]) -> np.ndarray:
    return np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _hashes(codes: np.ndarray) -> np.ndarray:
    """Of every row of code points, 64 bits."""
    total = np.zeros(len(codes), dtype=np.uint64)
    for column in codes.T:
        total = (total ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return total


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
    """The columns of ``values`` at ``wanted`` among the sorted ``keys``."""
    if not len(keys):
        return np.full((2, len(wanted)), default)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[:, at], default)


def _interpolate(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hashes and discounted shares of different grams, hashes of their contexts and what these leave."""
    contexts, place = np.unique(_hashes(codes[:, :-1]), return_inverse=True)
    total = np.bincount(place, counts, minlength=len(contexts))
    rests = DISCOUNT * np.bincount(place, minlength=len(contexts)) / total
    return _hashes(codes), (counts - DISCOUNT) / total[place], contexts, rests


def _shorter(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different grams without their first character, and how many different ones come before each."""
    _, first, counts = np.unique(_hashes(codes[:, 1:]), return_index=True, return_counts=True)
    return codes[first, 1:], counts.astype(float)


def _both(sides: list[tuple[np.ndarray, np.ndarray]], default: float) -> tuple[np.ndarray, np.ndarray]:
    """One sorted table of two classes' keys and values."""
    keys = np.unique(np.concatenate([k for k, _ in sides]))
    values = np.full((2, len(keys)), default)
    for side, (own, value) in enumerate(sides):
        values[side, np.searchsorted(keys, own)] = value
    return keys, values


def build(grams: list[str], toxic: np.ndarray, ordinary: np.ndarray) -> Model:
    """From the counts of every different gram of ``ORDER`` characters in toxic and in ordinary texts."""
    every = _codes(grams).reshape(-1, ORDER)
    sides = [(every[n > 0], n[n > 0].astype(float)) for n in (toxic, ordinary)]
    tables = []
    for _ in range(ORDER - SHARED):
        made = [_interpolate(*side) for side in sides]
        tables.append(Table(*_both([m[:2] for m in made], 0.0), *_both([m[2:] for m in made], 1.0)))
        sides = [_shorter(codes) for codes, _ in sides]
    codes, counts = every, None
    for _ in range(ORDER - SHARED):
        codes, counts = _shorter(codes)
    letters = 0
    for _ in range(SHARED):
        made = _interpolate(codes, counts)
        tables.append(Table(*_both([made[:2]] * 2, 0.0), *_both([made[2:]] * 2, 1.0)))
        letters = len(codes)
        codes, counts = _shorter(codes)
    return Model(tables[::-1], 1.0 / (letters + 1))


def _grams(texts: DataFrame) -> DataFrame:
    """(gram, toxic, ordinary): counts in the different words of each of the (text, toxic) rows."""
    alike = F.array_distinct(alnum_words(F.translate("text", *ALIKE)))
    words = texts.select("toxic", F.explode(alike).alias("word"))
    words = words.groupBy("word").agg(
        F.count(F.when(F.col("toxic") == 1, 1)).alias("toxic"), F.count(F.when(F.col("toxic") == 0, 1)).alias("ordinary")
    )
    line = F.concat(F.lit(START * (ORDER - 1)), "word", F.lit(END))
    at = F.explode(F.sequence(F.lit(1), F.char_length("word") + 1)).alias("at")
    grams = words.select(line.alias("line"), "toxic", "ordinary", at)
    grams = grams.select(F.col("line").substr(F.col("at"), F.lit(ORDER)).alias("gram"), "toxic", "ordinary")
    return grams.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def _measured(model: Model, texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """``FEATURES`` of every text.

    Mean evidence of a character, most of a word, log of the number of words; for each of ``TAILS``
    the log of the evidence beyond it and that evidence by word.
    """
    known: dict[str, float] = {}
    alike, words_of = str.maketrans(*ALIKE), re.compile("[^" + NOT_ALNUM[1:]).findall
    low_tail, high_tail = TAILS

    def learn(counts: list[Counter]) -> None:
        """Remember the evidence of all words of some texts."""
        fresh = list({word for c in counts for word in c if word not in known})
        if len(known) + len(fresh) > REMEMBERED:
            known.clear()
            fresh = list({word for c in counts for word in c})
        for group in _groups(fresh):
            known.update(zip(group, model.of_words(group).tolist(), strict=True))

    for batch in texts:
        rows = []
        for at in range(0, len(batch), TEXTS):
            counts = [Counter(words_of((t or "").translate(alike))) for t in batch.iloc[at : at + TEXTS]]
            learn(counts)
            for words in counts:
                total, top, characters, low, high = 0.0, 0.0, 0, 0.0, 0.0
                for word, n in words.items():
                    found = known[word]
                    total += n * found
                    characters += n * (len(word) + 1)
                    if found > low_tail:
                        found = min(found, MOST)
                        low += found - low_tail
                        high += max(0.0, found - high_tail)
                        top = max(top, found)
                kinds = max(1, len(words))
                size = math.log1p(words.total())
                rows.append((total / max(1, characters), top, size, math.log1p(low), low / kinds, math.log1p(high), high / kinds))
        yield pd.DataFrame(rows, columns=FEATURES)
    # Workers live on, beside what the next stages need.
    known.clear()
    pa.default_memory_pool().release_unused()


def _groups(words: list[str]) -> Iterator[list[str]]:
    """Words of ``CHARACTERS`` in all, or a longer one."""
    group, size = [], 0
    for word in words:
        if group and size + len(word) > CHARACTERS:
            yield group
            group, size = [], 0
        group.append(word)
        size += len(word)
    if group:
        yield group


def measured(docs: DataFrame, model: Model, name: str = "features") -> DataFrame:
    """``docs`` with a struct column of ``FEATURES``."""
    # As plain values, since a broadcast does not carry classes along.
    sent = docs.sparkSession.sparkContext.broadcast([vars(t) for t in model.tables])
    unseen = model.unseen

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from _measured(Model([Table(**t) for t in sent.value], unseen), texts)

    kind = ", ".join(f"{feature} double" for feature in FEATURES)
    features = F.pandas_udf(run, kind)
    return docs.withColumn(name, features("text"))


def _regression(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    """Weights of a logistic regression, the constant first, by Newton's method."""
    scale = np.maximum(x.std(axis=0), 1e-9)
    z = np.column_stack([np.ones(len(x)), x / scale])
    w = np.zeros(z.shape[1])
    penalty = ridge * weight.sum() / len(x) * np.diag([0.0] + [1.0] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (weight * (y - p)) - penalty @ w
        curve = (z * (weight * p * (1 - p))[:, None]).T @ z + penalty + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return (float(w[0]), *(w[1:] / scale).tolist())


def _seen(texts: DataFrame, model: Model) -> pd.DataFrame:
    return measured(texts, model).select("toxic", "features.*").toPandas()


def _model(texts: DataFrame) -> Model | None:
    """The models of (text, toxic) rows, or None where a class is missing."""
    grams = _grams(texts).toArrow()
    toxic, ordinary = (grams.column(c).to_numpy() for c in ("toxic", "ordinary"))
    return build(grams.column("gram").to_pylist(), toxic, ordinary) if toxic.any() and ordinary.any() else None


def _crossed(texts: DataFrame) -> pd.DataFrame:
    """Features of the texts of each half by models of the other half, none where a class is missing there."""
    out = [pd.DataFrame(columns=["toxic", *FEATURES], dtype=float)]
    for half in (0, 1):
        model = _model(texts.filter(F.col("half") != half))
        if model is not None:
            out.append(_seen(texts.filter(F.col("half") == half), model))
    return pd.concat(out)


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS, fold_rows: int = FOLD_ROWS) -> Model:
    """The models and the regression from labelled texts outside the held-out part.

    A document with several labels is toxic if any says so; null labels and ids are not learnt from. Where the part for
    the regression lacks a class, it is fitted on the models' own texts instead, each half of them measured by models of
    the other. Where that gives one class only as well, the score is the mean evidence of a character with a fixed ``SLOPE``. Only where a
    class has no text at all nothing can be compared, and every score is the share of toxic labels.
    """
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = stored(known.withColumn("fold", fold(F.col("doc_id"))).filter(F.col("fold") != HELD_OUT))
    calibrating = F.col("fold") == CALIBRATE
    order = [F.xxhash64("doc_id"), "doc_id"]
    parts = []
    for toxic in (0, 1):
        for part, most in ((calibrating, fold_rows), (~calibrating, rows)):
            parts.append(known.filter((F.col("toxic") == toxic) & part).orderBy(*order).limit(most))
    sample = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    # At most twice ``rows`` and ``fold_rows`` ids.
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("half")
    sample = F.broadcast(stored(sample.select("doc_id", "toxic", "fold", half)))
    texts = stored(docs.select("doc_id", "text").join(sample, "doc_id").select("text", "toxic", "fold", "half"))
    have = {(r["toxic"], r["calibrating"]): r["n"] for r in known.groupBy("toxic", calibrating.alias("calibrating")).agg(F.count("*").alias("n")).collect()}
    model = _model(texts.filter(~calibrating))
    seen = _seen(texts.filter(calibrating), model) if model else None
    apart = True
    if model is None or seen["toxic"].nunique() < 2:
        # All labels make the models then.
        apart = False
        model = _model(texts)
        if model is None:
            total = sum(have.values())
            rate = sum(n for (toxic, _), n in have.items() if toxic == 1) / total if total else 0.0
            return Model([], 1.0, base_rate=rate)
        seen = _crossed(texts)
        if seen["toxic"].nunique() < 2:
            model.weights = (0.0, SLOPE, *[0.0] * (len(FEATURES) - 1))
            return model
    y = seen["toxic"].to_numpy(dtype=float)
    # Classes weigh as much as they have labels.
    counts = {t: have.get((t, True), 0) + (0 if apart else have.get((t, False), 0)) for t in (0, 1)}
    share = {toxic: counts[toxic] / max(1, int((y == toxic).sum())) for toxic in (0, 1)}
    weight = np.where(y == 1, share[1], share[0])
    model.weights = _regression(seen[list(FEATURES)].to_numpy(dtype=float), y, weight)
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` from 0 to 1, higher for toxic texts.

    A null text is empty. Empty texts get the score that the regression gives to no evidence. Columns of that name are
    replaced, and every row is scored by itself.
    """
    if model.base_rate is not None:
        return docs.withColumn("score", F.lit(float(model.base_rate)))
    name = "features"
    while name in docs.columns:
        name += "_"
    sums = F.lit(model.weights[0])
    for feature, weight in zip(FEATURES, model.weights[1:], strict=True):
        sums = sums + F.lit(weight) * F.col(f"{name}.{feature}")
    return measured(docs, model, name).withColumn("score", 1 / (1 + F.exp(-sums))).drop(name)


def reject(docs: DataFrame, model: Model, limit: float = LIMIT) -> DataFrame:
    """The rows of ``docs`` that score below ``limit``; all of them, where a class has no labels and nothing is compared."""
    if model.base_rate is not None:
        return docs
    return scored(docs.select("text", F.struct(*docs.columns).alias("row")), model).filter(F.col("score") < limit).select("row.*")


@query()
def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Score of every document by models of the labels that are not held out."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    made = scored(docs, fit(docs, table(spark, folder, "labels")))
    held_out = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return made.select(
        "doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= LIMIT, 1).otherwise(0).alias("predicted")
    )

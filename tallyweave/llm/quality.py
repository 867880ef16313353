"""Quality rules with the frequency of lines across documents.

Lines are normalised and hashed in the task that reads their document. For every host, the
documents that have a line are counted; lines of more than ``LEAST`` documents and more than ``SHARE`` of the host's
are its boilerplate. They are removed, and a document that loses too much, or breaks a rule
on its own, is rejected.

Counts are combined before they are shuffled and the join back is by line, so a line
that most documents of a host have is spread like any other rows. A document's text is read whole, and is not shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm.registry import query, table
from tallyweave.llm.shared import stored

#: A line of at most so many documents of its host, or at most this share of them, stays.
LEAST, SHARE = 10, 0.01
#: A document needs so many words, and this share of its words, when its host's lines are gone.
WORDS, LEFT = 20, 0.5
#: A document with a larger share (in per cent) of words in repeated windows is rejected.
REPEATED, WINDOW = 30, 8
SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"


def line_hash(words: list[bytes]) -> int:
    """Of a line's words in lower case, with single spaces, as a signed long."""
    line = b" ".join(words).decode("utf-8", "replace").lower()
    return int(np.uint64(xxhash.xxh64_intdigest(line)).astype(np.int64))


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words in windows of ``width`` (a power of two) that the text has more than once.

    Windows get numbers by doubling: equal numbers are equal words, not equal hashes.
    """
    if len(words) < 2 * width and len(words) <= width:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64)
    step = 1
    while step < width:
        pairs = ids[:-step] * (int(ids.max()) + 1) + ids[step:]
        kinds, ids = np.unique(pairs, return_inverse=True)
        step *= 2
        if len(kinds) == len(pairs):
            return 0
    twice = np.flatnonzero(np.bincount(ids)[ids] > 1)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, twice, 1)
    np.add.at(change, twice + width, -1)
    return int((np.cumsum(change) > 0).sum())


def _measure(text: str) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and hash, words and times of every different line."""
    words = text.encode().split()
    seen, same, lines = set(), 0, {}
    for line in text.split("\n"):
        own = line.encode().split()
        if not own:
            continue
        if line in seen:
            same += 1
        seen.add(line)
        key = line_hash(own)
        lines[key] = lines.get(key, 0) + len(own)
    return (
        len(words),
        len(text) - sum(map(text.count, SPACE)),
        sum(map(text.count, SYMBOLS)),
        same,
        repeated_words(words),
        list(lines),
        list(lines.values()),
    )


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measured(docs: DataFrame) -> DataFrame:
    """(row, doc_id, host, no_host, doc, counts of the base rules, lines, sizes), stored.

    ``doc`` is equal for rows equal in id and text. ``sizes`` are the words of each of the different ``lines``.
    """
    own = ["doc_id", "host", "no_host", "doc"]
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_measure(t or "") for t in batch.column(len(own)).to_pylist()]
            columns = list(zip(*rows, strict=True)) or [()] * (len(_COUNTS) + 2)
            counts = [pa.array(c, pa.int64()) for c in columns[:-2]]
            lists = [pa.array(c, pa.list_(pa.int64())) for c in columns[-2:]]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(own))), *counts, *lists], names=[*own, *_COUNTS, "lines", "sizes"]
            )

    rows = docs.select(
        "doc_id",
        F.coalesce("source", F.lit("")).alias("host"),
        F.col("source").isNull().alias("no_host"),
        F.xxhash64("doc_id", "text").alias("doc"),
        "text",
    )
    counts = ", ".join(f"{c} long" for c in _COUNTS)
    made = rows.mapInArrow(
        run, f"doc_id {kind}, host string, no_host boolean, doc long, {counts}, lines array<long>, sizes array<long>"
    )
    return stored(made.withColumn("row", F.monotonically_increasing_id()))


def boilerplate(rows: DataFrame, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """(host, no_host, line): the lines above the limits of their host."""
    hosts = rows.groupBy("host", "no_host").agg(F.countDistinct("doc").alias("docs"))
    lines = rows.select("host", "no_host", "doc", F.explode("lines").alias("line"))
    counts = lines.groupBy("host", "no_host", "line").agg(F.countDistinct("doc").alias("n")).filter(F.col("n") > least)
    above = stored(counts).join(stored(hosts), ["host", "no_host"]).filter(F.col("n") > share * F.col("docs"))
    return stored(above.select("host", "no_host", "line"))


def base_failed() -> Column:
    return (F.col("n_words") < WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))


def verdicts(rows: DataFrame, common: DataFrame) -> DataFrame:
    """``rows`` with ``removed`` (words of removed lines), ``base_failed`` and ``kept``."""
    lines = rows.select("row", "host", "no_host", F.explode(F.arrays_zip("lines", "sizes")).alias("line"))
    lines = lines.select("row", "host", "no_host", F.col("line.lines").alias("line"), "line.sizes")
    gone = lines.join(common, ["host", "no_host", "line"]).groupBy("row").agg(F.sum("sizes").alias("removed"))
    made = rows.join(gone, "row", "left").withColumn("removed", F.coalesce("removed", F.lit(0)))
    left = F.col("n_words") - F.col("removed")
    depleted = (left < WORDS) | (left < LEFT * F.col("n_words"))
    return made.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~depleted)


def judged(docs: DataFrame, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """(doc_id, counts, removed, base_failed, kept) of every row of ``docs``.

    Words lie between white space. A null text has none and fails. Lines without words do not count; lines that differ only in
    case or in white space are one. A null source is a host of its own. A document counts once for a line, rows
    equal in id and text are one document, and each of them is judged. Other columns are ignored, and an empty table gives no rows.
    """
    rows = measured(docs)
    return verdicts(rows, boilerplate(rows, least, share))


def clean(docs: DataFrame, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """The rows of ``docs`` that are kept, without their hosts' lines above the limits."""
    rows = measured(docs)
    common = boilerplate(rows, least, share)
    kept = verdicts(rows, common).filter("kept").select("doc", "host", "no_host", "lines").distinct()
    lines = kept.select("doc", "host", "no_host", F.explode("lines").alias("line")).join(common, ["host", "no_host", "line"])
    gone = lines.groupBy("doc", "host", "no_host").agg(F.collect_set("line").alias("gone"))
    kept = kept.drop("lines").join(gone, ["doc", "host", "no_host"], "left")

    @F.pandas_udf("string")
    def without(texts: pd.Series, gone: pd.Series) -> pd.Series:
        out = []
        for text, hashes in zip(texts, gone, strict=True):
            if hashes is not None:
                drop = set(hashes.tolist())
                lines = [(line, line.encode().split()) for line in text.split("\n")]
                text = "\n".join(line for line, own in lines if not own or line_hash(own) not in drop)
            out.append(text)
        return pd.Series(out)

    keyed = docs.select(
        F.struct(*docs.columns).alias("own"),
        F.xxhash64("doc_id", "text").alias("doc"),
        F.coalesce("source", F.lit("")).alias("host"),
        F.col("source").isNull().alias("no_host"),
    )
    joined = keyed.join(kept, ["doc", "host", "no_host"])
    text = without(F.col("own.text"), F.col("gone"))
    return joined.select(*[text.alias(c) if c == "text" else F.col("own")[c].alias(c) for c in docs.columns])


@query()
def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Base counts and verdict of every document."""
    made = judged(table(spark, folder, "documents"))
    return made.select("doc_id", *_COUNTS, "base_failed", "kept")

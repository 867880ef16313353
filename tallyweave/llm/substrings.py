"""Substring dedup by content-defined chunking.

A gear hash rolls over the bytes of a text, and a text is cut where the hash is small. Whether a place is a
cut depends on the ``REACH`` bytes before it only, so an insertion moves no other cut, and equal
passages are cut alike wherever they stand. Where the hash is smaller still a chunk begins, and it runs to the first
cut that is ``SPAN`` words or ``LONG`` bytes on, or a little further without one. So chunks overlap, their ends are close at hand,
and a passage longer than about two chunks holds a whole one. Text that repeats itself may have no small hash at all; where no chunk
begins for ``GAP`` bytes, one begins at the smallest hash of every ``GAP``, which is at the same place of what is repeated.

Chunks are deduplicated by digest: a digest that two documents have is repeated, and the document of
the smallest id keeps it. Digests are counted before they are shuffled, and repeated ones are joined back to their places, where
Spark splits a digest that very many documents have. The places in a document are merged to spans.
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

#: Mean bytes between places where chunks begin, between cuts, and bytes that decide about one (the bits of the hash).
MEAN, CUT, REACH = 24, 8, 32
#: Bytes without the beginning of a chunk after which the smallest hash begins one.
GAP = 96
#: A chunk has at least so many words, or so many bytes; and words and bytes more after which it ends without a cut.
SPAN, LONG, MORE, LONGER = 12, 512, 4, 64
#: Bytes hashed at a time, unless one text is longer.
BLOCK = 1 << 22
#: Rows without an id have numbers from here on, by the hash of their text.
NO_ID, NO_IDS = -(1 << 63), 1 << 40
SPACES = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))


def gear() -> np.ndarray:
    """A number for every byte value, by hash."""
    return np.array([xxhash.xxh32_intdigest(bytes([b]), seed=42) for b in range(256)], dtype=np.uint32)


def rolling(numbers: np.ndarray) -> np.ndarray:
    """At every place, the sum of the ``REACH`` numbers up to it, each shifted left by its distance.

    By doubling: a sum over 2 k numbers is one over k plus one that ends k earlier, shifted by k.
    """
    sums, k = numbers.astype(np.uint32), 1
    while k < REACH:
        more = sums.copy()
        more[k:] += sums[:-k] << np.uint32(k)
        sums, k = more, 2 * k
    return sums


def _beginnings(hashes: np.ndarray, small: np.ndarray) -> np.ndarray:
    """Where chunks of a text begin: at 0, behind every small hash, and behind the first smallest of every ``GAP`` without one."""
    found = np.unique(np.concatenate(([0], np.flatnonzero(small) + 1)))
    more = []
    ends = np.append(found[1:], len(hashes))
    for begin, end in zip(found[ends - found > GAP].tolist(), ends[ends - found > GAP].tolist(), strict=True):
        rows = (end - begin) // GAP
        least = hashes[begin : begin + rows * GAP].reshape(rows, GAP).argmin(axis=1)
        more.append(begin + np.arange(rows) * GAP + least + 1)
    return np.unique(np.concatenate([found, *more]))


def chunks(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Starts and stops, in bytes, of every text's chunks."""
    # Texts are kept apart by zeros, so that none reaches into the next.
    gap = bytes(REACH)
    data = np.frombuffer(gap.join(texts), dtype=np.uint8)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    begins = np.concatenate(([0], np.cumsum(sizes + REACH)[:-1]))
    numbers = gear()[data]
    for begin, size in zip(begins.tolist(), sizes.tolist(), strict=True):
        numbers[begin + size : begin + size + REACH] = 0
    hashes = rolling(numbers)
    cut, open_ = hashes < np.uint32((1 << 32) // CUT), hashes < np.uint32((1 << 32) // MEAN)
    space = SPACES[data]
    first = ~space
    first[1:] &= space[:-1]
    first[begins[sizes > 0]] = ~space[begins[sizes > 0]]
    out = []
    for begin, size in zip(begins.tolist(), sizes.tolist(), strict=True):
        own = np.unique(np.concatenate(([0], np.flatnonzero(cut[begin : begin + size]) + 1, [size])))
        from_ = _beginnings(hashes[begin : begin + size], open_[begin : begin + size])
        words = np.concatenate(([0], np.cumsum(first[begin : begin + size])))
        at = np.minimum(np.searchsorted(words[own], words[from_] + SPAN), np.searchsorted(own, from_ + LONG))
        after = size + 1
        stop = np.append(own, after)[at]
        # The byte before the first of a word has all words before it.
        word = np.searchsorted(words, words[from_] + SPAN + MORE) - 1
        stop = np.minimum(stop, np.where(word < size, word, after))
        stop = np.minimum(stop, np.where(from_ + LONG + LONGER <= size, from_ + LONG + LONGER, after))
        whole = stop < after
        out.append((from_[whole], stop[whole]))
    return out


def _number(text: str = "text") -> Column:
    """The id, or for a row without one a number of its text that no id has."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID) + F.pmod(F.xxhash64(text), F.lit(NO_IDS)))


def _known(number: Column) -> Column:
    """The id of a number, null for a row without one."""
    return F.when(number >= NO_ID + NO_IDS, number)


def digested(docs: DataFrame) -> DataFrame:
    """(row, doc, text_key, digests, starts, stops) of every row, stored; ``doc`` is the id, or a number in its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column(2).cast(pa.binary())]
            at = 0
            while at < len(texts):
                end, size = at + 1, len(texts[at])
                while end < len(texts) and size + len(texts[end]) <= BLOCK:
                    size += len(texts[end])
                    end += 1
                part, found = texts[at:end], chunks(texts[at:end])
                places = [(s.tolist(), e.tolist()) for s, e in found]
                hashes = [digest(t[s:e]) for t, (a, b) in zip(part, places, strict=True) for s, e in zip(a, b, strict=True)]
                edges = np.concatenate(([0], np.cumsum([len(s) for s, _ in found]))).astype(np.int32)
                values = [np.array(hashes, dtype=np.uint64).view(np.int64), *map(np.concatenate, zip(*found, strict=True))]
                kinds = [pa.int64(), pa.int32(), pa.int32()]
                lists = [pa.ListArray.from_arrays(edges, pa.array(v, k)) for v, k in zip(values, kinds, strict=True)]
                own = [batch.column(i).slice(at, end - at) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, *lists], names=["doc", "text_key", "digests", "starts", "stops"])
                at = end

    rows = docs.select(_number().alias("doc"), F.xxhash64("text").alias("text_key"), "text")
    made = rows.mapInArrow(
        run, "doc long, text_key long, digests array<long>, starts array<int>, stops array<int>"
    )
    return stored(made.withColumn("row", F.monotonically_increasing_id()))


def _merge(starts: pd.Series, stops: pd.Series) -> pd.DataFrame:
    """Spans that hold all the given ones, without overlap."""
    out = []
    for a, b in zip(starts, stops, strict=True):
        order = np.argsort(a, kind="stable")
        a, reach = np.asarray(a)[order], np.maximum.accumulate(np.asarray(b)[order])
        fresh = np.concatenate(([True], a[1:] > reach[:-1])) if len(a) else np.zeros(0, dtype=bool)
        last = np.append(np.flatnonzero(fresh)[1:] - 1, len(a) - 1) if len(a) else np.zeros(0, dtype=int)
        out.append((a[fresh], reach[last]))
    return pd.DataFrame(out, columns=["starts", "stops"])


def repeats(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text_key, repeated, dropped, kept_by) of the rows with passages that other documents have.

    ``repeated`` has the spans (starts, stops) in bytes of UTF-8; ``dropped`` has those of them that a document
    of a smaller id keeps, and ``kept_by`` these ids. Ids are whole numbers. Repeated rows of an id are one document, which does
    not repeat itself, and so are rows without an id of the same text; these come before all others. Null and short texts have no chunks, other columns are ignored, and
    texts without repetitions (and so an empty table) give no rows.
    """
    rows = digested(docs)
    digests = rows.select("doc", F.explode("digests").alias("digest"))
    shared = digests.groupBy("digest").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
    shared = stored(shared.filter("first < last").select("digest", "first"))
    zipped = F.explode(F.arrays_zip("digests", "starts", "stops")).alias("chunk")
    places = rows.select("row", "doc", zipped).select(
        "row", "doc", F.col("chunk.digests").alias("digest"), F.col("chunk.starts").alias("start"), F.col("chunk.stops").alias("stop")
    )
    found = places.join(shared, "digest")
    later = F.col("first") < F.col("doc")
    lists = found.groupBy("row").agg(
        F.collect_list("start").alias("starts"),
        F.collect_list("stop").alias("stops"),
        F.collect_list(F.when(later, F.col("start"))).alias("later_starts"),
        F.collect_list(F.when(later, F.col("stop"))).alias("later_stops"),
        F.sort_array(F.collect_set(F.when(later, F.col("first")))).alias("kept_by"),
    )
    merged = F.pandas_udf(_merge, "starts array<int>, stops array<int>")
    spans = lists.select(
        "row", merged("starts", "stops").alias("repeated"), merged("later_starts", "later_stops").alias("dropped"), "kept_by"
    )
    own = rows.select("row", "doc", "text_key")
    no_id = F.transform("kept_by", _known).alias("kept_by")
    return own.join(stored(spans), "row").select("row", _known(F.col("doc")).alias("doc_id"), "text_key", "repeated", "dropped", no_id)


def clean(docs: DataFrame) -> DataFrame:
    """``docs`` without the passages that a document of a smaller id keeps.

    A passage is cut out in whole characters: a span that begins or ends within one loses that part of it.
    """
    found = repeats(docs).filter(F.size("dropped.starts") > 0)
    drops = found.groupBy("doc_id", "text_key").agg(F.first("dropped").alias("dropped"))
    known = F.struct("doc_id", "text_key")
    drops = drops.select(known.alias("key"), "dropped")

    @F.pandas_udf("string")
    def without(texts: pd.Series, dropped: pd.DataFrame) -> pd.Series:
        out = []
        for text, starts, stops in zip(texts, dropped["starts"], dropped["stops"], strict=True):
            if starts is not None:
                data, edges = text.encode(), [0, *np.column_stack((starts, stops)).ravel().tolist(), None]
                text = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)).decode("utf-8", "ignore")
            out.append(text)
        return pd.Series(out, dtype=object)

    key = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"))
    joined = docs.select(F.struct(*docs.columns).alias("own"), key.alias("own_key"))
    joined = joined.join(drops, F.col("own_key").eqNullSafe(F.col("key")), "left")
    text = without(F.col("own.text"), F.col("dropped"))
    return joined.select(*[text.alias(c) if c == "text" else F.col("own")[c].alias(c) for c in docs.columns])


@query()
def op2_substrings(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with passages that other documents have: the spans, and those that go."""
    found = repeats(table(spark, folder, "documents"))

    def size(spans: str):
        return F.aggregate(
            F.zip_with(f"{spans}.starts", f"{spans}.stops", lambda a, b: b - a), F.lit(0).cast("long"), lambda s, n: s + n
        )

    return found.select(
        "doc_id",
        F.size("repeated.starts").cast("long").alias("n_spans"),
        size("repeated").alias("repeated_bytes"),
        size("dropped").alias("dropped_bytes"),
        F.arrays_zip("repeated.starts", "repeated.stops").alias("spans"),
        "kept_by",
    )

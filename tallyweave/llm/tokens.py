"""Token ids of a corpus in files of directly addressable codes.

Documents are dealt out by ranges of their id and sorted, so that the ids of the whole corpus are one sequence in ascending
``doc_id`` order. Every task turns its documents into ids and packs them in segments of whole documents (see
``codes``). The files below a path are two tables, written by Spark so that a lost task leaves nothing behind:

``segments``
    (part, nth, offset, n_ids, doc_ids, sizes, codes): the ids ``offset`` ids behind the beginning of
    the part; ``sizes`` are those of the documents, and ``codes`` are the packed ids, uncompressed.
``parts``
    (part, start): where a part begins in the corpus.

So a place in the corpus leads to one segment by its two tables' numbers alone, and to its id by a byte or two of each level.

The vocabulary is a file of the tokenizers library, which the driver reads and sends to the tasks. Where its rules put a single
space between words always to the beginning of a token, a word after such a space has the same ids in every text, and is encoded
once and remembered. Texts with other white space next to a space, and those of other vocabularies, are encoded as they are.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tallyweave.llm.codes import Codes, pack
from tallyweave.llm.registry import query, table
from tallyweave.session import scratch

#: File of the vocabulary below the folder of public tokenizers.
VOCABULARY = "byte_bpe_50k.json"
#: The id that ends a document.
END = 0
#: A segment is closed when it has so many ids; it has more if a document has.
SEGMENT = 1 << 18
#: Words whose ids a worker remembers; when it has more, those not met again since the last time are forgotten.
REMEMBERED = 1_500_000
#: New words that are encoded as one text.
TOGETHER = 32
#: Bytes of texts taken at a time, unless one text is longer.
BYTES = 8 << 20
#: Parts whose places are broadcast.
PARTS = 4_000_000
#: Bytes of a row group, so that a large file is read by several tasks.
ROW_GROUP = 16 << 20


def vocabulary(name: str = VOCABULARY) -> str:
    """The place of a file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts, as little-endian unsigned 32-bit integers, by the JSON of a vocabulary."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        # Words and their ids, and which of them have been met again lately.
        self.words, self.lists = pa.array([], pa.string()), pa.array([], pa.list_(pa.uint32()))
        self.met = np.zeros(0, dtype=bool)
        rules = json.loads(spec)
        before = rules.get("pre_tokenizer") or {}
        # These rules take a space as the beginning of the word after it, and encode every word by itself.
        self.by_word = (
            rules.get("normalizer") is None
            and rules.get("truncation") is None
            and before.get("type") == "ByteLevel"
            and before.get("use_regex", True)
            and not before.get("add_prefix_space", True)
            and rules["model"]["type"] == "BPE"
            and not rules["model"].get("dropout")
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] for t in rules["added_tokens"])
        )
        if self.by_word:
            # A token has a character for every byte, but for those that were added.
            added = {t["id"]: len(t["content"].encode()) for t in rules["added_tokens"]}
            names = self.tokenizer.get_vocab()
            self.lengths = np.zeros(max(names.values()) + 1, dtype=np.int64)
            for name, i in names.items():
                self.lengths[i] = added.get(i, len(name))

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _learn(self, words: list[str]) -> None:
        """Remember the ids of words, each with the space before it; short texts of many words take the library least."""
        found: list[int] = []
        for at in range(0, len(words), TOGETHER):
            text = "".join([f" {word}" for word in words[at : at + TOGETHER]])
            found += self.tokenizer.encode(text, add_special_tokens=False).ids
        ids = np.array(found, dtype="<u4")
        ends = np.cumsum([1 + len(word.encode()) for word in words])
        reached = np.cumsum(self.lengths[ids])
        last = np.searchsorted(reached, ends)
        if not np.array_equal(reached[last], ends):
            raise ValueError("a token of the vocabulary goes beyond the word that it begins in")
        self.words = pa.concat_arrays([self.words, pa.array(words, pa.string())])
        self.lists = pa.concat_arrays([self.lists, _lists(ids, np.diff(last + 1, prepend=0))])
        self.met = np.concatenate((self.met, np.zeros(len(words), dtype=bool)))

    def _places(self, words: pa.Array) -> np.ndarray:
        """Where the ids of distinct words are, or -1 for a word that is empty or has white space at an end.

        Only new words need a look for that, since none such is remembered.
        """
        found = pc.index_in(words, value_set=self.words)
        places = found.fill_null(-1).to_numpy().copy()
        self.met[places[places >= 0]] = True
        fresh = words.filter(found.is_null()).to_pylist()
        tight = np.array([bool(w) and not w[0].isspace() and not w[-1].isspace() for w in fresh], dtype=bool)
        if tight.any():
            at = np.flatnonzero(places < 0)[tight]
            places[at] = len(self.words) + np.arange(len(at))
            self._learn([w for w, t in zip(fresh, tight.tolist(), strict=True) if t])
        return places

    def ids(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, ``end`` behind each, and how many each has."""
        if not len(texts):
            return np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64)
        if not self.by_word:
            found = [np.append(self._whole(t), np.uint32(end)) for t in texts.to_pylist()]
            return np.concatenate(found), np.array([len(f) for f in found], dtype=np.int64)
        pieces = pc.split_pattern(texts, " ")
        counts = pieces.value_lengths().to_numpy().astype(np.int64)
        coded = pieces.flatten().dictionary_encode()
        which, firsts = coded.indices.to_numpy(), np.cumsum(counts) - counts
        # The first word of a text has no space before it.
        later = np.ones(len(which), dtype=bool)
        later[firsts] = False
        used = np.zeros(len(coded.dictionary), dtype=bool)
        used[which[later]] = True
        place = np.full(len(used), -1, dtype=np.int64)
        place[used] = self._places(coded.dictionary.filter(pa.array(used)))
        places = place[which]
        # A text where white space is next to a space is encoded whole, in place of its first word.
        loose = np.logical_or.reduceat((places < 0) & later, firsts)
        heads = []
        for n, head in enumerate(coded.dictionary.take(pa.array(which[firsts])).to_pylist()):
            loose[n] |= counts[n] > 1 and (not head or head[-1].isspace())
            heads.append(np.array([end] * (n > 0), dtype="<u4"))
            heads.append(self._whole(texts[n].as_py() if loose[n] else head))
        sizes = np.array([len(a) + len(b) for a, b in zip(heads[::2], heads[1::2], strict=True)] + [0])
        parts = pa.concat_arrays([self.lists, _lists(np.concatenate(heads), sizes)])
        places[np.repeat(loose, counts)] = len(parts) - 1
        places[firsts] = len(self.lists) + np.arange(len(texts))
        out = parts.take(pa.array(places)).flatten().to_numpy()
        counts = np.add.reduceat(parts.value_lengths().to_numpy()[places].astype(np.int64), firsts)
        # The end of a text stands in front of the next one's head.
        counts[:1] += 1
        if len(self.words) > REMEMBERED:
            kept = self.met if self.met.sum() <= REMEMBERED // 2 else np.zeros(len(self.met), dtype=bool)
            self.words, self.lists = self.words.filter(pa.array(kept)), self.lists.filter(pa.array(kept))
            self.met = np.zeros(len(self.words), dtype=bool)
        return np.append(out, np.uint32(end)), counts


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    edges = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(edges, pa.array(values, pa.uint32()))


def _groups(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours of ``BYTES`` in all, or a longer one."""
    at = 0
    while at < len(sizes):
        end, total = at + 1, sizes[at]
        while end < len(sizes) and total + sizes[end] <= BYTES:
            total += sizes[end]
            end += 1
        yield at, end
        at = end


def _segments(spec: Broadcast, end: int, kind: pa.DataType):
    """Documents of a task, in their order, to its segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth, offset, size, held, names, sizes = TaskContext.get().partitionId(), 0, 0, 0, [], [], []

        def closed() -> pa.RecordBatch:
            row = {
                "part": pa.array([part], pa.int32()),
                "nth": pa.array([nth], pa.int32()),
                "offset": pa.array([offset], pa.int64()),
                "n_ids": pa.array([size], pa.int64()),
                "doc_ids": pa.array([names], pa.list_(kind)),
                "sizes": pa.array([sizes], pa.list_(pa.int64())),
                "codes": pa.array([pack(np.concatenate(held))], pa.binary()),
            }
            return pa.RecordBatch.from_arrays(list(row.values()), names=list(row))

        for batch in batches:
            # A worker keeps its copy of a broadcast value from task to task, and so what the encoder remembers.
            encoder = spec.value.setdefault("encoder", None) or Encoder(spec.value["spec"])
            spec.value["encoder"] = encoder
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).fill_null("")
            for a, b in _groups(pc.binary_length(texts).to_pylist()):
                ids, counts = encoder.ids(texts.slice(a, b - a), end)
                at = 0
                for name, count in zip(doc_ids[a:b], counts.tolist(), strict=True):
                    held.append(ids[at : at + count])
                    names.append(name)
                    sizes.append(count)
                    at, size = at + count, size + count
                    if size >= SEGMENT:
                        yield closed()
                        nth, offset, size, held, names, sizes = nth + 1, offset + size, 0, [], [], []
        if sizes:
            yield closed()

    return run


def write(docs: DataFrame, path: str, vocabulary_file: str | None = None, end: int = END) -> None:
    """Write the ids of all texts below ``path``, in ascending order of ``doc_id``.

    Every document ends with the id ``end``, and a null or empty text has no other. Null ids come first, rows of
    equal ids are documents of their own and come in an order of their texts' hashes, and rows that are equal in both come in
    any order and may lie in several parts. Other columns are ignored, and an empty table gives no segment.
    Strings of special tokens in a text are those tokens, as the library has it.
    """
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast({"spec": Path(vocabulary_file or vocabulary()).read_text("utf-8")})
    rows = docs.select("doc_id", "text").withColumns({"hash": F.xxhash64("text"), "spread": F.rand(42)})
    order = ["doc_id", "hash", "spread"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"part int, nth int, offset bigint, n_ids bigint, doc_ids array<{kind}>, sizes array<bigint>, codes binary"
    made = dealt.mapInArrow(_segments(spec, end, to_arrow_type(docs.schema["doc_id"].dataType)), schema)
    made.write.option("compression", "uncompressed").option("parquet.block.size", ROW_GROUP).parquet(f"{path}/segments")
    # As many rows as there were tasks.
    sums = spark.read.parquet(f"{path}/segments").groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    starts.write.parquet(f"{path}/parts")


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments with ``start``, the place of their first id in the corpus, instead of an offset."""
    parts = spark.read.parquet(f"{path}/parts").withColumnRenamed("start", "begin")
    # Two numbers a part, so that codes need no shuffle.
    parts = F.broadcast(parts) if parts.count() <= PARTS else parts
    found = spark.read.parquet(f"{path}/segments").join(parts, "part")
    return found.withColumn("start", F.col("begin") + F.col("offset")).drop("begin", "offset")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document; ``ids`` are little-endian unsigned 32-bit integers."""
    found = segments(spark, path).select("doc_ids", "sizes", "start", "codes")
    kind = found.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                doc_ids, sizes = batch.column(0)[row].values, np.array(batch.column(1)[row].as_py(), dtype=np.int64)
                stops = np.cumsum(sizes)
                codes = Codes(batch.column(3)[row].as_py())
                data = codes.between(0, len(codes)).astype("<u4").tobytes()
                ids = [data[4 * (b - n) : 4 * b] for n, b in zip(sizes.tolist(), stops.tolist(), strict=True)]
                starts = pa.array(batch.column(2)[row].as_py() + stops - sizes)
                columns = [doc_ids, starts, pa.array(sizes), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids"])

    return found.mapInArrow(run, f"doc_id {kind}, start bigint, n_tokens bigint, ids binary")


def ids_at(path: str, places: DataFrame) -> DataFrame:
    """(place, id) of every distinct ``place`` in the corpus; places outside it and null ones are left out.

    Places are brought to their segments by the numbers of these, without their codes, and then each
    segment that has any is opened once. A segment has no more distinct places than ids.
    """
    spark = places.sparkSession
    known = segments(spark, path).select("part", "nth", "start", "n_ids")
    steps = F.sequence(F.floor(F.col("start") / SEGMENT), F.floor((F.col("start") + F.col("n_ids") - 1) / SEGMENT))
    known = known.withColumn("step", F.explode(steps))
    wanted = places.select(F.col("place").cast("bigint")).distinct().withColumn("step", F.floor(F.col("place") / SEGMENT))
    inside = (F.col("place") >= F.col("start")) & (F.col("place") < F.col("start") + F.col("n_ids"))
    placed = wanted.join(known, "step").filter(inside).withColumn("offset", F.col("place") - F.col("start"))
    lists = placed.groupBy("part", "nth", "start").agg(F.collect_list("offset").alias("offsets"))
    opened = lists.join(spark.read.parquet(f"{path}/segments").select("part", "nth", "codes"), ["part", "nth"])

    @F.pandas_udf("array<bigint>")
    def read(codes: pd.Series, offsets: pd.Series) -> pd.Series:
        return pd.Series([Codes(c).at(o).astype(np.int64) for c, o in zip(codes, offsets, strict=True)])

    rows = opened.select("start", "offsets", read("codes", "offsets").alias("ids"))
    rows = rows.select("start", F.explode(F.arrays_zip("offsets", "ids")).alias("at"))
    return rows.select((F.col("start") + F.col("at.offsets")).alias("place"), F.col("at.ids").alias("id"))


@query()
def op11_addressable_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Where the ids of every document lie in the files, how many they are, and their checksum."""
    path = scratch(spark, "tokens")
    write(table(spark, folder, "documents"), path)
    found = documents(spark, path)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

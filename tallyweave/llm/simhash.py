"""Near-duplicates by SimHash fingerprints and covering locality-sensitive hashing.

A fingerprint has 64 bits. For radius r, bit i is given a vector of r + 1 bits that is not
zero, and every such vector v makes a table: its key is the fingerprint masked to the bits whose vector has
odd overlap with v. Up to r differing bits span at most r dimensions, so some v is orthogonal to all
of them, and its mask holds none of them: every pair within the radius shares a key
of some table. Nothing depends on chance.

Equal fingerprints are merged before the tables are built. Keys that more than
``CROWD`` fingerprints share are split by a covering family over the bits that they are still free in, and again;
after three levels at most ``CROWD`` fingerprints can share a key. A bucket
gives a spanning forest of its links, not its pairs, and components follow from these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tallyweave.llm.graph import components
from tallyweave.llm.registry import query, table
from tallyweave.llm.shared import keyed, stored, without

BITS = 64
RADIUS = 3
SHINGLE = 3
SEED = 42
#: Most fingerprints compared with each other in one bucket; at least 2 to the bits that level 3 leaves free.
CROWD = 256
LEVELS = 3
#: Hashes whose bits are counted at a time.
BLOCK = 1 << 14


def _of_words(words: list[bytes], width: int) -> int:
    """The majority of every bit over the shingles' hashes."""
    if not words:
        return 0
    width = min(width, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1]
    ends = ends[width - 1 :]
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(starts), BLOCK):
        spans = zip(starts[at : at + BLOCK].tolist(), ends[at : at + BLOCK].tolist(), strict=True)
        part = np.fromiter((digest(line[a:b], SEED) for a, b in spans), dtype="<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    majority = np.packbits(2 * ones > len(starts), bitorder="little")
    return int(majority.view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", width: int = SHINGLE) -> DataFrame:
    """``docs`` with ``fp``, the fingerprint as a signed long, in place of the text.

    Words lie between white space and A-Z is lowered. Fewer words than ``width`` make one
    shingle, and no words (or a null text) fingerprint 0. Texts stay in Arrow memory and are taken from there one by one.
    """
    names = [c for c in docs.columns if c not in (text, "fp")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(names)).cast(pa.binary())
            fps = [_of_words((t.as_py() or b"").lower().split(), width) for t in texts]
            own = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*own, pa.array(fps, pa.int64())], names=[*names, "fp"])
        # Workers live on, beside what the next stages need.
        pa.default_memory_pool().release_unused()

    schema = StructType([*[docs.schema[c] for c in names], StructField("fp", LongType())])
    return docs.select(*names, text).mapInArrow(run, schema)


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def covering_masks(positions: list[int], radius: int = RADIUS) -> list[int]:
    """Masks over ``positions`` so that any ``radius`` of these are outside one mask."""
    vectors = (1 << radius + 1) - 1
    given = {p: n % vectors + 1 for n, p in enumerate(positions)}
    return [sum(1 << p for p, phi in given.items() if (phi & v).bit_count() % 2) for v in range(1, vectors + 1)]


def _tables(radius: int) -> list[list[tuple[int, int, int]]]:
    """By level: (parent, table, mask); a table's mask holds its parent's."""
    levels, above = [], [(0, 0)]
    for _ in range(LEVELS):
        level = []
        for parent, held in above:
            free = [p for p in range(BITS) if not held >> p & 1]
            level += [(parent, held | own) for own in covering_masks(free, radius)]
        levels.append([(parent, n, mask) for n, (parent, mask) in enumerate(level)])
        above = [(n, mask) for _, n, mask in levels[-1]]
    return levels


def _forest(radius: int):
    """Spanning edges of the links in every list of fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            for members in batch.column(0):
                fps = np.sort(np.array(members.as_py(), dtype=np.int64))
                near = np.bitwise_count((fps[:, None] ^ fps[None, :]).view(np.uint64)) <= radius
                waiting = np.ones(len(fps), dtype=bool)
                for root in range(len(fps)):
                    front = [root] if waiting[root] else []
                    while front:
                        at = front.pop()
                        waiting[at] = False
                        found = np.flatnonzero(near[at] & waiting).tolist()
                        waiting[found] = False
                        front += found
                        left += [int(fps[at])] * len(found)
                        right += fps[found].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that span the same components as all links.

    ``fps`` has one column ``fp`` without repetitions. Every edge is a link.
    """
    spark, found = fps.sparkSession, []
    first = F.array(*[F.struct(F.lit(n).alias("next"), F.lit(_signed(m)).alias("mask")) for _, n, m in _tables(radius)[0]])
    masked = fps.select("fp", F.inline(first))
    for depth, level in enumerate(_tables(radius)):
        if depth:
            masks = spark.createDataFrame([(p, n, _signed(m)) for p, n, m in level], "table int, next int, mask long")
            masked = crowded.join(F.broadcast(masks), "table")
        keys = masked.select(F.col("next").alias("table"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
        sizes = stored(keys.groupBy("table", "key").agg(F.count("*").alias("size")).filter("size > 1"))
        shared = stored(keys.join(sizes, ["table", "key"]))
        last = depth == LEVELS - 1
        small = shared if last else shared.filter(F.col("size") <= CROWD)
        lists = small.groupBy("table", "key").agg(F.collect_list("fp").alias("fps")).select("fps")
        found.append(stored(lists.mapInArrow(_forest(radius), "a long, b long").distinct()))
        crowded = shared.filter(F.col("size") > CROWD).select("table", "fp")
        if last or crowded.isEmpty():
            break
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    return edges


def classes(
    docs: DataFrame, text: str = "text", width: int = SHINGLE, radius: int = RADIUS, keep: tuple[str, ...] = ()
) -> DataFrame:
    """(doc_id, *keep, fp, root, component_id) of every row.

    ``root`` is the smallest fingerprint reachable over links, as a signed long, and ``component_id`` the smallest
    ``doc_id`` of the component; a null one counts only where there is no other.
    Repeated rows stay repeated, other columns are ignored, and an empty table gives no rows.
    """
    marked = stored(fingerprints(docs.select("doc_id", *keep, text), text, width))
    own = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(own.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = stored(own.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    named = stored(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    labels = stored(rooted.select("fp", "root").join(named, "root"))
    return marked.join(labels, "fp").select("doc_id", *keep, "fp", "root", "component_id")


def keep_one(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of every class of near-duplicates: that of the smallest id, of equal ids that of the smallest hash.

    A null id is kept only where the class has no other.
    """
    found = classes(keyed(docs).select("doc_id", "doc", "text"), "text", width, radius, keep=("doc",))
    rank = F.struct(F.col("doc.no_id").alias("no_id"), "doc_id", F.col("doc.text").alias("text"))
    found = stored(found.select("doc", "root", rank.alias("rank")))
    kept = stored(found.groupBy("root").agg(F.min("rank").alias("least")))
    left = without(docs, found.join(kept, "root").filter(~F.col("rank").eqNullSafe(F.col("least"))))
    repeated = found.groupBy("doc").count().filter("count > 1")
    if repeated.isEmpty():
        return left
    # Rows that repeat id and text are in ``left`` together.
    return keyed(left).dropDuplicates(["doc"]).select(docs.columns)


@query()
def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = classes(table(spark, folder, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

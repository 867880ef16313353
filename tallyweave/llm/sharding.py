"""Resharding by minimum-cost flow.

The rows of every old shard are dealt into blocks by hash, and the blocks are sized in one pass. From the
old shards' bytes and the new shards' capacities, a minimum-cost flow says how many bytes go from
where to where; a byte that stays costs nothing. Blocks then fill the flows, largest first, and
single blocks are moved as long as that evens the shards out. Only shards that gain or
lose a block are rewritten.

The flow is solved on the driver. It has a node for every shard, and the driver holds a row for every block:
both are bounded by the settings and not by the data.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import IntegerType, StructField, StructType

from tallyweave.llm.registry import query, table
from tallyweave.llm.shared import stored
from tallyweave.session import scratch

#: Shards of the result, and hash blocks of an old shard.
SHARDS, BLOCKS = 24, 1024
#: Bytes that a row takes beside its text.
ROW_BYTES = 8
#: Shards that the documents lie in before, by source.
OLD_SHARDS = 16
#: Bytes of documents in a file of a shard.
FILE_BYTES = 128 << 20


def min_cost_flow(
    supply: list[int], demand: list[int], cost: Callable[[int, int], float] = lambda a, b: float(a != b)
) -> dict[tuple[int, int], int]:
    """Amounts from a supply to a demand, all of both, at the least total of amount times cost.

    By successive shortest paths in the residual network.
    """
    if sum(supply) != sum(demand):
        raise ValueError(f"supplies of {sum(supply)} and demands of {sum(demand)} have to be equal")
    left, wanted = list(supply), list(demand)
    flow: dict[tuple[int, int], int] = defaultdict(int)
    price = {(a, b): cost(a, b) for a in range(len(supply)) for b in range(len(demand))}
    while any(left):
        # Distances from all supplies that are left; a flow can be taken back at its price.
        far = {("s", a): 0.0 for a, n in enumerate(left) if n}
        came: dict[tuple, tuple] = {}
        changed = list(far)
        while changed:
            kind, at = changed.pop(0)
            here = far[kind, at]
            if kind == "s":
                steps = [(("d", b), here + price[at, b]) for b in range(len(demand))]
            else:
                steps = [(("s", a), here - price[a, at]) for a in range(len(supply)) if flow.get((a, at))]
            for node, distance in steps:
                if distance < far.get(node, float("inf")) - 1e-12:
                    far[node], came[node] = distance, (kind, at)
                    if node not in changed:
                        changed.append(node)
        end = min((("d", b) for b, n in enumerate(wanted) if n), key=lambda node: far[node])
        path = [end]
        while path[-1] in came:
            path.append(came[path[-1]])
        path.reverse()
        amount = min(left[path[0][1]], wanted[end[1]])
        for tail, head in zip(path, path[1:], strict=False):
            if tail[0] == "d":
                amount = min(amount, flow[head[1], tail[1]])
        for tail, head in zip(path, path[1:], strict=False):
            if tail[0] == "s":
                flow[tail[1], head[1]] += amount
            else:
                flow[head[1], tail[1]] -= amount
        left[path[0][1]] -= amount
        wanted[end[1]] -= amount
    return {pair: n for pair, n in flow.items() if n}


def shares(total: int, weights: list[float]) -> list[int]:
    """``total`` by weight in whole numbers that add up to it."""
    edges, run = [0], 0.0
    for weight in weights:
        run += weight
        edges.append(round(total * run / sum(weights)))
    return [b - a for a, b in zip(edges, edges[1:], strict=False)]


def transfers(blocks: dict[tuple[int, int], int], capacity: list[int]) -> dict[tuple[int, int], int]:
    """The new shard of every block (old shard, number) of the given bytes.

    ``capacity`` adds up to the bytes of all blocks.
    """
    olds = sorted({old for old, _ in blocks})
    supply = [0] * (max(olds, default=-1) + 1)
    for (old, _), size in blocks.items():
        supply[old] += size
    need = min_cost_flow(supply, capacity)
    by_old = defaultdict(dict)
    for (old, new), amount in need.items():
        by_old[old][new] = amount
    placed, load, members = {}, [0] * len(capacity), defaultdict(set)

    def put(block: tuple[int, int], new: int) -> None:
        placed[block] = new
        load[new] += blocks[block]
        members[new].add(block)

    for block, size in sorted(blocks.items(), key=lambda b: (-b[1], b[0])):
        wants = by_old[block[0]]
        new = max(wants, key=lambda n: (wants[n], n == block[0], -n))
        wants[new] -= size
        put(block, new)
    # Shards are evened out by the block that closes most of the widest gap.
    over = lambda n: load[n] - capacity[n]
    for _ in range(len(blocks)):
        high, low = max(range(len(capacity)), key=over), min(range(len(capacity)), key=over)
        gap = over(high) - over(low)
        fitting = [b for b in members[high] if blocks[b] < gap]
        if not fitting:
            break
        block = min(fitting, key=lambda b: (abs(gap - 2 * blocks[b]), b))
        load[high] -= blocks[block]
        members[high].remove(block)
        put(block, low)
    return placed


def by_source(docs: DataFrame, shards: int = OLD_SHARDS) -> Column:
    """The old layout of the documents: whole sources, dealt to shards by hash."""
    return F.pmod(F.xxhash64("source"), F.lit(shards)).cast("int")


def _marked(docs: DataFrame, old: Column, blocks: int) -> DataFrame:
    """``docs`` with ``size``, ``text_crc32``, ``old_shard`` and ``block``."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.withColumns(
        {
            "old_shard": old,
            "size": (F.octet_length(text) + ROW_BYTES).cast("long"),
            "text_crc32": F.crc32(text.cast("binary")),
        }
    )
    dealt = F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(blocks)).cast("int")
    return rows.withColumn("block", dealt)


class Plan:
    """Which block goes to which new shard.

    ``docs`` has doc_id, text and what ``old`` needs. ``old`` gives the old shard from 0; ``weights`` has the new shards'
    shares of all bytes, equal ones by default. A null text is empty, null ids and sources are values like
    others, repeated rows are rows of their own and stay together, other columns are ignored, and
    an empty table has an empty plan.
    """

    def __init__(self, docs: DataFrame, old: Column, weights: list[float] = (1.0,) * SHARDS, blocks: int = BLOCKS):
        self.old, self.blocks = old, blocks
        wanted = {"doc_id", "text", "source"} & set(docs.columns)
        self.rows = stored(_marked(docs.select(*sorted(wanted)), old, blocks).drop("text", "source"))
        sizes = self.rows.groupBy("old_shard", "block").agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
        sizes = sorted(tuple(r) for r in sizes.collect())
        self.capacity = shares(sum(size for _, _, size, _ in sizes), list(weights))
        self.placed = transfers({(old_shard, block): size for old_shard, block, size, _ in sizes}, self.capacity)
        self.moved_bytes = sum(size for o, b, size, _ in sizes if self.placed[o, b] != o)
        supply = [0] * (1 + max((o for o, _, _, _ in sizes), default=-1))
        for o, _, size, _ in sizes:
            supply[o] += size
        #: What any plan has to move, if blocks could be cut.
        self.least_bytes = sum(n for (o, new), n in min_cost_flow(supply, self.capacity).items() if o != new)
        self.affected = sorted({s for (o, _), new in self.placed.items() if new != o for s in (o, new)})
        begin = [0] * len(self.capacity)
        rows = []
        for old_shard, block, _, count in sizes:
            shard = self.placed[old_shard, block]
            rows.append((old_shard, block, shard, begin[shard]))
            begin[shard] += count
        spark = docs.sparkSession
        self.table = spark.createDataFrame(rows, "old_shard int, block int, shard int, begin long")

    def slots(self) -> DataFrame:
        """(doc_id, size, text_crc32, old_shard, shard, slot); slots of a shard count from 0 without gaps.

        They are numbered within blocks, so no shard is sorted as a whole.
        """
        within = Window.partitionBy("old_shard", "block").orderBy("doc_id", "text_crc32", "size")
        rows = self.rows.withColumn("nth", F.row_number().over(within) - 1)
        slot = (F.col("begin") + F.col("nth")).cast("long").alias("slot")
        return rows.join(F.broadcast(self.table), ["old_shard", "block"]).select(
            "doc_id", "size", "text_crc32", "old_shard", "shard", slot
        )

    def assign(self, docs: DataFrame) -> DataFrame:
        """``docs`` with ``shard``, without a shuffle."""
        names = [c for c in docs.columns if c != "shard"]
        rows = _marked(docs.select("doc_id", "text", "source", F.struct(*names).alias("row")), self.old, self.blocks)
        return rows.join(F.broadcast(self.table), ["old_shard", "block"]).select("row.*", "shard")

    def rewritten(self, docs: DataFrame) -> DataFrame:
        """``docs`` with ``shard``: affected shards from their new files, the others as they are."""
        spark, folder = docs.sparkSession, scratch(docs.sparkSession, "shards")
        docs = docs.select(*[c for c in docs.columns if c != "shard"])
        kept = self.assign(docs).filter(~F.col("shard").isin(self.affected) if self.affected else F.lit(True))
        if not self.rewrite(docs, folder):
            return kept
        schema = StructType([*docs.schema.fields, StructField("shard", IntegerType())])
        return spark.read.schema(schema).parquet(folder).unionByName(kept)

    def rewrite(self, docs: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> list[int]:
        """Write the new contents of the affected shards as Parquet, and return these shards.

        Folders are named ``shard=<n>``, with files of about ``file_bytes`` of documents or less. Other shards stay as they are.
        """
        rows = self.assign(docs).filter(F.col("shard").isin(self.affected) if self.affected else F.lit(False))
        # However much a shard holds, a task writes a few files' worth.
        files = max(1, -(-max(self.capacity, default=0) // file_bytes))
        part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(files))
        dealt = rows.repartition(max(1, len(self.affected) * files), "shard", part)
        dealt.write.mode("overwrite").partitionBy("shard").parquet(folder)
        return self.affected


@query()
def op6_resharding(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's place after its sources' shards are evened out to equal bytes."""
    docs = table(spark, folder, "documents")
    plan = Plan(docs, by_source(docs))
    return plan.slots().select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        # Of the whole plan: what it moves, and the least that any could.
        F.lit(plan.moved_bytes).cast("long").alias("moved_bytes"),
        F.lit(plan.least_bytes).cast("long").alias("least_bytes"),
    )

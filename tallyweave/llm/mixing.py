"""Mixing sources to target weights by Sainte-Lague apportionment.

The mix is cut into ``BLOCKS`` blocks of equal tokens. Every source gets one, and the others are allocated one by one by the
highest quotient target / (2 k + 1), where k is what the source already has. The order of allocation
deals the blocks to shards, so every shard has integer quotas and sources are spread evenly over shards.

The documents of a source are laid end to end in a seeded order and cut into blocks as well. These are passed through in another
seeded order, again and again where the target is larger than the source, and fill the source's quota: all of its blocks but the
last with as many words as a block has, and the last with what is left of its target. What a document gives is the part of
it that lies in the words taken.

Everything is built-in Spark expressions. Draws are md5 of the seed and the row, so reruns agree. Sums along an
order go by ranges or buckets of it, so neither a source with most of the rows nor a very long list of sources is one task.
A source has at most ``BLOCKS`` rows of blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyweave.llm.registry import query, table
from tallyweave.llm.shared import keyed, running, space_words, stored

BLOCKS = 20_000
SHARDS = 16
#: Weights of the sources by code point, null last, repeating.
WEIGHTS = (1, 2, 3)
#: A mix takes a document at most so many times.
REPEATS = 3
SEED = 42
#: Buckets of a source's seeded order.
BUCKETS = 4096
#: Size classes of documents for each doubling of the size.
CLASSES = 12


def sized(docs: DataFrame) -> DataFrame:
    """With ``size``, the number of words between white space; 0 for a null text."""
    return docs.withColumn("size", F.size(space_words(F.col("text"))).cast("long"))


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, no_source, rank, source_size, weight, target) of every source of (source, size).

    The sum of all sizes is shared by weight. A target stops at ``repeats`` times the source's size, and the
    excess is shared by the others in the same way until none is above. So all targets below their stop are one
    level times the weight. Sources are passed in order of stop / weight; the first whose stop is not below the
    level that is left for it and those after it sets the level. ``source`` is empty where ``no_source``.
    """
    known = F.coalesce("source", F.lit("")).alias("source")
    sizes = rows.select(known, F.col("source").isNull().alias("no_source"), "size")
    sizes = sizes.groupBy("source", "no_source").agg(F.sum("size").alias("source_size"))
    ranked = running(sizes.withColumn("one", F.lit(1)), [], ["no_source", "source"], "one", "rank")
    kinds = F.array(*[F.lit(int(w)) for w in weights])
    ranked = ranked.withColumn("weight", F.element_at(kinds, (F.col("rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("stop", F.col("source_size") * repeats)
    ranked = ranked.withColumns({"fill": F.col("stop") / F.col("weight"), "rank": F.col("rank").cast("int")})
    ranked = running(ranked, [], ["fill", "rank"], "stop", "passed")
    ranked = stored(running(ranked, [], ["fill", "rank"], "weight", "lighter"))
    total, heavy = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    ranked = ranked.withColumn("level", (F.lit(total) - F.col("passed")).cast("double") / (F.lit(heavy) - F.col("lighter")))
    fits = ranked.filter(F.col("level") * F.col("weight") <= F.col("stop"))
    level = fits.agg(F.min_by("level", F.struct("fill", "rank"))).first()[0]
    share = F.lit(level).cast("double") * F.col("weight") if level is not None else F.col("stop").cast("double")
    target = F.least(F.col("stop").cast("double"), share).alias("target")
    return stored(ranked.select("source", "no_source", "rank", "source_size", "weight", target))


def seats(sources: DataFrame, blocks: int, shards: int = SHARDS) -> DataFrame:
    """(rank, nth, shard): the blocks of the mix in order of allocation; ``nth`` counts those of a source.

    Every source with a target gets its first block, the largest first, and further ones go by highest quotients. There are
    ``blocks`` in all, or one for every source if these are more. A source bids for its worth in blocks and for its share of
    what rounding can leave, half a block for every source; highest quotients never give it more.
    """
    known = sources.filter("target > 0").select("rank", "target")
    total, count = known.agg(F.sum("target"), F.count("*")).first()
    blocks = max(blocks, count)
    if not count:
        return stored(known.select("rank", F.lit(0).alias("nth"), F.lit(0).alias("shard")))
    worth = F.col("target") * blocks / F.lit(total)
    bids = F.least(F.lit(blocks), F.ceil(worth + F.col("target") / F.lit(total) * count / 2) + 1).cast("int")
    offers = known.select("rank", "target", F.explode(F.sequence(F.lit(0), bids - 1)).alias("nth"))
    offers = offers.withColumns({"more": F.col("nth") > 0, "low": -F.col("target") / (2 * F.col("nth") + 1), "one": F.lit(1)})
    given = running(offers, [], ["more", "low", "rank", "nth"], "one", "seat").filter(F.col("seat") < blocks)
    return stored(given.select("rank", "nth", F.floor(F.col("seat") * shards / blocks).cast("int").alias("shard")))


def quotas(given: DataFrame) -> DataFrame:
    """(shard, rank, blocks): the integer quotas per shard."""
    return given.groupBy("shard", "rank").agg(F.count("*").alias("blocks"))


def _draw(*what: Column) -> Column:
    return F.md5(F.concat_ws(":", *[w.cast("string") for w in what]))


def block_copies(sources: DataFrame, block: int, seed: int = SEED) -> DataFrame:
    """(rank, block, copies, extra, passed, before): how often the words of every block of a source are taken.

    Blocks are passed through in a seeded order of the source, which begins anew at its end, until as many words are taken as
    its target has. ``copies`` counts the times that a block is taken whole, and ``extra`` the words at its beginning
    that are taken once more. ``passed`` counts the words of blocks that come before it in the seeded order, ``before`` the words taken of
    blocks before it in the source, and a last row without copies stands for the end of the source.
    """
    count = F.ceil(F.col("source_size") / block).cast("int")
    rows = sources.select("rank", "source_size", "target", count.alias("count"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("count"))).alias("block"))
    left = F.col("source_size") - F.col("block") * F.lit(block).cast("long")
    rows = rows.withColumn("words", F.greatest(F.lit(0), F.least(F.lit(block), left)))
    draw = _draw(F.lit(f"block:{seed}"), F.col("rank"), F.col("block"))
    order = Window.partitionBy("rank").orderBy(F.col("block") == F.col("count"), draw, "block")
    earlier = Window.unboundedPreceding, -1
    rows = rows.withColumn("passed", F.coalesce(F.sum("words").over(order.rowsBetween(*earlier)), F.lit(0)))
    goal, size = F.round("target").cast("long"), F.greatest("source_size", F.lit(1))
    rest = F.greatest(F.lit(0), F.least(F.col("words"), goal % size - F.col("passed")))
    whole = (rest == F.col("words")).cast("int")
    copies = F.when(F.col("words") > 0, F.floor(goal / size) + whole).otherwise(0).cast("long")
    rows = rows.withColumns({"copies": copies, "extra": F.when(rest < F.col("words"), rest).otherwise(0)})
    before = Window.partitionBy("rank").orderBy("block").rowsBetween(*earlier)
    before = F.coalesce(F.sum(F.col("copies") * F.col("words") + F.col("extra")).over(before), F.lit(0))
    return stored(rows.select("rank", "block", "copies", "extra", "passed", before.alias("before")))


def _laid_out(rows: DataFrame, seed: int) -> DataFrame:
    """With ``offset``, the words of the source before the row in its seeded order.

    Rows equal in id and size come in any order.
    """
    draw = _draw(F.lit(f"row:{seed}"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size"))
    bucket = (F.conv(F.substring("draw", 1, 8), 16, 10).cast("long") % BUCKETS).cast("int")
    rows = rows.withColumn("draw", draw).withColumn("bucket", bucket)
    sums = rows.groupBy("rank", "bucket").agg(F.sum("size").alias("sum"))
    earlier = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(sums.select("rank", "bucket", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("begin")))
    within = Window.partitionBy("rank", "bucket").orderBy("draw", "doc_id", "size")
    within = within.rowsBetween(Window.unboundedPreceding, -1)
    inner = rows.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return inner.join(starts, ["rank", "bucket"]).withColumn("offset", F.col("begin") + F.col("inner"))


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    """For broadcast, if it has at most ``rows`` rows of fixed size."""
    return F.broadcast(df) if df.count() <= rows else df


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    repeats: int = REPEATS,
    blocks: int = BLOCKS,
    seed: int = SEED,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, source, *keep, size, source_size, target, taken, shard) of every row of ``docs``.

    ``taken`` counts the words that the mix takes of the row, repeats included, and is at most ``repeats`` times its
    size. A source's ``taken`` is its target, rounded to words. ``shard`` is that of the block of the mix which the row's first
    word is in (on the first pass), null where that word is not taken. Null and empty texts have no words and give none, a null
    source comes last, repeated rows are rows of their own, other columns are ignored, and an empty table gives no rows.
    """
    rows = stored(sized(docs).select("doc_id", "source", *keep, "size"))
    sources = targets(rows, weights, repeats)
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    block = max(1, -(-total // blocks))
    given = seats(sources, max(1, round(total / block)))
    chosen = block_copies(sources, block, seed)
    chosen = _bounded(chosen, 10 * blocks)
    seated = _bounded(stored(given.groupBy("rank").agg(F.count("*").alias("seats"))), 10 * blocks)
    known = _bounded(sources.withColumnsRenamed({"source": "name", "target": "goal"}), 10 * blocks)
    same = (F.coalesce(rows["source"], F.lit("")) == known["name"]) & (rows["source"].isNull() == known["no_source"])
    ranked = rows.join(known, same).select(*rows.columns, "source_size", F.col("goal").alias("target"), "rank")
    laid = _laid_out(ranked, seed)

    def until(df: DataFrame, place: Column, name: str) -> DataFrame:
        """With the words taken before ``place`` of the source, and where in the mix it is taken first."""
        df = df.withColumn("block", F.floor(place / block).cast("int")).join(chosen, ["rank", "block"])
        inside = place - F.col("block") * block
        taken = F.col("before") + F.col("copies") * inside + F.least(inside, F.col("extra"))
        first = F.when((F.col("copies") > 0) | (inside < F.col("extra")), F.col("passed") + inside)
        return df.withColumns({name: taken, f"{name}_at": first}).drop(*chosen.columns[1:])

    laid = until(laid, F.col("offset"), "opened")
    laid = until(laid, F.col("offset") + F.col("size"), "closed")
    taken = (F.col("closed") - F.col("opened")).cast("long").alias("taken")
    laid = laid.join(seated, "rank", "left")
    # The last block of a source holds what is left.
    nth = F.least(F.floor(F.col("opened_at") / block), F.col("seats") - 1).cast("int")
    laid = laid.withColumn("nth", F.when((F.col("size") > 0) & F.col("opened_at").isNotNull(), nth))
    laid = laid.join(_bounded(given, 10 * blocks), ["rank", "nth"], "left")
    return laid.select("doc_id", "source", *keep, "size", "source_size", "target", taken, "shard")


def select_rows(docs: DataFrame, seed: int = SEED, **settings) -> DataFrame:
    """The mix as rows: each document as often as its ``taken`` says, in whole copies.

    What it is taken of a document is a number of times, seldom a whole one. These add up along the documents of a source,
    beginning with a seeded part of one, and a document gets a copy wherever the sum passes a whole
    number. The order is by size class, within it by the shard of the mix, and then by size. So copies miss a source's words by about
    its largest document, and in every class each shard gets the copies that the mix takes in it, to less than one: the quotas
    of the shards decide which documents are copied. Documents whose first word is not taken have no shard and are a group as well. Rows
    equal in id, source and text are one document, which has the copies of all of them.
    """
    own = keyed(docs).withColumn("doc", F.struct("doc.*", F.xxhash64("source").alias("source")))
    taken = mix(own.select("doc_id", "text", "source", "doc"), seed=seed, keep=("doc",), **settings)
    one = F.lit(1 << 32)
    times = F.round(F.sum("taken") / F.first("size") * one).cast("long")
    shard = F.coalesce(F.min("shard"), F.lit(-1)).alias("shard")
    taken = taken.filter("size > 0").groupBy("doc").agg(times.alias("times"), F.first("size").alias("size"), shard)
    taken = taken.withColumn("class", F.floor(F.log2("size") * CLASSES))
    taken = taken.withColumns({"source": F.col("doc.source"), "draw": _draw(F.lit(f"copies:{seed}"), F.col("doc.id"), F.col("doc.text"))})
    summed = running(taken, ["source"], ["class", "shard", "size", "draw", "doc"], "times", "sum")
    begin = F.conv(F.substring(_draw(F.lit(f"source:{seed}"), F.col("source")), 1, 8), 16, 10).cast("long")
    summed = summed.withColumn("sum", F.col("sum") + begin)
    copies = (F.floor((F.col("sum") + F.col("times")) / one) - F.floor(F.col("sum") / one)).cast("int")
    copies = stored(summed.select("doc", copies.alias("copies")).filter("copies > 0"))
    repeated = keyed(own.select("doc_id", "source", "text")).groupBy("doc", "source").count().filter("count > 1")
    own = own if repeated.isEmpty() else own.dropDuplicates(["doc"])
    rows = own.join(copies, "doc").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return rows.select(docs.columns)


ORACLE = f"""
WITH r AS (
  SELECT doc_id, source, coalesce(source, '') AS name, source IS NULL AS no_source,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size
  FROM documents),
s AS (SELECT name, no_source, sum(size)::BIGINT AS source_size FROM r GROUP BY ALL),
s1 AS (SELECT *, row_number() OVER (ORDER BY no_source, name) - 1 AS rank FROM s),
s2 AS (SELECT *, [1.0, 2.0, 3.0][rank % 3 + 1]::DOUBLE AS weight, source_size * {REPEATS}::DOUBLE AS stop FROM s1),
s3 AS (SELECT *, (sum(source_size) OVER ()
    - coalesce(sum(stop) OVER (ORDER BY stop / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY stop / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s2),
s4 AS (SELECT * EXCLUDE level, (SELECT arg_min(level, row(stop / weight, rank)) FROM s3 WHERE level * weight <= stop) AS level
  FROM s3),
s5 AS (SELECT *, least(stop, level * weight) AS target FROM s4),
b AS (SELECT greatest(1, (sum(source_size) + {BLOCKS} - 1) // {BLOCKS})::BIGINT AS block, sum(source_size) AS total FROM s),
t AS (SELECT block, greatest(1, round_even(total / block, 0), (SELECT count(*) FROM s5 WHERE target > 0))::BIGINT AS seats FROM b),
o AS (SELECT rank, target, unnest(range(0, seats)) AS nth FROM s5, t WHERE target > 0),
q AS (SELECT rank, nth, floor(seat * {SHARDS} / seats)::INTEGER AS shard FROM (
    SELECT rank, nth, row_number() OVER (ORDER BY nth > 0, target / (2 * nth + 1) DESC, rank, nth) - 1 AS seat FROM o), t
  WHERE seat < seats),
n AS (SELECT rank, count(*) AS seats FROM q GROUP BY rank),
k AS (SELECT rank, unnest(range(0, ceil(source_size / block)::BIGINT)) AS nr FROM s5, t),
k1 AS (SELECT k.rank, nr, least(block, source_size - nr * block) AS words, round(target)::BIGINT AS goal, source_size
  FROM k JOIN s5 USING (rank), t),
k2 AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY rank ORDER BY md5('block:{SEED}:' || rank || ':' || nr), nr
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS passed FROM k1),
k3 AS (SELECT *, greatest(0, least(words, goal % source_size - passed)) AS rest FROM k2),
c AS (SELECT rank, nr, passed, goal // source_size + CASE WHEN rest = words THEN 1 ELSE 0 END AS copies,
    CASE WHEN rest < words THEN rest ELSE 0 END AS extra FROM k3),
d AS (SELECT r.doc_id, r.size, s5.source_size, s5.target, s5.rank,
    md5('row:{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || size) AS draw
  FROM r JOIN s5 ON r.name = s5.name AND r.no_source = s5.no_source),
e AS (SELECT *, row_number() OVER () AS row, coalesce(sum(size) OVER (PARTITION BY rank
    ORDER BY ('0x' || substr(draw, 1, 8))::BIGINT % {BUCKETS}, draw, doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM d),
f AS (SELECT e.*, nr, copies, extra, passed, greatest(pos, nr * block) - nr * block AS low,
    least(pos + size, (nr + 1) * block) - nr * block AS high, block
  FROM e CROSS JOIN t LEFT JOIN c ON c.rank = e.rank AND nr BETWEEN pos // block AND (pos + size) // block),
g AS (SELECT row, rank, doc_id, size, source_size, target,
    coalesce(sum(copies * greatest(0, high - low) + greatest(0, least(high, extra) - least(low, extra))), 0)::BIGINT AS taken,
    min(CASE WHEN size > 0 AND nr = pos // block AND (copies > 0 OR low < extra) THEN (passed + low) // block END) AS nth
  FROM f GROUP BY ALL)
SELECT doc_id, size, source_size, target, taken, q.shard
FROM g LEFT JOIN n USING (rank) LEFT JOIN q ON q.rank = g.rank AND q.nth = CASE WHEN g.nth IS NOT NULL THEN least(g.nth, n.seats - 1) END
"""


@query(ORACLE)
def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """What the mix takes of every document, and into which shard its first word goes."""
    return mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken", "shard")

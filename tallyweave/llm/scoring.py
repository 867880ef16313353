"""Language-model scores of texts by a subword lattice.

A text is its words between white space, A-Z in lower case, and one end. A word's probability is the sum over all of its
segmentations (``lattice``): into the pieces of a given vocabulary, or into one piece that is the whole word, if the corpus
has it. Whole words weigh their count less a discount; what the discounts leave weighs the
segmentations into pieces. So the probabilities of all words and the end add up to at most 1.

A text draws its tokens from an urn that begins with ``URN`` tokens in these shares and gets a token back twice, so that
a text's words and language become likelier in it. That depends on how often words occur in the text and
not on their order.

What grows with the corpus, its distinct words, stays in tables:

1. Words are counted in the tasks and added up by Spark.
2. Expected uses of the pieces are summed over the distinct words, each counted once; there is one number for each piece.
3. Every distinct word is scored once.
4. Documents are read again. The most frequent words, ``HEAD`` at most, are sent to the tasks, and sums over them are taken there;
   all other words are joined.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import lattice
from tallyweave.llm.registry import query, table
from tallyweave.llm.shared import stored

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
FOLDS, HELD_OUT = 7, 2
#: Words that are sent to the tasks, and the longest of them in bytes.
HEAD, HEAD_BYTES = 50_000, 64
#: Counts of words that a task holds before it adds them up and hands them on.
COUNTED = 1_000_000
#: Texts whose words are taken at once.
TEXTS = 1_000
ROUNDS = 2
#: Tokens in the urn at first.
URN = 1600.0
BATCH = 20_000


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """At most ``TEXTS`` rows at once; gives Arrow's memory back at the end, since workers live on beside the next stages."""
    for batch in batches:
        for start in range(0, batch.num_rows, TEXTS):
            yield batch.slice(start, TEXTS)
    pa.default_memory_pool().release_unused()


def _words(column: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Of all words of the texts, A-Z in lower case: the row and the number among the different words, and these as binary."""
    # Of bytes, these take A-Z and ASCII's white space alone.
    lists = pc.ascii_split_whitespace(pc.ascii_lower(column.fill_null("")))
    rows, flat = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), lists.flatten()
    # White space at an end of a text leaves an empty part there.
    kept = pc.greater(pc.binary_length(flat), 0)
    encoded = flat.filter(kept).dictionary_encode()
    codes = encoded.indices.to_numpy().astype(np.int64)
    return rows[kept.to_numpy(zero_copy_only=False)], encoded.dictionary.cast(pa.binary()), codes


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, train, all): occurrences in rows where ``learn`` is true, and in all rows; word as binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def merged() -> Iterator[pa.RecordBatch]:
            parts = pa.Table.from_batches(held)
            if len(held) > 1:
                sums = [("train", "sum"), ("all", "sum")]
                parts = parts.group_by("word", use_threads=False).aggregate(sums).select(["word", "train_sum", "all_sum"])
            held.clear()
            return iter(parts.rename_columns(["word", "train", "all"]).combine_chunks().to_batches())

        for batch in _slices(batches):
            rows, words, codes = _words(batch.column(0))
            learn = np.array(batch.column(1).to_pylist(), dtype=bool)
            train = np.bincount(codes[learn[rows]], minlength=len(words))
            both = np.bincount(codes, minlength=len(words))
            held.append(pa.RecordBatch.from_arrays([words, pa.array(train), pa.array(both)], names=["word", "train", "all"]))
            if sum(part.num_rows for part in held) >= COUNTED:
                yield from merged()
        if held:
            yield from merged()

    parts = docs.select("text", "learn").mapInArrow(run, "word binary, train long, all long")
    return parts.groupBy("word").agg(F.sum("train").alias("train"), F.sum("all").alias("all"))


def _decoded(words: list[bytes]) -> list[str]:
    return [w.decode("utf-8", "replace") for w in words]


def expected_uses(words: DataFrame, pieces: lattice.Pieces, weights: lattice.Weights) -> tuple[np.ndarray, float]:
    """Uses of every piece and the number of words, over rows (word, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, known = lattice.Pieces(**vars(pieces)), lattice.Weights(**vars(weights))
        uses = np.zeros(len(known.piece) + 1)
        for batch in batches:
            texts, counts = _decoded(batch.column(0).to_pylist()), batch.column(1).to_numpy().astype(float)
            uses[-1] += counts.sum()
            for group in lattice.batches(texts):
                uses[:-1] += lattice.Lattice(vocabulary, known, [texts[i] for i in group]).uses(counts[group])
        used = np.flatnonzero(uses)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(uses[used])], names=["piece", "uses"])

    uses = np.zeros(len(weights.piece) + 1)
    # One row for every piece at most.
    for r in words.mapInArrow(run, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect():
        uses[r["piece"]] = r["uses"]
    return uses[:-1], uses[-1]


def spelled(words: DataFrame, pieces: lattice.Pieces, weights: lattice.Weights) -> DataFrame:
    """``words`` (word, train, all) with ``spelled``, the natural logarithm of its segmentations into pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, known = lattice.Pieces(**vars(pieces)), lattice.Weights(**vars(weights))
        for batch in batches:
            texts = _decoded(batch.column(0).to_pylist())
            made = np.empty(len(texts))
            for group in lattice.batches(texts):
                made[group] = lattice.Lattice(vocabulary, known, [texts[i] for i in group]).probabilities()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made)], names=["word", "train", "all", "spelled"])

    return words.mapInArrow(run, "word binary, train long, all long, spelled double")


class Model:
    """Counts of the words of ``docs`` and the lattice fitted to them.

    ``docs`` has ``text`` and a boolean ``learn``; all rows' words are scored, and those of rows with ``learn`` learnt
    from. Null texts are empty, repeated rows count again, and without rows to learn from
    the words' probabilities are those that the vocabulary's order gives them, and a text ends after every other word.
    """

    def __init__(self, docs: DataFrame, vocabulary: str = VOCABULARY, rounds: int = ROUNDS):
        words = stored(word_counts(docs))
        texts = docs.filter("learn").count()
        self.words, kinds, once, twice = words.agg(
            F.coalesce(F.sum("train"), F.lit(0)),
            F.count(F.when(F.col("train") > 0, 1)),
            F.count(F.when(F.col("train") == 1, 1)),
            F.count(F.when(F.col("train") == 2, 1)),
        ).first()
        #: All tokens, different tokens and ends.
        self.tokens, self.kinds, self.ends = self.words + texts, kinds + (texts > 0), texts
        discount = once / (once + 2 * twice) if twice else 0.5
        self.discount = min(0.9, max(0.1, discount))
        self.pieces = pieces = lattice.read_pieces(vocabulary)
        weights = lattice.normalise(pieces, np.zeros(len(pieces.texts) + 256), 0.0)
        # As in Kneser-Ney smoothing, what is backed off to goes by how many different words a piece is in.
        different = words.filter("train > 0").select("word", F.lit(1).cast("long").alias("n"))
        for _ in range(rounds if self.words else 0):
            weights = lattice.normalise(pieces, *expected_uses(different, pieces, weights))
        self.weights = weights
        own = F.greatest(F.col("train") - self.discount, F.lit(0.0)) / max(1, self.tokens)
        made = spelled(words, pieces, weights)
        # Both logarithms are of what the word weighs, whole and in pieces.
        in_pieces = F.col("spelled") + math.log(self.left)
        both = F.greatest(F.log(own), in_pieces)
        both = F.when(own > 0, both + F.log1p(F.exp(-F.abs(F.log(own) - in_pieces)))).otherwise(in_pieces)
        logs = (both / math.log(10)).alias("score"), (F.col("spelled") / math.log(10)).alias("lattice")
        self.table = stored(made.select("word", "train", "all", *logs))

    @property
    def left(self) -> float:
        """What words in pieces weigh; half without a corpus, where the other half is the end's."""
        return self.discount * self.kinds / self.tokens if self.tokens else 0.5

    @property
    def end(self) -> float:
        """log10 P of a text's end."""
        return math.log10((self.ends - self.discount) / self.tokens if self.tokens else 0.5)

    def base(self, train: Column) -> Column:
        return F.log10((train + 1) / (self.tokens + self.kinds + 1.0))


def drawn(score: Column, times: Column, urn: float = URN) -> Column:
    """log10 of what draws a token of share ``10 ** score`` so many times from the urn, before dividing by its size.

    The product of share * urn + j for every draw j from 0.
    """
    more = F.sequence(F.lit(1).cast("long"), times - 1)
    more = F.aggregate(more, F.lit(0.0), lambda sum, j: sum + F.log10(F.pow(F.lit(10.0), score) * urn + j))
    return score + math.log10(urn) + F.when(times > 1, more).otherwise(0.0)


def _lgamma(x: np.ndarray) -> np.ndarray:
    return np.fromiter(map(math.lgamma, x.tolist()), float, len(x))


def score(docs: DataFrame, model: Model, urn: float = URN) -> DataFrame:
    """``docs`` with n_tokens, n_known, base_score, score and lattice_score, in place of the text.

    ``docs`` is what the model has counted. ``base_score`` adds one to every token's count. ``score`` is log10 of the
    text's probability, with its end. ``lattice_score`` is that of the lattice alone: every word from its segmentations into
    pieces, whether the corpus has it or not, in the share that the end leaves, and without the urn.
    """
    head = model.table.filter(F.octet_length("word") <= HEAD_BYTES).orderBy(F.desc("all"), "word").limit(HEAD)
    head = stored(head.withColumn("base", model.base(F.col("train"))))
    rows = head.select("word", "score", "base", "lattice", (F.col("train") > 0).cast("long")).collect()
    columns = list(zip(*rows, strict=True)) or [()] * 5
    heads = [pa.array(map(bytes, columns[0]), pa.binary()), *[np.array(c, dtype=float) for c in columns[1:]]]
    sent = docs.sparkSession.sparkContext.broadcast(heads)
    names = [c for c in docs.columns if c != "text"]
    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c != "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (known, scores, bases, lattices, in_train), first, ten = sent.value, math.log10(urn), math.log(10)
        shares = urn * 10.0**scores
        for batch in _slices(batches):
            rows, words, codes = _words(batch.column(len(names)))
            size, different = batch.num_rows, max(1, len(words))
            # Every word of a text once, texts in order.
            places, times = np.unique(rows * different + codes, return_counts=True)
            row, code = np.divmod(places, different)
            at = pc.index_in(words, value_set=known).fill_null(-1).to_numpy()[code]
            of_head = at >= 0
            where, found, count = row[of_head], at[of_head], times[of_head]

            def summed(values: np.ndarray, where: np.ndarray = where, size: int = size) -> np.ndarray:
                # Without values these are whole numbers.
                return np.bincount(where, values, minlength=size).astype(float)

            n = np.bincount(rows, minlength=size)
            total = summed(scores[found] + first)
            again = count > 1
            share, more = shares[found[again]], count[again]
            total += summed((_lgamma(share + more) - _lgamma(share + 1.0)) / ten, where[again])
            # The urn has a token more after every draw, the end's included.
            total -= (_lgamma(urn + n + 1) - math.lgamma(urn)) / ten
            seen = np.rint(summed(count * in_train[found]))
            sums = [n, seen, summed(count * bases[found]), total, summed(count * lattices[found])]
            others = np.append(0, np.cumsum(np.bincount(row[~of_head], minlength=size)))
            rest = words.take(pa.array(code[~of_head]))
            columns = [pa.array(c.astype(t)) for c, t in zip(sums, _KINDS, strict=True)]
            lists = [pa.ListArray.from_arrays(pa.array(others, pa.int32()), c) for c in (rest, pa.array(times[~of_head]))]
            own = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*own, *columns, *lists], names=[*names, *_SUMS, "rest", "times"])

    made = docs.select(*names, "text").mapInArrow(
        run, f"{kinds}, _n long, _known long, _base double, _score double, _lattice double, rest array<binary>, times array<long>"
    )
    made = stored(made.withColumn("_row", F.monotonically_increasing_id()))
    other = made.select("_row", F.explode(F.arrays_zip("rest", "times")).alias("word"))
    other = other.select("_row", "word.times", F.col("word.rest").alias("word"))
    by_row = (
        other.join(model.table.join(head.select("word"), "word", "left_anti"), "word")
        .groupBy("_row")
        .agg(
            F.sum(F.when(F.col("train") > 0, F.col("times")).otherwise(0)).alias("more_known"),
            F.sum(F.col("times") * model.base(F.col("train"))).alias("more_base"),
            F.sum(drawn(F.col("score"), F.col("times"), urn)).alias("more_score"),
            F.sum(F.col("times") * F.col("lattice")).alias("more_lattice"),
        )
    )
    ends = F.lit(model.ends).cast("long")
    # log10 of what the end leaves for words.
    rest_share = math.log10(max(1.0 - 10.0**model.end, 1e-300))

    def added(name: str, end: Column) -> Column:
        return F.col(f"_{name}") + F.coalesce(f"more_{name}", F.lit(0)) + end

    return made.drop("rest", "times").join(by_row, "_row", "left").select(
        *names,
        (F.col("_n") + 1).alias("n_tokens"),
        added("known", F.when(ends > 0, 1).otherwise(0)).cast("long").alias("n_known"),
        added("base", model.base(ends)).alias("base_score"),
        added("score", F.lit(model.end + math.log10(urn))).alias("score"),
        added("lattice", F.col("_n") * F.lit(rest_share) + F.lit(model.end)).alias("lattice_score"),
    )


_SUMS = ["_n", "_known", "_base", "_score", "_lattice"]
_KINDS = [np.int64, np.int64, np.float64, np.float64, np.float64]


@query()
def op3_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of every document by a lattice fitted to those that are not held out."""
    held_out = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False))
    docs = table(spark, folder, "documents").select("doc_id", "text", held_out.alias("held_out"))
    model = Model(docs.select("text", (~F.col("held_out")).alias("learn")))
    return score(docs, model).withColumn("train_tokens", F.lit(model.tokens).cast("long"))

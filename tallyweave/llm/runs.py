"""Periodic runs of words, by Lyndon roots from Baier's grouping of suffixes.

A run is a stretch of words that repeats with a smallest period q and cannot be made longer. Every run holds a Lyndon word of
length q, a word smaller than all of its own suffixes, that is the longest one from its place under one of two orders:
that of the words or its reverse. So the runs of a text follow from its two Lyndon arrays:

1. ``lyndon`` has the first phase of Baier's suffix sorter. Suffixes are grouped by their first word, and groups are
   passed from the greatest to the smallest. Each member finds the nearest suffix before it that is in a smaller
   group; those which k members find go to a new group right above their own, whose context gets longer by
   k contexts. When a group's turn comes its context is the longest Lyndon word from each of its
   members, so the phase yields the Lyndon array itself; nothing is sorted afterwards.
2. Every root is extended to both sides by longest common extensions of the text with itself, a period apart.

Words that are too few to be in a run of the exponent asked for are taken out first. In a run of exponent e, every
word occurs e times or more (rounded down). So words which occur less often cut the text, and again in each part until
none is left. That takes no run away or apart, and most texts wholly.

A text is worked on by itself, whole, in time that grows as its words (and logarithms), so rows need no shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tallyweave.llm.registry import query, table

#: Words and periods that a run has at least.
LEAST, EXPONENT = 6, 4
#: Words compared at first when a root is extended; then twice as many, and so on.
REACH = 16
#: Times that rare words are looked for; stretches with some left are searched all the same.
PASSES = 16

Run = tuple[int, int, int]


def lyndon(ranks: list[int]) -> list[int]:
    """Length of the longest Lyndon word from every place of a text of small integers.

    A word is Lyndon if it is smaller than all of its proper suffixes. Linear but for the paths to the nearest
    smaller group, which are halved as they are walked.
    """
    found = [0] * len(ranks)
    group = list(ranks)
    members: list[list[int]] = [[] for _ in range(max(ranks, default=-1) + 1)]
    for at, rank in enumerate(ranks):
        members[rank].append(at)
    context = [1] * len(members)
    # The next smaller group of each; a new one gets the next number.
    below = list(range(-1, len(members) - 1))
    # The nearest place before, of those done, that was in a smaller group when they were.
    before = list(range(-1, len(ranks) - 1))
    # Who is right above a group, so that a new one can come between.
    above = list(range(1, len(members) + 1))
    done = bytearray(len(ranks))
    now = len(members) - 1
    while now >= 0:
        size = context[now]
        # Places with a smaller group, and how many members of this one find each; ascending as the members are.
        smaller: list[int] = []
        times: list[int] = []
        for at in members[now]:
            if group[at] != now:
                continue
            found[at] = size
            done[at] = 1
            near = at - 1
            while near >= 0 and done[near]:
                further = before[near]
                if further >= 0 and done[further]:
                    before[near] = before[further]
                near = further
            before[at] = near
            if near >= 0:
                if smaller and smaller[-1] == near:
                    times[-1] += 1
                else:
                    smaller.append(near)
                    times.append(1)
        if smaller:
            raised: dict[tuple[int, int], list[int]] = {}
            for near, k in zip(smaller, times):
                key = (k, group[near])
                if key in raised:
                    raised[key].append(near)
                else:
                    raised[key] = [near]
            # Those found most often come first, right above their old group, and the others between.
            for k, old in sorted(raised, reverse=True):
                own, new = raised[k, old], len(members)
                members.append(own)
                context.append(context[old] + k * size)
                top = above[old]
                below.append(old)
                above.append(top)
                below[top] = new
                above[old] = new
                for near in own:
                    group[near] = new
        members[now] = []
        now = below[now]
    return found


def _extended(words: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """The longest stretch around the root at ``at`` that keeps ``period``, as start and stop."""
    size, stop, reach = len(words), at + period, REACH
    while stop < size:
        part = words[stop : stop + reach]
        other = np.flatnonzero(part != words[stop - period : stop - period + len(part)])
        if len(other):
            stop += int(other[0])
            break
        stop, reach = stop + len(part), 2 * reach
    start, reach = at, REACH
    while start > 0:
        low = max(0, start - reach)
        other = np.flatnonzero(words[low:start] != words[low + period : start + period])
        if len(other):
            start = low + int(other[-1]) + 1
            break
        start, reach = low, 2 * reach
    return start, stop


def _of_roots(words: np.ndarray, roots: np.ndarray, least: int, exponent: int) -> set[Run]:
    """Runs (start, length, period) that the roots of one order lead to."""
    places = np.arange(len(roots))
    if exponent > 2:
        # Roots follow each other in such a run, so that the first of two is enough.
        after = places + roots
        places = places[(after < len(roots)) & (roots[np.minimum(after, len(roots) - 1)] == roots)]
    out, reached = set(), {}
    for at, period in zip(places.tolist(), roots[places].tolist(), strict=True):
        # Runs of a period overlap by less than it, so the last one tells whether the root is known.
        if reached.get(period, 0) >= at + period:
            continue
        start, stop = _extended(words, at, period)
        reached[period] = stop
        if stop - start >= max(least, exponent * period):
            out.add((start, stop - start, period))
    return out


def _parts(words: np.ndarray, least: int, exponent: int) -> Iterator[tuple[int, int]]:
    """Stretches that can hold runs: each word occurs ``exponent`` times in its own, as start and stop.

    All stretches are counted at once, by pairs of stretch and word, until none changes or ``PASSES`` are over.
    """
    starts, stops = np.array([0]), np.array([len(words)])
    for turn in range(PASSES):
        sizes = stops - starts
        starts, sizes = starts[sizes >= least], sizes[sizes >= least]
        if not len(starts):
            return
        owner = np.repeat(np.arange(len(starts)), sizes)
        places = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
        pairs = owner.astype(np.int64) * (int(words.max()) + 1) + words[places]
        _, which, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        kept = counts[which] >= exponent
        if kept.all() or turn == PASSES - 1:
            yield from zip(starts.tolist(), (starts + sizes).tolist(), strict=True)
            return
        opens = kept & np.concatenate(([True], ~kept[:-1] | (owner[1:] != owner[:-1])))
        closes = kept & np.concatenate((~kept[1:] | (owner[1:] != owner[:-1]), [True]))
        starts, stops = places[opens], places[closes] + 1


def runs_of(words: list, least: int = LEAST, exponent: int = EXPONENT) -> list[Run]:
    """All runs (start, length, period) of at least ``least`` words and ``exponent`` periods, by start and period.

    ``exponent`` is a whole number from 2 on. Words are compared for equality.
    """
    if exponent < 2:
        raise ValueError("a run has two periods at least")
    if len(words) < max(least, exponent):
        return []
    numbers: dict = {}
    whole = np.array([numbers.setdefault(w, len(numbers)) for w in words])
    found = set()
    for begin, end in _parts(whole, max(least, exponent), exponent):
        part = whole[begin:end]
        kinds, ranks = np.unique(part, return_inverse=True)
        for order in (ranks, len(kinds) - 1 - ranks):
            roots = np.array(lyndon(order.tolist()))
            found |= {(begin + start, length, q) for start, length, q in _of_roots(part, roots, least, exponent)}
    return sorted(found, key=lambda run: (run[0], run[2]))


def kept_words(words: list, runs: list[Run]) -> list:
    """The words but for those that any run has after its first period."""
    if not runs:
        return words
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return [w for w, over in zip(words, np.cumsum(edges).tolist(), strict=False) if not over]


def collapsed(
    docs: DataFrame,
    keep: tuple[str, ...] = ("doc_id",),
    least: int = LEAST,
    exponent: int = EXPONENT,
    changed: Callable[[list[bytes], tuple], list[bytes]] | None = None,
) -> DataFrame:
    """(*keep, runs, collapsed) of every row: the runs of its words, and its text with one period of each.

    ``runs`` are (start, length, period) in words, by start and period. Words lie between white space of ASCII,
    and ``collapsed`` has those that stay, joined by one space. ``changed`` may replace the words of a text, given
    them and the kept values. Null and empty texts have no words, no runs and an empty ``collapsed``. Every row is worked on
    by itself, so repeated rows stay, other columns are ignored, and an empty table gives no rows.
    """
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, left = [], []
            own = [batch.column(i) for i in range(len(keep))]
            values = zip(*[c.to_pylist() for c in own], strict=True) if keep and changed else [()] * batch.num_rows
            for text, given in zip(batch.column(len(keep)).cast(pa.binary()).to_pylist(), values, strict=True):
                words = (text or b"").split()
                words = changed(words, given) if changed else words
                own_runs = runs_of(words, least, exponent)
                found.append([{"start": s, "length": n, "period": q} for s, n, q in own_runs])
                left.append(b" ".join(kept_words(words, own_runs)))
            texts = pa.array(left, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*own, pa.array(found, pa.list_(run)), texts], names=[*keep, "runs", "collapsed"])

    found = ArrayType(StructType([StructField(c, LongType()) for c in ("start", "length", "period")]))
    schema = StructType([docs.schema[c] for c in keep]).add("runs", found).add("collapsed", StringType())
    return docs.select(*keep, "text").mapInArrow(find, schema)


def longest_run(runs: str = "runs"):
    """The run of the greatest exponent, of equal ones that of the smallest start and then period; null of none.

    Exponents are compared crosswise, without division.
    """

    def better(a, b):
        mine, other = a["length"] * b["period"], b["length"] * a["period"]
        first = (a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["period"] < b["period"]))
        return (mine > other) | ((mine == other) & first)

    none = F.get(runs, F.lit(0))
    return F.aggregate(runs, none, lambda best, r: F.when(better(r, best), r).otherwise(best))


def digest_of(runs: str = "runs"):
    """Digest of a line ``start,length,period`` for each run."""
    lines = F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size(runs) > 0, "\n").otherwise("")), 256)


def planted(words: list[bytes], given: tuple) -> list[bytes]:
    """The words of a document of ``op12_runs``: every tenth id, by hash, repeats itself from some word on.

    A null id changes nothing.
    """
    (doc_id,), n = given, len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


@query()
def op12_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The runs of every document, the one of the greatest exponent, and digests of all and of what is left."""
    found = collapsed(table(spark, folder, "documents"), changed=planted)
    found = found.withColumn("best", longest_run())
    best = [F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")]
    milli = F.expr("1000 * best.length div best.period")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *best,
        milli.alias("exponent_milli"),
        digest_of().alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )

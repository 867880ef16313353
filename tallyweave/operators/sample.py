"""Repeatable splits and latent draws."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import draws
from tallyweave.functions.columns import col

#: Digits of a digest that rows are counted by at a time, and rows of a bin that are sorted.
DIGITS, FEW = 4, 10_000


def _shares(val: float, test: float | None) -> list[tuple[str, float]]:
    shares = [("train", 1 - val - (test or 0)), ("val", val)]
    if test is not None:
        shares.append(("test", test))
    if any(share < 0 for _, share in shares):
        raise ValueError("split fractions must be between 0 and 1")
    return shares


def split(
    df: DataFrame, key: Sequence[str], seed: int, val: float = 0.1, test: float | None = None
) -> DataFrame:
    """Add ``split``: train, val or test, by the hash of the row key.

    A row keeps its split however the data is partitioned. Sizes are approximate.
    """
    u = draws.uniform(seed, *map(col, key))
    label, upper = F, 0.0
    for name, share in _shares(val, test):
        upper += share
        label = label.when(u < F.lit(upper), name)
    last = "val" if test is None else "test"
    return df.withColumn("split", label.otherwise(last))


def split_sizes(rows: int, val: float, test: float | None) -> list[tuple[str, int]]:
    """Whole sizes: each share rounded down, the rest dealt out one each from the first."""
    shares = _shares(val, test)
    sizes = [int(rows * share + 1e-9) for _, share in shares]
    for i in range(rows - sum(sizes)):
        sizes[i % len(sizes)] += 1
    return [(name, size) for (name, _), size in zip(shares, sizes)]


def _bins(marked: DataFrame, prefix: str) -> list[tuple[str, int]]:
    """Rows by the next digits of marks that begin with ``prefix``, in order."""
    within = marked.where(F.col("mark").startswith(prefix)) if prefix else marked
    digits = F.substring("mark", 1, len(prefix) + DIGITS)
    return sorted(tuple(r) for r in within.groupBy(digits.alias("bin")).count().collect())


def _mark_at(marked: DataFrame, bins: list[tuple[str, int]], place: int) -> str:
    """The mark of the row at ``place`` in order of marks."""
    while True:
        for prefix, n in bins:
            if place < n:
                break
            place -= n
        if n <= FEW or len(prefix) >= 32:
            within = marked.where(F.col("mark").startswith(prefix))
            return within.orderBy("mark").offset(place).first()["mark"]
        bins = _bins(marked, prefix)


def exact_split(
    df: DataFrame, key: Sequence[str], seed: int, val: float = 0.1, test: float | None = None
) -> DataFrame:
    """As :func:`split`, with exact sizes; ``key`` must be unique.

    Rows are ranked by the digest of their key. Its first ``DIGITS`` hex digits give
    bins of nearly equal size, whose counts tell in which bin each cut
    falls. That bin is counted by its next digits in turn, until it holds at most ``FEW`` rows, which
    are sorted to find the digest at the cut. The split itself then compares digests, without a shuffle.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[col(c).cast("string") for c in key]))
    mark = F.concat_ws(":", digest, *[col(c).cast("string") for c in key])
    marked = df.select(mark.alias("mark"))
    bins = _bins(marked, "")
    rows = sum(n for _, n in bins)
    label = F
    upper = 0
    sizes = split_sizes(rows, val, test)
    for name, size in sizes[:-1]:
        upper += size
        if upper >= rows:
            return df.withColumn("split", label.when(F.lit(True), name))
        label = label.when(mark < F.lit(_mark_at(marked, bins, upper)), name)
    return df.withColumn("split", label.otherwise(sizes[-1][0]))


def with_latents(
    df: DataFrame, key: Sequence[str], size: int, seed: int, name: str = "z"
) -> DataFrame:
    """Add ``size`` standard normal numbers per row, fixed by the row key and seed."""
    return df.withColumn(name, draws.normals(size, seed, *map(col, key)))

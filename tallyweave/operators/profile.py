"""Column statistics, one pass for all columns."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.columns import col
from tallyweave.operators.density import grouping_set_counts
from tallyweave.session import cut_lineage

# Fixed value: "not applicable" in the census codes.
SENTINEL = -8

NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
WHOLE = ("tinyint", "smallint", "int", "bigint", "boolean", "date", "timestamp", "timestamp_ntz")


def is_number(dtype: str) -> bool:
    return dtype.startswith(NUMBERS)


def is_text(dtype: str) -> bool:
    """Types that are categorical whatever their values."""
    return dtype.startswith(("string", "char", "varchar", "boolean"))


def _as_double(df: DataFrame, name: str) -> Column:
    """The column as a double, null if it is no number."""
    kept = col(name) if is_number(df.schema[name].dataType.simpleString()) else F.lit(None)
    return kept.cast("double")


def profile(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    sentinel: float = SENTINEL,
    exact: bool = False,
    counted: Sequence[str] = (),
) -> DataFrame:
    """One row per column: ``column, dtype, n_rows, n_null, minimum, maximum, span, mean,
    std, has_sentinel, n_distinct``.

    Of the columns in ``counted`` only rows, nulls and distinct values are looked at, as if they were no numbers.
    ``n_distinct`` counts null as a value. It is approximate, unless ``exact``
    asks for a second pass that counts the distinct values of each column.
    """
    names = list(columns or df.columns)
    dtypes = dict(df.dtypes)

    def stats(i, name):
        number = F.lit(None).cast("double") if name in counted else _as_double(df, name)
        held = F.coalesce(F.bool_or(number == F.lit(float(sentinel))), F.lit(False))
        distinct = F.approx_count_distinct(col(name)) + F.max(col(name).isNull().cast("bigint"))
        return F.struct(
            F.lit(name).alias("column"),
            F.lit(dtypes[name]).alias("dtype"),
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(col(name).isNull()).alias("n_null"),
            F.min(number).alias("minimum"),
            F.max(number).alias("maximum"),
            (F.max(number) - F.min(number)).alias("span"),
            F.avg(number).alias("mean"),
            F.stddev_samp(number).alias("std"),
            held.alias("has_sentinel"),
            F.coalesce(distinct, F.lit(0).cast("bigint")).alias("n_distinct"),
        ).alias(f"s{i}")

    tidy = df.agg(*[stats(i, n) for i, n in enumerate(names)]).select(
        F.inline(F.array(*[F.col(f"s{i}") for i in range(len(names))]))
    )
    if not exact:
        return tidy
    counted = F.broadcast(distinct_counts(df, names))
    return tidy.drop("n_distinct").join(counted, "column", "left").fillna(0, ["n_distinct"])


def value_order(name: str, dtype: str) -> list[Column]:
    """Sort keys that put text forms of a column's values in its native order.

    Nulls first, whole numbers as such (a double would merge those beyond
    2^53), other numbers as doubles, text by itself.
    """
    column = col(name)
    whole = F.lit(None).cast("bigint")
    real = F.lit(None).cast("double")
    if dtype == "boolean":
        whole = column.cast("bigint")
    elif dtype == "date":
        whole = F.unix_date(column).cast("bigint")
    elif dtype.startswith("timestamp"):
        whole = F.unix_micros(column.cast("timestamp")).cast("bigint")
    elif dtype in WHOLE:
        whole = column.cast("bigint")
    elif is_number(dtype):
        real = column.cast("double")
    return [whole, real, column.cast("string")]


def column_values(df: DataFrame, columns: Sequence[str], many: Sequence[str] = ()) -> DataFrame:
    """Distinct values of each column with their counts: ``column, whole, real, value, n``.

    All columns are counted in one pass but those in ``many``. These are counted by themselves, in their own type: where
    most rows have a value of their own, counting sets of columns shuffles nearly all rows, as wide as all columns, for each.
    """
    dtypes = dict(df.dtypes)
    alone = [c for c in columns if c in many]
    columns = [c for c in columns if c not in many]
    frames = []
    wanted = df.select(*map(col, columns))
    sets = [(c,) for c in columns]
    for batch, _, frame in grouping_set_counts(wanted, sets, [F.count(F.lit(1)).alias("__n")]) if sets else []:
        keyed = [
            (F.col("__set") == i, [F.lit(columns[i]), *value_order(columns[i], dtypes[columns[i]])])
            for i in batch
        ]
        picked = []
        for j, name in enumerate(["column", "whole", "real", "value"]):
            case = F
            for condition, values in keyed:
                case = case.when(condition, values[j])
            picked.append(case.alias(name))
        frames.append(frame.select(*picked, F.col("__n").alias("n")))
    for name in alone:
        frame = df.select(col(name)).groupBy(col(name)).agg(F.count(F.lit(1)).alias("__n"))
        named = zip(["whole", "real", "value"], value_order(name, dtypes[name]), strict=True)
        frames.append(frame.select(F.lit(name).alias("column"), *[v.alias(k) for k, v in named], F.col("__n").alias("n")))
    out = frames[0]
    for frame in frames[1:]:
        out = out.union(frame)
    return out


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact number of distinct values of each column, null counted as a value."""
    return column_values(df, columns).groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))


def identifier_like(profiled: DataFrame) -> DataFrame:
    """Columns of a profile whose values are all different."""
    return profiled.where((F.col("n_rows") > 0) & (F.col("n_distinct") == F.col("n_rows")))


@dataclass(frozen=True)
class _Rank:
    """A wanted rank of a column, and ends that lie around it, from the nearest to the farthest.

    None is an end beyond all values, and the last pair has no other.
    """

    column: str
    rank: int
    ends: tuple[tuple[float | None, float | None], ...]


#: Distances from a share at which its neighbourhood is bracketed, in units of the sketch's error.
DISTANCES = (2, 20, 200)


def _asked(shares: Sequence[float], accuracy: int) -> list[float]:
    """The shares that a sketch is asked for: those at all distances to both sides of the wanted ones."""
    steps = [d / accuracy for d in DISTANCES]
    return sorted({min(max(q + side * d, 0.0), 1.0) for q in shares for d in steps for side in (-1, 1)})


def _sketch(df: DataFrame, name: str, shares: Sequence[float], accuracy: int) -> Column:
    """Approximate quantiles of a column, whose ranks are off by at most ``1 / accuracy`` of its values."""
    return F.percentile_approx(_as_double(df, name), _asked(shares, accuracy), accuracy)


def _ranks(name: str, n: int, found: Sequence[float], shares: Sequence[float], accuracy: int) -> list[_Rank]:
    """The ranks of the shares, bracketed by what a sketch has found."""
    asked, out = _asked(shares, accuracy), []
    for share in shares:
        rank, ends = math.floor((n - 1) * share + 0.5), []
        for d in DISTANCES:
            # An end is taken if its rank is on the right side even when it is off as far as it may be.
            low = [x for s, x in zip(asked, found) if (s + 1 / accuracy) * n + 1 <= rank and s <= share - d / accuracy]
            high = [x for s, x in zip(asked, found) if (s - 1 / accuracy) * n - 1 >= rank and s >= share + d / accuracy]
            ends.append((low[-1] if low else None, high[0] if high else None))
        out.append(_Rank(name, rank, (*ends, (None, None))))
    return out


def _intervals(ends: list[tuple[float | None, float | None]]) -> list[tuple[float, float]]:
    """The brackets of a column as intervals without overlap, in order."""
    out: list[tuple[float, float]] = []
    spans = [(-math.inf if a is None else a, math.inf if b is None else b) for a, b in ends]
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def _bracketed(df: DataFrame, intervals: dict[str, list[tuple[float, float]]]) -> DataFrame:
    """``i, slot, x, n``: counts of the values in the intervals (odd slots) and, without ``x``, of those between them.

    One scan for all columns; the counts are combined before the shuffle, and only values in
    the intervals are many. NaN is larger than any number.
    """
    entries = []
    for i, (name, spans) in enumerate(intervals.items()):
        number, slot, kept = _as_double(df, name), F, F
        for k, (low, high) in enumerate(spans):
            if low != -math.inf:
                slot, kept = slot.when(number < F.lit(low), 2 * k), kept.when(number < F.lit(low), None)
            inside = F.lit(True) if high == math.inf else number <= F.lit(high)
            slot, kept = slot.when(inside, 2 * k + 1), kept.when(inside, number)
        slot = F.when(number.isNotNull(), slot.otherwise(2 * len(spans)))
        entries.append(F.struct(F.lit(i).alias("i"), slot.alias("slot"), kept.otherwise(None).cast("double").alias("x")))
    rows = df.select(F.inline(F.array(*entries))).where("slot is not null")
    return rows.groupBy("i", "slot", "x").agg(F.count(F.lit(1)).alias("n"))


def _at_ranks(values: DataFrame, wanted: list[tuple[int, int, int]], few: int) -> dict[tuple[int, int, int], float]:
    """The value at each (i, slot, rank) of counted values; ranks begin with each slot.

    Up to ``few`` values are ranked as they are. More are dealt out by ranges, whose sums tell in which of them
    a rank lies; only those are ranked.
    """
    spark = values.sparkSession
    wanted_rows = spark.createDataFrame(wanted, "i int, slot int, rank bigint")
    by, begin = ["i", "slot"], F.lit(0).cast("bigint")
    if values.count() > few:
        placed = cut_lineage(
            values.repartitionByRange("i", "slot", "x").withColumn("part", F.spark_partition_id())
        )
        sums = placed.groupBy("part", *by).agg(F.sum("n").alias("sum"))
        # A row for each part and slot.
        before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("begin", F.coalesce(F.sum("sum").over(before), begin))
        inside = (F.col("rank") >= F.col("begin")) & (F.col("rank") < F.col("begin") + F.col("sum"))
        held = sums.join(F.broadcast(wanted_rows), by).where(inside).select("part", *by, "begin").distinct()
        values = placed.join(F.broadcast(held), ["part", *by])
        by, begin = ["part", *by], F.col("begin")
    upto = begin + F.sum("n").over(Window.partitionBy(*by).orderBy("x"))
    ranked = values.withColumn("upto", upto).join(F.broadcast(wanted_rows), ["i", "slot"])
    found = ranked.where(F.col("upto") > F.col("rank")).groupBy("i", "slot", "rank").agg(F.min("x").alias("x"))
    return {(r["i"], r["slot"], r["rank"]): r["x"] for r in found.collect()}


def _exact(df: DataFrame, ranks: list[_Rank], few: int) -> dict[_Rank, float]:
    """The values at the ranks, from one scan.

    Counts prove that a rank lies in its bracket. Should one not (sketches are merged, and a
    merged one may be off by more than it promises), it is looked for between farther ends, in another scan.
    """
    names = list(dict.fromkeys(r.column for r in ranks))
    intervals = {n: _intervals([r.ends[0] for r in ranks if r.column == n]) for n in names}
    values = cut_lineage(_bracketed(df, intervals))
    slots: dict[int, list[tuple[int, int]]] = {i: [] for i in range(len(names))}
    # At most seven rows for a column and three shares.
    for row in values.groupBy("i", "slot").agg(F.sum("n").alias("n")).orderBy("i", "slot").collect():
        slots[row["i"]].append((row["slot"], row["n"]))
    wanted, missed = {}, []
    for r in ranks:
        i, rest = names.index(r.column), r.rank
        for slot, n in slots[i]:
            if rest < n:
                break
            rest -= n
        if slot % 2:
            wanted[r] = (i, slot, rest)
        else:
            missed.append(r)
    found = _at_ranks(values.where("slot % 2 = 1"), sorted(set(wanted.values())), few) if wanted else {}
    out = {r: found[place] for r, place in wanted.items()}
    if missed:
        farther = {replace(r, ends=r.ends[1:]): r for r in missed}
        out.update({farther[r]: x for r, x in _exact(df, list(farther), few).items()})
    return out


def _quantiles(df, sketched, shares, accuracy, few) -> dict[str, list[float | None]]:
    """Quantiles of the columns of ``{name: (values, sketch)}``."""
    ranks = [
        r for name, (n, found) in sketched.items() if n for r in _ranks(name, n, found, shares, accuracy)
    ]
    exact = _exact(df, ranks, few) if ranks else {}
    out: dict[str, list[float | None]] = {name: [] for name in sketched}
    for r in ranks:
        out[r.column].append(exact[r])
    return {name: got or [None] * len(shares) for name, got in out.items()}


def quantiles(
    df: DataFrame,
    columns: Sequence[str],
    shares: Sequence[float] = (0.25, 0.5, 0.75),
    accuracy: int = 10_000,
    few: int = 100_000,
) -> dict[str, list[float | None]]:
    """Exact quantiles of numeric columns: the value whose rank is nearest to the share.

    Two scans for all columns, however many rows there are. Sketches bracket each rank in the first. The second
    counts what is below each bracket and the values inside, a few ten-thousandths of the rows, and these alone
    are ranked, by ranges if they are more than ``few``.
    """
    names = list(columns)
    if not names:
        return {}
    got = df.agg(
        *[F.count(col(n)).alias(f"n{i}") for i, n in enumerate(names)],
        *[_sketch(df, n, shares, accuracy).alias(f"q{i}") for i, n in enumerate(names)],
    ).first()
    sketched = {name: (got[f"n{i}"], got[f"q{i}"]) for i, name in enumerate(names)}
    return _quantiles(df, sketched, shares, accuracy, few)


#: Of every column, in the result of :func:`summary`.
SUMMARY_SCHEMA = (
    "column string, n bigint, n_null bigint, mean double, std double, minimum double, q25 double, q50 double,"
    " q75 double, maximum double, least string, greatest string"
)


def summary(
    df: DataFrame, columns: Sequence[str] | None = None, accuracy: int = 10_000, few: int = 100_000
) -> DataFrame:
    """Counts, nulls and extremes of every column; mean, std and quartiles of the numeric ones.

    ``least`` and ``greatest`` are the extremes of the other columns, as text. Two scans: one has all statistics and the
    sketches for the quartiles, the other the values around these (see :func:`quantiles`).
    """
    names, dtypes = list(columns or df.columns), dict(df.dtypes)
    numbers, shares = [n for n in names if is_number(dtypes[n])], (0.25, 0.5, 0.75)

    def stats(i, name):
        number = _as_double(df, name)
        is_other = name not in numbers
        other = col(name) if is_other else F.lit(None).cast("string")
        return F.struct(
            F.count(col(name)).alias("n"),
            F.count_if(col(name).isNull()).alias("n_null"),
            F.avg(number).alias("mean"),
            F.stddev_samp(number).alias("std"),
            F.min(number).alias("minimum"),
            F.max(number).alias("maximum"),
            F.min(other).cast("string").alias("least"),
            F.max(other).cast("string").alias("greatest"),
            *([] if is_other else [_sketch(df, name, shares, accuracy).alias("sketch")]),
        ).alias(f"s{i}")

    got = df.agg(*[stats(i, n) for i, n in enumerate(names)]).first()
    facts = {name: got[f"s{i}"] for i, name in enumerate(names)}
    quartiles = _quantiles(df, {n: (facts[n]["n"], facts[n]["sketch"]) for n in numbers}, shares, accuracy, few)
    rows = []
    for name, f in facts.items():
        middle = quartiles.get(name, [None] * 3)
        rows.append((name, f["n"], f["n_null"], f["mean"], f["std"], f["minimum"], *middle, f["maximum"], f["least"], f["greatest"]))
    return df.sparkSession.createDataFrame(rows, SUMMARY_SCHEMA)

"""Comparing the k-way marginal distributions of two tables.

The tables are stacked with a side flag and counted with grouping sets, so each
row is read once for many column combinations and nulls compare as values.
Counts are combined before the shuffle, hence a hot cell costs no more than any
other, and no window ever gathers the cells of one combination.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.columns import col, text
from tallyweave.operators.tables import require_same_columns

# Generated code for more sets than this outgrows what the JVM compiles, and
# grouping_id() has 64 bits.
SETS_PER_JOB = 32
COLUMNS_PER_JOB = 60


def frequencies(df: DataFrame, columns: Sequence[str], name: str = "n") -> DataFrame:
    """Rows per combination of values; nulls form groups of their own."""
    return df.groupBy(*map(col, columns)).agg(F.count(F.lit(1)).alias(name))


def value_counts(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    return frequencies(df, [column], name)


def cell_name(columns: Sequence[str]) -> Column:
    """Display text of a cell, ``a_b_c``. It is never used as a key."""
    return F.concat_ws("_", *[text(col(c)) for c in columns])


def column_combinations(columns: Sequence[str], orders: Sequence[int]) -> list[tuple[str, ...]]:
    """All combinations of the given sizes, in column order."""
    for order in orders:
        if not 1 <= order <= len(columns):
            raise ValueError(f"order {order} needs 1 to {len(columns)} columns")
    return [combo for order in orders for combo in combinations(columns, order)]


def _batches(sets: Sequence[tuple[str, ...]]) -> list[list[int]]:
    """Positions of the sets to count together."""
    batches, names = [], set()
    for i, columns in enumerate(sets):
        merged = names | set(columns)
        if not batches or len(batches[-1]) == SETS_PER_JOB or len(merged) > COLUMNS_PER_JOB:
            batches.append([])
            merged = set(columns)
        batches[-1].append(i)
        names = merged
    return batches


def grouping_set_counts(
    df: DataFrame, sets: Sequence[tuple[str, ...]], aggregates: Sequence[Column]
) -> list[tuple[list[int], list[str], DataFrame]]:
    """Count several column sets in one pass each batch.

    Returns per batch the positions of its sets, its columns and a frame of
    those columns (null where not part of the set), ``__set`` (the position) and
    the aggregates.
    """
    out = []
    for batch in _batches(sets):
        names = [c for c in df.columns if any(c in sets[i] for i in batch)]
        # Bit j of grouping_id, from the left, is 1 when column j is not in the set.
        ids = {
            sum(1 << (len(names) - 1 - j) for j, c in enumerate(names) if c not in sets[i]): i
            for i in batch
        }
        grouped = df.groupingSets(
            [[col(c) for c in sets[i]] for i in batch], *map(col, names)
        ).agg(F.grouping_id().alias("__id"), *aggregates)
        position = F
        for bits, i in ids.items():
            position = position.when(F.col("__id") == bits, i)
        out.append((batch, names, grouped.withColumn("__set", position).drop("__id")))
    return out


def cover(
    combos: Sequence[tuple[str, ...]], sizes: Mapping[str, int], max_cells: int
) -> list[tuple[tuple[str, ...], list[tuple[str, ...]]]]:
    """Gather combinations into wider column sets of at most ``max_cells`` cells.

    Each combination belongs to exactly one set holding all its columns. A
    combination that is larger than ``max_cells`` by itself stays alone. A set
    starts with the largest combination left, and grows by the column that
    brings in the most of the others, as long as it stays within bounds.
    """

    def cells(columns):
        return math.prod(sizes[c] for c in columns)

    left = set(combos)
    with_column = {c: [m for m in combos if c in m] for c in sizes}

    def gain(columns, extra):
        wider = columns | {extra}
        if len(wider) > COLUMNS_PER_JOB or cells(wider) > max_cells:
            return 0
        return sum(m in left and wider.issuperset(m) for m in with_column[extra])

    covers = []
    for seed in sorted(combos, key=lambda c: (-len(c), -cells(c), c)):
        if seed not in left:
            continue
        columns = set(seed)
        while True:
            gains = {c: gain(columns, c) for c in sizes if c not in columns}
            best = max(gains, key=lambda c: (gains[c], -sizes[c]), default=None)
            if best is None or not gains[best]:
                break
            columns.add(best)
        members = [m for m in combos if m in left and columns.issuperset(m)]
        left.difference_update(members)
        covers.append((tuple(sorted(columns)), members))
    return covers


def column_sizes(*tables: DataFrame) -> dict[str, int]:
    """Approximate distinct values per column, null counted as one, in one pass per table."""
    sizes: dict[str, int] = {}
    for df in tables:
        counts = [F.approx_count_distinct(col(c)).alias(f"n{i}") for i, c in enumerate(df.columns)]
        for name, n in zip(df.columns, df.agg(*counts).first()):
            sizes[name] = max(sizes.get(name, 0), n + 1)
    return sizes


def _stack(target: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Both tables in one frame with 0/1 side columns; mixed text and numbers meet as text."""
    require_same_columns(target, synthetic)
    kinds = {f.name: f.dataType.typeName() for f in synthetic.schema}
    mixed = [
        f.name
        for f in target.schema
        if (f.dataType.typeName() == "string") != (kinds[f.name] == "string")
    ]

    def side(df, is_target):
        df = df.withColumns({c: col(c).cast("string") for c in mixed}) if mixed else df
        return df.withColumns(
            {"__t": F.lit(is_target).cast("long"), "__s": F.lit(1 - is_target).cast("long")}
        )

    return side(target, 1).unionByName(side(synthetic, 0))


def _counts() -> list[Column]:
    return [F.sum("__t").alias("__n_target"), F.sum("__s").alias("__n_synth")]


def _direct_counts(stacked, combos):
    frames = []
    for batch, _, frame in grouping_set_counts(stacked, combos, _counts()):
        cell = F
        for i in batch:
            cell = cell.when(F.col("__set") == i, cell_name(combos[i]))
        frames.append(frame.select("__set", cell.alias("__cell"), "__n_target", "__n_synth"))
    return reduce(DataFrame.union, frames)


def _covered_counts(stacked, combos, sizes, max_cells):
    """Count wide sets on the data, then add their cells up to the combinations."""
    position = {combo: i for i, combo in enumerate(combos)}
    covers = cover(combos, sizes, max_cells)
    frames = []
    for batch, names, frame in grouping_set_counts(stacked, [c for c, _ in covers], _counts()):
        def held(j):
            return F.col("__bits").bitwiseAND(F.lit(1 << j).cast("long")) != 0

        # A member of a cover: its position and the set of its columns as bits.
        place = {c: j for j, c in enumerate(names)}
        members = F
        for i in batch:
            listed = ", ".join(
                f"struct({position[m]} AS __combo, {sum(1 << place[c] for c in m)}L AS __bits)"
                for m in covers[i][1]
            )
            members = members.when(F.col("__set") == i, F.expr(f"array({listed})"))
        rolled = frame.select("*", F.inline(members)).withColumns(
            {c: F.when(held(j), col(c)) for j, c in enumerate(names)}
        )
        summed = rolled.groupBy("__combo", "__bits", *map(col, names)).agg(
            F.sum("__n_target").alias("__n_target"), F.sum("__n_synth").alias("__n_synth")
        )
        # concat_ws skips nulls, so columns outside the combination leave no trace.
        cell = F.concat_ws("_", *[F.when(held(j), text(col(c))) for j, c in enumerate(names)])
        position_of = F.col("__combo").alias("__set")
        frames.append(
            summed.select(position_of, cell.alias("__cell"), "__n_target", "__n_synth")
        )
    return reduce(DataFrame.union, frames)


def _rows(df: DataFrame) -> Column:
    """The row count as a scalar subquery, which reads no columns of a stored table.

    Nulls are cells like any other, so every combination adds up to all the rows.
    """
    n = F.count(F.lit(1))
    empty = F.raise_error(F.lit("a table to compare is empty")).cast("bigint")
    return df.agg(F.when(n > 0, n).otherwise(empty).alias("n")).scalar()


def joint_probs(
    target: DataFrame,
    synthetic: DataFrame,
    orders: Sequence[int] = (2,),
    sizes: Mapping[str, int] | None = None,
    max_cells: int = 20_000,
) -> DataFrame:
    """Counts and shares of every observed cell of every column combination.

    One row per combination and cell seen in either table: ``order, combo, cell,
    n_target, n_synth, p, q``. Types are kept while grouping, so ``("a_b", "c")``
    and ``("a", "b_c")`` are two cells and nulls equal nulls.

    ``sizes`` (distinct values per column, as a profile or an encoding plan
    knows them) lets the rows be counted on fewer, wider column sets of up to
    ``max_cells`` cells, whose cells are then added up; worth it when the rows
    outnumber the cells by far. The tables are read once per batch of sets and
    once to count rows, so write a computed table before comparing it.
    """
    combos = column_combinations(target.columns, orders)
    stacked = _stack(target, synthetic)
    if sizes is None:
        counts = _direct_counts(stacked, combos)
    else:
        counts = _covered_counts(stacked, combos, sizes, max_cells)

    names = F.array(*[F.lit("_".join(c)) for c in combos])
    lengths = F.array(*[F.lit(len(c)) for c in combos])
    return counts.select(
        F.get(lengths, F.col("__set")).alias("order"),
        F.get(names, F.col("__set")).alias("combo"),
        F.col("__cell").alias("cell"),
        F.col("__n_target").alias("n_target"),
        F.col("__n_synth").alias("n_synth"),
        (F.col("__n_target") / _rows(target)).alias("p"),
        (F.col("__n_synth") / _rows(synthetic)).alias("q"),
    )


def absolute_error() -> Column:
    return F.abs(F.col("p") - F.col("q"))


def absolute_errors(probs: DataFrame) -> DataFrame:
    return probs.withColumn("abs_error", absolute_error())


def errors_by_combo(probs: DataFrame, epsilon: float = 1e-10) -> DataFrame:
    """``cells, mae, mnae, cross_entropy`` per combination, over the observed cells."""
    p, q = F.col("p"), F.col("q")
    return probs.groupBy("order", "combo").agg(
        F.count(F.lit(1)).alias("cells"),
        F.avg(absolute_error()).alias("mae"),
        F.avg(absolute_error() / (p + q)).alias("mnae"),
        (-F.sum(p * F.log(q + F.lit(epsilon)))).alias("cross_entropy"),
    )


def evaluate(
    target: DataFrame,
    synthetic: DataFrame,
    orders: Sequence[int] = (1, 2, 3),
    include: Sequence[str] | None = None,
    exclude: Sequence[str] = (),
    sizes: Mapping[str, int] | None = None,
    max_cells: int = 20_000,
) -> DataFrame:
    """Error measures of every combination at each order.

    Where there are more combinations than one pass counts, they are rolled up
    from wider column sets, for which the ``sizes`` of the columns are estimated
    in a first pass unless given.
    """
    require_same_columns(target, synthetic)
    names = [c for c in target.columns if (include is None or c in include) and c not in exclude]
    keep = [col(c) for c in names]
    target, synthetic = target.select(keep), synthetic.select(keep)
    if sizes is None and len(column_combinations(names, orders)) > SETS_PER_JOB:
        sizes = column_sizes(target, synthetic)
    return errors_by_combo(joint_probs(target, synthetic, orders, sizes, max_cells))


def mean_errors(errors: DataFrame) -> DataFrame:
    """Unweighted means over the combinations of each order."""
    return errors.groupBy("order").agg(
        F.count(F.lit(1)).alias("combos"),
        F.avg("mae").alias("mmae"),
        F.avg("mnae").alias("mean_mnae"),
        F.avg("cross_entropy").alias("mean_cross_entropy"),
    )


def mean_mean_absolute_error(target: DataFrame, synthetic: DataFrame, order: int = 1) -> float:
    """Mean over the combinations of one order of their mean absolute errors."""
    return mean_errors(evaluate(target, synthetic, [order])).first()["mmae"]


def rank_combos(errors: DataFrame, by: str = "mae") -> DataFrame:
    """Combinations from the best to the worst, with their ``rank`` from 1; as many rows as combinations."""
    place = F.row_number().over(Window.orderBy(by, "order", "combo"))
    return errors.withColumn("rank", place).orderBy("rank")


def worst_combos(errors: DataFrame, k: int = 1, by: str = "mae") -> DataFrame:
    return errors.orderBy(F.desc(by), "order", "combo").limit(k)


def compare_value_counts(target: DataFrame, synthetic: DataFrame, column: str) -> DataFrame:
    """Counts of each value in both tables side by side, 0 where absent."""
    pick = [col(column)]
    return (
        _stack(target.select(pick), synthetic.select(pick))
        .groupBy(col(column))
        .agg(*_counts())
        .withColumnsRenamed({"__n_target": "n_target", "__n_synth": "n_synth"})
    )


def unique_row_share(df: DataFrame) -> DataFrame:
    """Distinct rows, rows and their ratio."""
    grouped = frequencies(df, df.columns, "__n")
    return grouped.agg(
        F.count(F.lit(1)).alias("distinct_rows"),
        F.coalesce(F.sum("__n"), F.lit(0)).alias("rows"),
    ).withColumn("share", F.try_divide(F.col("distinct_rows"), F.col("rows")))

"""Numbers cut into bins of equal counts, so that their marginals can be compared."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.columns import col
from tallyweave.operators import density
from tallyweave.operators.profile import is_number, quantiles

#: Bins of a column; a bin below all of them and one above have numbers of their own.
BINS, BELOW = 10, -1


def fit_bins(df: DataFrame, columns: Sequence[str] | None = None, bins: int = BINS) -> dict[str, list[float]]:
    """Edges of about ``bins`` bins with equally many values each, for the numeric columns or those given.

    They are exact quantiles, found in two scans for all columns: the least value, inner edges, and the greatest. Values so
    frequent that edges coincide give fewer bins. A column without values has no edges.
    """
    names = [c for c, kind in df.dtypes if is_number(kind)] if columns is None else list(columns)
    found = quantiles(df, names, [i / bins for i in range(bins + 1)])
    return {name: sorted({x for x in edges if x is not None}) for name, edges in found.items()}


def bin_of(number: Column, edges: Sequence[float]) -> Column:
    """The bin of a number, from 0: values from an edge up to the next, the last one with its upper edge.

    ``BELOW`` is less than the least edge, and the number of bins is more than the greatest (or NaN); null stays null.
    """
    number = number.cast("double")
    if not edges:
        return F.when(number.isNotNull(), BELOW).cast("int")
    last = max(len(edges) - 2, 0)
    out = F.when(number.isNull(), None).when(number < F.lit(edges[0]), BELOW)
    for i, edge in enumerate(edges[1:-1]):
        out = out.when(number < F.lit(edge), i)
    return out.when(number <= F.lit(edges[-1]), last).otherwise(last + 1).cast("int")


def binned(df: DataFrame, edges: Mapping[str, Sequence[float]]) -> DataFrame:
    """The table with the bins of the columns in ``edges`` in place of their numbers."""
    return df.select([bin_of(col(c), edges[c]).alias(c) if c in edges else col(c) for c in df.columns])


def evaluate(
    target: DataFrame,
    synthetic: DataFrame,
    orders: Sequence[int] = (1, 2, 3),
    columns: Sequence[str] | None = None,
    bins: int = BINS,
) -> DataFrame:
    """As :func:`density.evaluate`, with numbers cut into the target's bins on both sides.

    A number column has at most ``bins`` + 3 cells however many rows there are: its bins, what lies below and above
    them, and null.
    """
    edges = fit_bins(target, columns, bins)
    return density.evaluate(binned(target, edges), binned(synthetic, edges), orders)

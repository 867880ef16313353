"""Tokens drawn by the shares of a row's group, by one join with a guide table.

The running sum of a group's shares cuts the numbers from 0 to 1 into one interval per token, and the guide table cuts them into
equal cells. Every cell has the few intervals that reach into it, about one and a half on average, so a draw
finds its interval by its group and cell, as an equality join. A row carries no array of shares, and a hot
group is spread over its cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions import draws
from tallyweave.functions.columns import col
from tallyweave.operators.lookups import BROADCAST_BYTES, BROADCAST_ROWS, row_bytes
from tallyweave.session import cut_lineage

#: Tokens whose shares are added up in one task.
CHUNK = 65_536


def guide(shares: DataFrame, by: Sequence[str], token: str = "token", share: str = "share") -> DataFrame:
    """``*by, cells, cell, token, low, high, total``: the intervals that reach into each cell of a group.

    ``shares`` has one row per group and token; they need not add up to one, and tokens without a share
    are never drawn. A group has as many cells as tokens. Running sums go by chunks of tokens, so no task adds up more
    than ``CHUNK`` of them.
    """
    group = [col(c) for c in by]
    rows = shares.select(*group, col(token).cast("int").alias("token"), col(share).cast("double").alias("__share"))
    rows = rows.where("__share > 0").withColumn("__chunk", F.floor(F.col("token") / CHUNK))
    sums = rows.groupBy(*group, "__chunk").agg(F.sum("__share").alias("__sum"), F.count(F.lit(1)).alias("__n"))
    every = Window.partitionBy(*group)
    before = every.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        *[col(c).alias(f"__by_{c}") for c in by],
        F.col("__chunk").alias("__of"),
        F.coalesce(F.sum("__sum").over(before), F.lit(0.0)).alias("__begin"),
        F.sum("__sum").over(every).alias("total"),
        F.sum("__n").over(every).alias("cells"),
    )
    same = F.col("__chunk") == F.col("__of")
    for c in by:
        same = same & col(c).eqNullSafe(col(f"__by_{c}"))
    placed = rows.join(sums, same).withColumn(
        "high", F.col("__begin") + F.sum("__share").over(Window.partitionBy(*group, "__chunk").orderBy("token"))
    )
    # The next interval begins where this one ends, also across chunks.
    order = Window.partitionBy(*group, "__chunk").orderBy("token")
    placed = placed.withColumn("low", F.coalesce(F.lag("high").over(order), F.col("__begin")))
    last = F.col("cells") - 1
    first, until = (F.floor(F.col(c) / F.col("total") * F.col("cells")) for c in ("low", "high"))
    # A cell more on both sides, as far as rounding may move an end; the ends themselves decide.
    reach = F.sequence(F.greatest(first - 1, F.lit(0)), F.least(until + 1, last))
    return placed.select(*group, "cells", F.explode(reach).alias("cell"), "token", "low", "high", "total")


def draw(
    df: DataFrame,
    shares: DataFrame,
    by: Sequence[str],
    seed: int,
    key: Sequence[str],
    name: str,
    token: str = "token",
    share: str = "share",
) -> DataFrame:
    """Add ``name``, a token drawn for each row by the shares of its group.

    The draw is fixed by the seed, ``name`` and the row's key. Null groups equal each other, and a group without shares
    draws null. The guide table is broadcast if a pass over it shows that it is small.
    """
    table = guide(shares, by, token, share).withColumnsRenamed({c: f"__by_{c}" for c in by})
    table = cut_lineage(table.withColumnsRenamed({c: f"__{c}" for c in ("cells", "cell", "token", "low", "high", "total")}))
    sizes = table.agg(F.count(F.lit(1)), F.sum(row_bytes(table))).first()
    small = sizes[0] <= BROADCAST_ROWS and (sizes[1] or 0) <= BROADCAST_BYTES
    groups = table.groupBy(*[f"__by_{c}" for c in by]).agg(F.max("__cells").alias("__of"))
    groups = groups.withColumnsRenamed({f"__by_{c}": f"__group_{c}" for c in by})

    def same(prefix):
        out = F.lit(True)
        for c in by:
            out = out & col(c).eqNullSafe(col(f"__{prefix}_{c}"))
        return out

    u = draws.uniform(seed, F.lit(name), *map(col, key))
    sized = df.withColumn("__u", u).join(F.broadcast(groups) if small else groups, same("group"), "left")
    celled = sized.withColumn("__cell_of", F.least(F.floor(F.col("__u") * F.col("__of")), F.col("__of") - 1))
    limit = F.col("__u") * F.col("__total")
    # The first interval has no lower end and the last no upper one, where rounding may go beyond.
    inside = ((limit >= F.col("__low")) | (F.col("__low") <= 0)) & (
        (limit < F.col("__high")) | (F.col("__high") >= F.col("__total"))
    )
    found = same("by") & (F.col("__cell") == F.col("__cell_of")) & inside
    joined = celled.join(F.broadcast(table) if small else table, found, "left")
    return joined.select(*map(col, df.columns), F.col("__token").alias(name))

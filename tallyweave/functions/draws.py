"""Repeatable random numbers, computed from a seed and a row key.

A draw depends on nothing but its key, so it survives repartitioning, retries
and lost executors, and any SQL engine with md5 can recompute it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digest(seed: int, keys: tuple[Column, ...]) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[key.cast("string") for key in keys]))


def _unit(digest: Column, start: int) -> Column:
    """Eight hex digits from ``start`` as a number in [0, 1)."""
    return F.conv(F.substring(digest, start, 8), 16, 10).cast("double") / F.lit(2.0**32)


def uniform(seed: int, *keys: Column) -> Column:
    """Uniform in [0, 1), the same for the same seed and keys everywhere."""
    return _unit(_digest(seed, keys), 1)


def normal(seed: int, *keys: Column) -> Column:
    """Standard normal by Box-Muller; ``1 - u`` keeps the logarithm finite."""
    digest = _digest(seed, keys)
    radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - _unit(digest, 1)))
    return radius * F.cos(F.lit(2.0) * F.pi() * _unit(digest, 9))


def normals(size: int, seed: int, *keys: Column) -> Column:
    """``array<double>`` of ``size`` independent standard normals for a row."""
    return F.array(*[normal(seed, *keys, F.lit(dim)) for dim in range(size)])

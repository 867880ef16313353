"""Ranked trials over settings: repeatable draws, a stored table, the best of it."""

from __future__ import annotations

import hashlib
import json
import math
import time
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions import draws
from tallyweave.functions.columns import col
from tallyweave.operators import density
from tallyweave.session import names_below, put_if_absent

TRIALS_SCHEMA = (
    "trial bigint, objective double, seconds double, settings map<string, string>, study string"
)


@dataclass(frozen=True)
class IntRange:
    """Whole numbers from ``low`` to ``high``, both included."""

    low: int
    high: int
    step: int = 1

    def values(self) -> list[int]:
        return list(range(self.low, self.high + 1, self.step))

    def pick(self, u: Column) -> Column:
        n = len(self.values())
        return (F.lit(self.low) + F.floor(u * n) * self.step).cast("int")


@dataclass(frozen=True)
class FloatRange:
    """Numbers from ``low`` to ``high``: in steps, or anywhere, evenly or by logarithm."""

    low: float
    high: float
    step: float | None = None
    log: bool = False

    def __post_init__(self):
        if self.log and (self.step is not None or self.low <= 0):
            raise ValueError("a logarithmic range starts above 0 and has no step")

    def values(self) -> list[float]:
        if self.step is None:
            raise ValueError("a range without a step has no grid")
        n = int(math.floor((self.high - self.low) / self.step + 1e-9)) + 1
        return [round(self.low + i * self.step, 12) for i in range(n)]

    def pick(self, u: Column) -> Column:
        if self.step is not None:
            return F.round(F.lit(self.low) + F.floor(u * len(self.values())) * self.step, 12)
        if self.log:
            low, high = math.log(self.low), math.log(self.high)
            return F.exp(F.lit(low) + u * (high - low))
        return F.lit(float(self.low)) + u * (self.high - self.low)


@dataclass(frozen=True)
class Choice:
    """One of several values of a type."""

    options: Sequence

    def values(self) -> list:
        return list(self.options)

    def pick(self, u: Column) -> Column:
        n = len(self.options)
        return F.get(F.array(*map(F.lit, self.options)), F.floor(u * n).cast("int"))


RANGES = (IntRange, FloatRange, Choice)


def ranges(tree: Mapping, path: str = "") -> dict[str, IntRange | FloatRange | Choice]:
    """The ranges among the leaves of a settings tree, by full path."""
    found = {}
    for name, value in tree.items():
        if isinstance(value, Mapping):
            found.update(ranges(value, f"{path}{name}."))
        elif isinstance(value, RANGES):
            found[path + name] = value
    return found


def draw_trials(
    spark: SparkSession, tree: Mapping, n: int, seed: int, grid: bool = False
) -> DataFrame:
    """``trial`` and one column per range, named by its path.

    Random draws are fixed by seed, trial and path, so more trials extend the
    fewer. ``grid`` walks all combinations instead, at most ``n`` of them.
    """
    found = ranges(tree)
    trial = F.col("id")
    if not grid:
        picks = [
            space.pick(draws.uniform(seed, trial, F.lit(path))).alias(path)
            for path, space in found.items()
        ]
        return spark.range(n).select(trial.alias("trial"), *picks)
    picks, stride = [], 1
    for path, space in found.items():
        values = space.values()
        place = F.floor(trial / stride) % len(values)
        picks.append(F.get(F.array(*map(F.lit, values)), place.cast("int")).alias(path))
        stride *= len(values)
    return spark.range(min(n, stride)).select(trial.alias("trial"), *picks)


def resolve(tree: Mapping, drawn: Mapping, path: str = "") -> dict:
    """The settings tree with every range replaced by what a trial drew for it."""
    out = {}
    for name, value in tree.items():
        if isinstance(value, Mapping):
            out[name] = resolve(value, drawn, f"{path}{name}.")
        else:
            out[name] = drawn[path + name] if isinstance(value, RANGES) else value
    return out


def objective(target: DataFrame, synthetic: DataFrame) -> float:
    """Mean over orders 1 and 2 of their mean mean absolute errors, in one evaluation.

    A single column has order 1 only.
    """
    orders = [1, 2][: len(target.columns)]
    means = density.mean_errors(density.evaluate(target, synthetic, orders))
    return means.agg(F.avg("mmae")).first()[0]


def run_trials(
    spark: SparkSession,
    tree: Mapping,
    score: Callable[[dict, int], float],
    path: str,
    trials: int = 20,
    timeout: float | None = None,
    seed: int = 0,
    grid: bool = False,
    workers: int = 1,
) -> DataFrame:
    """Score the trials and store each below ``path`` as it ends; resumes with those that are missing.

    ``score(settings, trial)`` runs the distributed work of one trial. With several ``workers`` so many trials run at
    once, each in a scheduler pool of its own, which a session in FAIR mode gives equal shares; what a trial draws and
    scores does not depend on that. The result is in order of trials. A table that holds trials of
    another tree or seed is refused. With a ``timeout`` in seconds no trial starts after it; the trials that
    were asked for and did not run are in the result without an objective, and run when it is resumed.
    """
    started = time.monotonic()
    study = study_of(tree, seed, grid)
    known = read_trials(spark, path).select("trial", "study").collect()
    if any(r["study"] != study for r in known):
        raise ValueError(f"{path} holds trials of another tree or seed; give each study its own path")
    done = {r["trial"] for r in known}
    # As many rows as trials were asked for.
    asked = [row.asDict() for row in draw_trials(spark, tree, trials, seed, grid).orderBy("trial").collect()]
    todo = [(drawn.pop("trial"), drawn) for drawn in asked if drawn["trial"] not in done]

    def run(trial: int, drawn: dict) -> tuple | None:
        """The row of a trial that did not start, else None."""
        if timeout is not None and time.monotonic() - started > timeout:
            return _trial_row(trial, None, None, drawn, study)
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"trial-{trial % workers}" if workers > 1 else None)
        began = time.monotonic()
        value = score(resolve(tree, drawn), trial)
        put_trial(spark, path, _trial_row(trial, value, time.monotonic() - began, drawn, study))
        return None

    if workers == 1:
        missing = [run(*each) for each in todo]
    else:
        # A thread has its own jobs and properties in the JVM; those of this thread are handed on.
        with ThreadPoolExecutor(workers) as pool:
            running = [pool.submit(inheritable_thread_target(spark)(run), *each) for each in todo]
            try:
                missing = [each.result() for each in running]
            except BaseException:
                pool.shutdown(cancel_futures=True)
                raise
    missing = [row for row in missing if row]
    stored = read_trials(spark, path)
    if missing:
        stored = stored.unionByName(spark.createDataFrame(missing, TRIALS_SCHEMA))
    return stored.orderBy("trial")


def study_of(tree: Mapping, seed: int, grid: bool = False) -> str:
    """A digest of all that decides which settings a trial has."""
    spec = json.dumps([tree, seed, grid], sort_keys=True, default=repr)
    return hashlib.md5(spec.encode()).hexdigest()


def _trial_row(trial, value, seconds, drawn, study) -> tuple:
    value = None if value is None else float(value)
    return (trial, value, seconds, {k: str(v) for k, v in drawn.items()}, study)


def put_trial(spark: SparkSession, path: str, row: tuple) -> bool:
    """Store a trial in a folder of its own, which appears at once; False if another writer has stored it already."""
    trial, kept = row[0], spark.createDataFrame([row], TRIALS_SCHEMA).drop("trial").coalesce(1)
    return put_if_absent(spark, f"{path.rstrip('/')}/trial={trial}", kept.write.parquet)


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    """The stored trials, none if there is no table yet."""
    none = spark.createDataFrame([], TRIALS_SCHEMA)
    if not any(name.startswith("trial=") for name in names_below(spark, path)):
        return none
    return spark.read.schema(TRIALS_SCHEMA).parquet(path).select(none.columns)


def best_trials(trials: DataFrame, k: int = 1) -> DataFrame:
    """The trials of the smallest objective, the earliest first on ties."""
    return trials.orderBy(col("objective").asc_nulls_last(), "trial").limit(k)

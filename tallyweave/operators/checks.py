"""Checks of a table by the job that uses it, instead of jobs of their own.

The counts are metrics that Spark observes while the rows pass. A row counts once in a job without a
shuffle behind the check; where a lost executor makes Spark run tasks again before a shuffle, a count may be too high, but
never above zero without an offending row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tallyweave.functions.columns import col
from tallyweave.operators import encode as coding
from tallyweave.operators.encode import EncodingPlan
from tallyweave.operators.profile import is_number

SCHEMA = "check string, column string, rows bigint"


@dataclass
class _Counts:
    """Metrics of rows that pass, and what they mean."""

    #: (check, column, offending rows), as expressions or, with ``alias``, as one of the metrics.
    metrics: dict[str, Column] = field(default_factory=dict)
    entries: list[tuple[str, str, str]] = field(default_factory=list)

    def add(self, check: str, column: str, offending: Column) -> None:
        """Count the rows for which ``offending`` is true."""
        self.put(check, column, F.count_if(offending))

    def put(self, check: str, column: str, metric: Column) -> None:
        name = f"m{len(self.metrics)}"
        self.metrics[name] = metric.alias(name)
        self.entries.append((check, column, name))


@dataclass
class Report:
    """The counts of a job that has run, or of one that will: reading them waits for it."""

    observations: list[tuple[Observation, _Counts]]

    def rows(self) -> list[tuple[str, str, int]]:
        return [
            (check, column, int(seen.get[name] or 0))
            for seen, counts in self.observations
            for check, column, name in counts.entries
        ]

    def require(self) -> None:
        """Fail where any check has an offending row, naming them all."""
        wrong = [f"{check}: {column} ({rows} rows)" for check, column, rows in self.rows() if rows]
        if wrong:
            raise ValueError(f"the table does not pass its checks; {'; '.join(wrong)}")


def _observed(df: DataFrame, counts: _Counts, seen: list) -> DataFrame:
    if not counts.metrics:
        return df
    observation = Observation()
    seen.append((observation, counts))
    return df.observe(observation, *counts.metrics.values())


def _no_number(df: DataFrame, name: str) -> Column:
    """Whether a value is there and no number."""
    kind = dict(df.dtypes)[name]
    if is_number(kind):
        return F.lit(False)
    number = col(name).try_cast("double") if kind == "string" else F.lit(None).cast("double")
    return col(name).isNotNull() & number.isNull()


def encode_checked(
    df: DataFrame,
    plan: EncodingPlan,
    keep: Sequence[str] = (),
    numeric: Sequence[str] = (),
    like: Sequence[str] | None = None,
    prefix: str = "",
) -> tuple[DataFrame, Report]:
    """Encode the columns of the plan that the table has, and count what is wrong with it on the way.

    The report has a line for every check and column, with the rows that offend:

    - ``missing column``: all rows, for a column of the plan that the table does not have
    - ``different columns``: all rows, for a column that only one of the table and ``like`` has
    - ``not a number``: values of ``numeric`` columns
    - ``identifier``: all rows, where the plan has as many words as the table has rows
    - ``no range``: all values of a number column, if they are the same
    - ``outside the range``: values that the plan scales to below 0 or above 1
    - ``unseen value``: those that are not in the vocabulary, which get the token -1

    The counts are there when an action on the encoded rows has ended.
    """
    before, after, seen = _Counts(), _Counts(), []
    every = F.count(F.lit(1))
    missing = [c.name for c in plan.columns if c.name not in df.columns]
    for name in missing:
        before.put("missing column", name, every)
    for name in sorted(set(df.columns) ^ set(df.columns if like is None else like)):
        before.put("different columns", name, every)
    for name in numeric:
        before.add("not a number", name, _no_number(df, name))
    present = plan.only([c.name for c in plan.columns if c.name not in missing])
    for c in present.columns:
        if c.kind == "categorical":
            before.put("identifier", c.name, F.when(every == c.size, every).otherwise(0))
            after.add("unseen value", c.name, col(prefix + c.name) == -1)
            continue
        number = col(c.name).cast("double")
        same = F.min(number) == F.max(number)
        before.put("no range", c.name, F.when(same, F.count(number)).otherwise(0))
        if c.kind == "continuous":
            after.add("outside the range", c.name, ~col(prefix + c.name).between(0, 1))
    checked = _observed(df, before, seen)
    encoded = coding.encode(checked, present, keep, unseen="code", prefix=prefix)
    return _observed(encoded, after, seen), Report(seen)


def decode_checked(
    df: DataFrame, plan: EncodingPlan, keep: Sequence[str] = (), prefix: str = ""
) -> tuple[DataFrame, Report]:
    """Decode with null for tokens outside the vocabulary, which the report counts as ``unseen token``."""
    counts, seen, known = _Counts(), [], {}
    for c in plan.columns:
        if c.kind == "categorical":
            token = col(prefix + c.name)
            unknown = token.isNull() | (token < 0) | (token >= c.size)
            counts.add("unseen token", c.name, unknown)
            known[c.name] = unknown
    checked = _observed(df, counts, seen)
    # An unknown token is decoded as the first one, and its value taken away.
    marked = checked.withColumns({f"__unknown_{n}": u for n, u in known.items()})
    marked = marked.withColumns({prefix + n: F.when(u, 0).otherwise(col(prefix + n)) for n, u in known.items()})
    rows = coding.decode(marked, plan, [*keep, *[f"__unknown_{n}" for n in known]], prefix)
    values = [F.when(~col(f"__unknown_{n}"), col(n)).alias(n) if n in known else col(n) for n in plan.names()]
    return rows.select(*map(col, keep), *values), Report(seen)

"""Epochs of a fit as tables in a durable folder, so that a new driver goes on where another ended.

Every epoch has a folder of its own: the parameters, both moments and the best parameters so far as one table, and
the facts as one line, all of which appear at once. The folder before it stays until the next epoch is there.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, fields

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions.columns import col
from tallyweave.session import delete, names_below, put_if_absent

VECTORS = ("vector", "moment", "square", "best")


@dataclass
class State:
    """What the next epoch depends on; ``history`` has a dictionary for each epoch."""

    epoch: int
    step: int
    rate: float
    best_loss: float
    best_epoch: int
    history: list
    vector: np.ndarray
    moment: np.ndarray
    square: np.ndarray
    best: np.ndarray


def study_of(settings, shape, key: Sequence[str], seed: int, start: np.ndarray, encoded: DataFrame) -> str:
    """A digest of all that decides the epochs: settings, rows, key, seed and first parameters.

    The number of epochs is left out, so that a fit can be resumed with more. Rows count by an order-free checksum.
    """
    rows = F.xxhash64(*[col(c) for c in sorted(encoded.columns)]).cast("decimal(38,0)")
    facts = encoded.agg(F.count(F.lit(1)), F.sum(rows)).first()
    kept = {k: v for k, v in asdict(settings).items() if k not in ("max_epochs", "min_epochs", "patience")}
    spec = [kept, shape.features, shape.controls, list(key), seed, [str(x) for x in facts]]
    return hashlib.md5(json.dumps(spec, sort_keys=True).encode() + start.tobytes()).hexdigest()


class Progress:
    """The epochs below ``path``; those of another study are refused."""

    def __init__(self, spark: SparkSession, path: str, study: str):
        self.spark, self.path, self.study = spark, path.rstrip("/"), study

    def _epochs(self) -> list[int]:
        return sorted(int(n[6:]) for n in names_below(self.spark, self.path) if n.startswith("epoch="))

    def last(self) -> State | None:
        """The latest epoch, or None."""
        found = self._epochs()
        if not found:
            return None
        folder = f"{self.path}/epoch={found[-1]}"
        facts = json.loads(self.spark.read.text(f"{folder}/facts").first()["value"])
        if facts.pop("study") != self.study:
            raise ValueError(f"{self.path} holds epochs of other rows, settings or seed; give each fit its own folder")
        # A row for each parameter.
        table = self.spark.read.parquet(f"{folder}/parameters").orderBy("at").toPandas()
        return State(**facts, **{name: table[name].to_numpy() for name in VECTORS})

    def commit(self, state: State) -> bool:
        """Store an epoch; False if another driver has stored it already."""

        def write(folder: str) -> None:
            table = pd.DataFrame({"at": np.arange(len(state.vector)), **{n: getattr(state, n) for n in VECTORS}})
            kinds = ", ".join(f"{n} double" for n in VECTORS)
            self.spark.createDataFrame(table, f"at long, {kinds}").write.parquet(f"{folder}/parameters")
            facts = {f.name: getattr(state, f.name) for f in fields(State) if f.name not in VECTORS}
            line = json.dumps({**facts, "study": self.study})
            self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.text(f"{folder}/facts")

        stored = put_if_absent(self.spark, f"{self.path}/epoch={state.epoch}", write)
        for old in self._epochs():
            if old < state.epoch - 1:
                delete(self.spark, f"{self.path}/epoch={old}")
        return stored

"""Keeping a fitted model as a few small tables, to generate from it later."""

from __future__ import annotations

import json
from dataclasses import asdict, replace

import pandas as pd
from pyspark.sql import SparkSession

from tallyweave.operators.encode import ColumnPlan, EncodingPlan
from tallyweave.plans.model import Model, Settings, build
from tallyweave.session import cut_lineage


def save_model(spark: SparkSession, model: Model, path: str) -> None:
    """Write parameters, vocabulary and settings below ``path``."""
    spec = {
        "settings": asdict(model.settings),
        "features": [asdict(c) for c in model.features.columns],
        "controls": [asdict(c) for c in model.controls.columns] if model.controls else None,
    }
    parameters = pd.DataFrame({"at": range(len(model.vector)), "w": model.vector})
    spark.createDataFrame(parameters, "at int, w double").coalesce(1).write.mode(
        "overwrite"
    ).parquet(f"{path}/parameters")
    vocabulary = model.features.vocabulary
    if model.controls and model.controls.vocabulary is not vocabulary:
        vocabulary = vocabulary.union(model.controls.vocabulary).distinct()
    # Written elsewhere first, since the model may have been loaded from this path.
    cut_lineage(vocabulary).write.mode("overwrite").parquet(f"{path}/vocabulary")
    spark.createDataFrame([(json.dumps(spec),)], "value string").coalesce(1).write.mode(
        "overwrite"
    ).text(f"{path}/spec")


def load_model(spark: SparkSession, path: str) -> Model:
    """The model that :func:`save_model` wrote."""
    spec = json.loads(spark.read.text(f"{path}/spec").first()["value"])
    vocabulary = spark.read.parquet(f"{path}/vocabulary")

    def plan(columns):
        if columns is None:
            return None
        return EncodingPlan(tuple(ColumnPlan(**c) for c in columns), vocabulary)

    empty = build(plan(spec["features"]), plan(spec["controls"]), Settings(**spec["settings"]), 0)
    # As many rows as the model has parameters.
    parameters = spark.read.parquet(f"{path}/parameters").orderBy("at").toPandas()
    return replace(empty, vector=parameters["w"].to_numpy())

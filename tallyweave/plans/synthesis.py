"""A whole run: read or take a table, encode, fit, score, generate, write."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tallyweave.functions.columns import col
from tallyweave.operators import density, encode, sample, tables
from tallyweave.plans import model as modelling
from tallyweave.plans import stored
from tallyweave.plans import trials as trialling
from tallyweave.session import delete, scratch
from tallyweave.sources import files


@dataclass(frozen=True)
class Prepared:
    """A table with its encodings and its encoded, split rows."""

    data: DataFrame
    key: tuple[str, ...]
    features: encode.EncodingPlan
    controls: encode.EncodingPlan | None
    encoded: DataFrame


def prepare(
    df: DataFrame,
    controls: Sequence[str],
    key: Sequence[str],
    seed: int,
    columns: Mapping[str, str] | None = None,
    val: float = 0.1,
    test: float | None = None,
) -> Prepared:
    """Rename, split into controls and features, fit both encodings and split the rows.

    ``key`` names the columns that identify a row; they are never encoded.
    """
    df = tables.rename_select(df, columns)
    ys, xs = tables.split_columns(df, controls)
    xs = tables.encodable_columns(xs, exclude=key)
    # Fitted together, so that the table is read once for both.
    plan = encode.fit(df, include=[*xs, *ys], exclude=key)
    features, plans = plan.only(xs), plan.only(ys) if ys else None
    parts = sample.split(df, key, seed, val, test)
    encoded = modelling.encode_rows(parts, features, plans, [*key, "split"])
    return Prepared(df, tuple(key), features, plans, encoded)


def train(
    prepared: Prepared, settings: modelling.Settings, seed: int, state: str | None = None
) -> tuple[modelling.Model, list[dict]]:
    """The fitted model and its epochs; those stored below ``state`` are not run again."""
    untrained = modelling.build(prepared.features, prepared.controls, settings, seed)
    return modelling.fit(prepared.encoded, untrained, prepared.key, seed, state)


def run(
    prepared: Prepared,
    settings: modelling.Settings,
    seed: int,
    out: str | None = None,
    orders: Sequence[int] = (1, 2, 3),
    sample_tokens: bool = False,
    fitted: modelling.Model | None = None,
) -> dict[str, DataFrame]:
    """Fit, then ``losses`` by split, ``synthetic`` rows and their ``errors``.

    With ``out`` the epochs, so that a run that was ended can be started again, the model, losses, synthetic rows and latents are written below
    it, and the errors are those of the written rows. A ``fitted`` model is taken
    as it is.
    """
    model = fitted or train(prepared, settings, seed, out and f"{out}/epochs")[0]
    key = list(prepared.key)
    losses = modelling.split_losses(prepared.encoded, model, key, seed)
    made = modelling.generate(prepared.data, model, key, seed, sample_tokens, keep_latents=True)
    synthetic = made.drop("z")
    if out is not None:
        spark: SparkSession = prepared.data.sparkSession
        stored.save_model(spark, model, f"{out}/model")
        delete(spark, f"{out}/epochs")
        files.write_losses(losses, f"{out}/losses")
        made.write.mode("overwrite").parquet(f"{out}/made")
        made = spark.read.parquet(f"{out}/made")
        synthetic = made.drop("z")
        files.write_csv(synthetic, f"{out}/synthetic")
        files.write_latents(made, f"{out}/latents", model.shape.latent_size)
    errors = compare(prepared, synthetic, orders)
    return {"losses": losses, "synthetic": synthetic, "errors": errors}


def compare(prepared: Prepared, synthetic: DataFrame, orders: Sequence[int]) -> DataFrame:
    """Errors of the synthetic controls and features against the real ones.

    Numbers are left out: almost every value is a cell of its own. Cut them into bins before, to compare them.
    """
    plans = [prepared.features] + ([prepared.controls] if prepared.controls else [])
    encoded = {c.name for plan in plans for c in plan.columns if c.kind == "categorical"}
    names = [n for n in prepared.data.columns if n in encoded]
    sizes = {n: s for plan in plans for n, s in plan.sizes().items() if n in encoded}
    return density.evaluate(
        prepared.data.select(*map(col, names)),
        synthetic.select(*map(col, names)),
        [k for k in orders if k <= len(names)],
        # The plan knows how many cells a combination can have.
        sizes=sizes,
    )


def tune(
    prepared: Prepared,
    tree: Mapping,
    path: str,
    trials: int = 20,
    timeout: float | None = None,
    seed: int = 0,
    grid: bool = False,
    workers: int = 1,
) -> DataFrame:
    """Fit and score one model per trial; ``tree`` holds model settings, some of them ranges.

    The objective compares the categorical features only, at orders 1 and 2. So many trials as ``workers`` run at once.
    """
    names = [c.name for c in prepared.features.columns if c.kind == "categorical"]
    target = prepared.data.select(*map(col, names))

    def score(settings: dict, trial: int) -> float:
        model, _ = train(prepared, modelling.Settings(**settings), seed)
        made = modelling.generate(prepared.data, model, prepared.key, seed)
        # Written once, since the comparison reads it more than once.
        folder = scratch(made.sparkSession, f"trial-{trial}")
        made.select(*map(col, names)).write.parquet(folder)
        return trialling.objective(target, target.sparkSession.read.parquet(folder))

    spark = prepared.data.sparkSession
    return trialling.run_trials(spark, tree, score, path, trials, timeout, seed, grid, workers)

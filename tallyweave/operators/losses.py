"""Losses of a conditional model, from columns of probabilities and latents.

A categorical column costs its weighted negative log likelihood, a continuous
one its squared error. Each is averaged over all rows of a split, not over
batches, and the columns are averaged without weights.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import arrays
from tallyweave.functions.columns import col


def token_loss(token: Column, probs: Column) -> Column:
    """Negative log likelihood of the observed token."""
    return arrays.negative_log(F.get(probs, token.cast("int")))


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.sum(weight)


def mean_kl(mu: Column, log_var: Column) -> Column:
    return F.avg(arrays.kl_to_standard_normal(mu, log_var))


def total_loss(recon: Column, kld: Column, beta: float) -> tuple[Column, Column, Column]:
    """``(loss, recon part, kl part)``: reconstruction weighs ``1 - beta``, the rest ``beta``."""
    require_beta(beta)
    recon_part = F.lit(1.0 - beta) * recon
    kld_part = F.lit(float(beta)) * kld
    return recon_part + kld_part, recon_part, kld_part


def require_beta(beta: float) -> None:
    if not 0 <= beta < 1:
        raise ValueError("beta must be at least 0 and below 1, or reconstruction counts for nothing")


def _literal(numbers: Sequence[float]) -> Column:
    """An array as one text in the plan, instead of an expression for every number."""
    return F.from_json(F.lit(json.dumps([float(n) for n in numbers])), "array<double>")


def losses(
    df: DataFrame,
    kinds: Mapping[str, str],
    beta: float,
    weights: Mapping[str, Sequence[float] | None] | None = None,
    by: Sequence[str] = (),
    prefix: str = "p_",
    mu: str = "mu",
    log_var: str = "log_var",
) -> DataFrame:
    """``loss, recon, kld`` and ``recon_<column>``, one row per group of ``by``.

    ``df`` holds for each column of ``kinds`` its encoded value and under
    ``prefix`` its probability array, or its predicted value if continuous.
    """
    parts = {}
    for name, kind in kinds.items():
        if kind == "categorical":
            known = (weights or {}).get(name)
            token = col(name).cast("int")
            # One literal with a weight per category, no longer than the probabilities are.
            weight = F.lit(1.0) if known is None else F.get(_literal(known), token)
            parts[name] = weighted_mean(token_loss(token, col(prefix + name)), weight)
        elif kind == "continuous":
            difference = col(prefix + name) - col(name)
            parts[name] = F.avg(difference * difference)
        else:
            raise ValueError(f"unknown kind {kind!r} for column {name!r}")
    recon = sum(parts.values(), F.lit(0.0)) / F.lit(float(len(parts)))
    loss, recon_part, kld_part = total_loss(recon, mean_kl(col(mu), col(log_var)), beta)
    return df.groupBy(*map(col, by)).agg(
        F.count(F.lit(1)).alias("n"),
        loss.alias("loss"),
        recon_part.alias("recon"),
        kld_part.alias("kld"),
        *[part.alias("recon_" + name) for name, part in parts.items()],
    )

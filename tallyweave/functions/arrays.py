"""Expressions over per-row probability and latent arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def most_likely(probs: Column) -> Column:
    """Token of the largest probability, the first one on ties."""
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def sampled(probs: Column, u: Column) -> Column:
    """Token drawn by inverse CDF from ``u`` in [0, 1); ``probs`` need not sum to one."""
    total = F.aggregate(probs, F.lit(0.0), lambda acc, p: acc + p)
    # The limit is carried along, since a lambda would compute it for every element.
    start = F.struct(F.lit(0.0).alias("run"), F.lit(0).alias("below"), (u * total).alias("limit"))

    def step(acc, p):
        run = acc["run"] + p
        below = acc["below"] + F.when(run <= acc["limit"], 1).otherwise(0)
        return F.struct(run.alias("run"), below.alias("below"), acc["limit"].alias("limit"))

    return F.least(F.aggregate(probs, start, step)["below"], F.size(probs) - 1)


def kl_to_standard_normal(mu: Column, log_var: Column) -> Column:
    """KL divergence of N(mu, exp(log_var)) from the standard normal, summed over dimensions."""
    terms = F.zip_with(mu, log_var, lambda m, lv: F.lit(1.0) + lv - m * m - F.exp(lv))
    return F.lit(-0.5) * F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)


def reparameterise(mu: Column, log_var: Column, eps: Column) -> Column:
    """``mu + exp(log_var / 2) * eps`` element by element."""
    noise = F.zip_with(log_var, eps, lambda lv, e: F.exp(lv / 2.0) * e)
    return F.zip_with(mu, noise, lambda m, n: m + n)


def negative_log(prob: Column) -> Column:
    """``-ln p``, finite for an underflowed probability (Spark's ln of 0 is null)."""
    return -F.log(F.greatest(prob, F.lit(2.2250738585072014e-308)))

"""Operators for training-data pipelines, and their queries."""

from tallyweave.llm import (  # noqa: F401
    bitplanes,
    chat,
    decontaminate,
    licenses,
    mixing,
    quality,
    runs,
    scoring,
    sharding,
    simhash,
    substrings,
    tokens,
    toxicity,
)
from tallyweave.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

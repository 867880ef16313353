"""Registered queries over the given tables, each with a SQL oracle where one exists."""

from tallyweave.queries import density, encoding, model, recode, sampling, sources  # noqa: F401
from tallyweave.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

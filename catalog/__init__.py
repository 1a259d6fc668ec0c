"""Registered queries over the driver's tables, each with its SQL twin where SQL can say it."""

from catalog import commands, corpus, evaluation, retrieval, sources, tokens, vectors  # noqa: F401
from catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

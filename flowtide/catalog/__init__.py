"""Registered queries and, where SQL can express them, the SQL they are checked against."""

from flowtide.catalog.registry import ORACLES, QUERIES
from flowtide.catalog import behavior, evaluation, explore, inputs, models, networks, rows, sampling, streams  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]

"""Registered queries, each with the SQL text that must give the same rows."""

from harrow.catalog import aggregates, declared, files, joins, learning, quality, rows, scalars, splits, stations  # noqa: F401
from harrow.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

"""Queries over the driver's tables, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from turnwise.queries import added, bookkeeping, grammatical, matching, more, rules, runs, text, times
from turnwise.queries.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "added", "bookkeeping", "grammatical", "matching", "more", "rules", "runs", "text", "times"]

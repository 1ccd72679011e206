"""Registered queries of the library's own operators, and their SQL.

Each query runs an operator over a given table bound as transcripts (``views``); the SQL computes the same rows
from the tables directly.
"""

from __future__ import annotations

from collections.abc import Callable

from . import detail_queries, ingest_queries, message_queries, source_queries

_PARTS = (message_queries, ingest_queries, detail_queries, source_queries)


def queries() -> dict[str, Callable]:
    return {name: f for part in _PARTS for name, (f, _) in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, (_, sql) in part.QUERIES.items() if sql}

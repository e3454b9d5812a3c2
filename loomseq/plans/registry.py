"""Registered queries, one for each operator of the inventory, with SQL where SQL can say it."""

from __future__ import annotations

from . import queries_files, queries_intervals, queries_sequences, queries_tables
from .views import with_views

FLAGSHIP = "coverage_over_intervals"
PARTS = (queries_sequences, queries_files, queries_intervals, queries_tables)


def queries() -> dict:
    return {name: q for part in PARTS for name, q in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for part in PARTS for name, sql in part.SQL.items()}

"""All queries outside the llm subpackage, and their SQL."""

from __future__ import annotations

from barlight.plans import general, io_queries, series_queries, text_queries

_PARTS = [general, series_queries, text_queries, io_queries]
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
SQL = {name: sql for part in _PARTS for name, sql in part.SQL.items()}

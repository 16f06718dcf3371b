"""All queries of the graph engine, by name, and their SQL."""

from __future__ import annotations

from . import source_queries, table_queries

QUERIES = table_queries.QUERIES | source_queries.QUERIES
ORACLE = table_queries.ORACLE | source_queries.ORACLE

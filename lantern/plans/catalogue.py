"""Every registered query of the engine and the SQL that states its result."""

from __future__ import annotations

from lantern.plans import engine_queries, search_queries, text_queries

QUERIES = search_queries.QUERIES | text_queries.QUERIES | engine_queries.QUERIES
ORACLE_SQL = search_queries.SQL | text_queries.SQL | engine_queries.SQL

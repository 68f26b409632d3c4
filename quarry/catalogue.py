"""Registry of the catalogue queries and of their DuckDB oracles."""

from __future__ import annotations

from quarry.plans import change_queries, log_queries, record_queries, search_queries

_MODULES = (search_queries, log_queries, record_queries, change_queries)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}

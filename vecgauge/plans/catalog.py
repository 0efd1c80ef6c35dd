"""All queries of the core, by name, and their SQL."""

from __future__ import annotations

from vecgauge.plans import audit_queries, battery_queries, general_queries, learning_queries, validation_queries

_MODULES = (audit_queries, learning_queries, validation_queries, battery_queries, general_queries)

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}

"""All queries of the core with their SQL."""

from __future__ import annotations

from skein.plans import data_queries, graph_queries, page_queries, telemetry_queries

_MODULES = [data_queries, graph_queries, page_queries, telemetry_queries]

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}

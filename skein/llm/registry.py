"""All queries of this subpackage with their SQL, where SQL can express them."""

from __future__ import annotations

from skein.llm import copy_queries, leak_queries, page_queries, text_queries

_MODULES = [page_queries, copy_queries, leak_queries, text_queries]

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}

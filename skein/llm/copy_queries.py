"""Queries on addresses that differ in formatting only (6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.llm.copies import formatting_copies
from skein.shared import table


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return formatting_copies(table(spark, d, "nodes").select("node_id", "url"))


_BARE = r"regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]+', '', 'g')"
_URL = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _bare(x: str) -> str:
    return _BARE.format(x=x)


QUERIES = {"p6_found": p6_found}

SQL = {
    "p6_found": rf"""
WITH p AS (SELECT DISTINCT node_id, url FROM nodes WHERE node_id IS NOT NULL AND url IS NOT NULL),
d AS (SELECT node_id, regexp_replace(url_decode(url), '^[\s\x{{a0}}\x{{200b}}\x{{feff}}]+', '') AS u FROM p),
x AS (SELECT node_id, {_bare(f"regexp_extract(u, '{_URL}', 1)")} AS scheme, {_bare(f"regexp_extract(u, '{_URL}', 2)")} AS host,
        list_filter(list_transform(string_split(regexp_extract(u, '{_URL}', 3), '/'), lambda s: {_bare("s")}), lambda s: s <> '') AS segs,
        list_sort(list_filter(list_transform(string_split(regexp_extract(u, '{_URL}', 4), '&'),
          lambda s: {_bare("split_part(s, '=', 1)")} || '=' || {_bare("regexp_extract(s, '(?s)^[^=]*=(.*)$', 1)")}), lambda s: s <> '=')) AS params,
        {_bare(f"regexp_extract(u, '{_URL}', 5)")} AS frag FROM d),
g AS (SELECT *, min(node_id) OVER w AS group_node_id, count(*) OVER w AS n FROM x WINDOW w AS (PARTITION BY scheme, host, segs, params, frag))
SELECT group_node_id, node_id, CAST(n AS INTEGER) AS n_copies FROM g WHERE n > 1
"""
}

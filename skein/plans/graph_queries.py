"""Queries on the stored graph: counts, degrees, kinds of edges, components, cycles, algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import stats
from skein.operators.graph import WebGraph
from skein.operators.incremental import crawl_changes
from skein.plans.data_queries import _id
from skein.shared import clean_id, table
from skein.sources.io import dot_lines, export_edges


def load(spark: SparkSession, d: str) -> WebGraph:
    """The stored graph with ids in one spelling."""
    edges = table(spark, d, "edges").withColumns({"source_node_id": clean_id(F.col("source_node_id")), "target_node_id": clean_id(F.col("target_node_id"))})
    return WebGraph(table(spark, d, "nodes"), edges)


def two(spark: SparkSession, d: str) -> tuple[WebGraph, WebGraph]:
    """Two overlapping crawls: what was known in the first quarter, and the deeper pages as a later crawl saw them."""
    g = load(spark, d)
    one = g.nodes.groupBy("url").agg(F.min("node_id").alias("node_id"))  # in a graph a url is one node
    g = WebGraph(g.nodes.join(one.select("node_id"), "node_id", "left_semi").select(*g.nodes.columns), g.edges)
    left = g.filter(F.col("created_at") < F.lit("2025-04-01").cast("timestamp_ntz"))
    deep = g.filter(F.col("depth") >= 2)
    name = lambda c: F.concat(F.lit("b-"), c)
    nodes = deep.nodes.withColumns({
        "node_id": name(F.col("node_id")),
        "depth": F.col("depth") + 1,
        "scanned": ~F.col("scanned"),
        "response_status": F.when(F.col("response_status") != 200, F.col("response_status")),
        "created_at": F.col("created_at") + F.expr("INTERVAL '1' DAY"),
    })
    edges = deep.edges.withColumns({c: name(F.col(c)) for c in ("edge_id", "source_node_id", "target_node_id")})
    return left, WebGraph(nodes, edges)


_NODE = ("url", "node_id", "depth", "scanned", "response_status", "content_hash", "priority", "created_at", "lifecycle_stage")


def _nodes(g: WebGraph) -> DataFrame:
    return g.nodes.select(*_NODE, F.element_at("metadata", "title").alias("title"))


def _edge_urls(g: WebGraph) -> DataFrame:
    names = g.nodes.select("node_id", "url")
    return (
        g.edges.join(names.select(F.col("node_id").alias("source_node_id"), F.col("url").alias("source_url")), "source_node_id")
        .join(names.select(F.col("node_id").alias("target_node_id"), F.col("url").alias("target_url")), "target_node_id")
        .groupBy("source_url", "target_url")
        .agg(F.count(F.lit(1)).alias("n_edges"))
    )


def _union(strategy: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        a, b = two(spark, d)
        return _nodes(a.union(b, strategy))

    return query


_E = f"e AS (SELECT edge_id, {_id('source_node_id')} AS s, {_id('target_node_id')} AS t, metadata, created_at FROM edges)"
_PAIRS = f"{_E}, p AS (SELECT DISTINCT s, t FROM e)"
_DEG = f"""{_PAIRS}, i AS (SELECT t AS node_id, count(*) AS d FROM p GROUP BY 1), o AS (SELECT s AS node_id, count(*) AS d FROM p GROUP BY 1),
deg AS (SELECT n.node_id, n.url, n.created_at, coalesce(i.d, 0) AS in_degree, coalesce(o.d, 0) AS out_degree, coalesce(i.d, 0) + coalesce(o.d, 0) AS total_degree FROM nodes n LEFT JOIN i ON i.node_id = n.node_id LEFT JOIN o ON o.node_id = n.node_id)"""
_TYPES = "CASE WHEN metadata['link_type'] IS NULL THEN [] WHEN metadata['link_type'] LIKE '[%' THEN CAST(json(metadata['link_type']) AS varchar[]) ELSE [metadata['link_type']] END"
_KNOWN = "known AS (SELECT p.s, p.t FROM p WHERE p.s IN (SELECT node_id FROM nodes) AND p.t IN (SELECT node_id FROM nodes))"
_TWO = f"""{_E},
n0 AS (SELECT * FROM nodes WHERE node_id IN (SELECT min(node_id) FROM nodes GROUP BY url)),
n1 AS (SELECT * FROM n0 WHERE created_at < TIMESTAMP '2025-04-01'),
nd AS (SELECT * FROM n0 WHERE depth >= 2),
n2 AS (SELECT * REPLACE ('b-' || node_id AS node_id, depth + 1 AS depth, NOT scanned AS scanned, CASE WHEN response_status <> 200 THEN response_status END AS response_status, created_at + INTERVAL 1 DAY AS created_at) FROM nd),
e1 AS (SELECT * FROM e WHERE s IN (SELECT node_id FROM n1) AND t IN (SELECT node_id FROM n1)),
e2 AS (SELECT 'b-' || edge_id AS edge_id, 'b-' || s AS s, 'b-' || t AS t, metadata, created_at FROM e WHERE s IN (SELECT node_id FROM nd) AND t IN (SELECT node_id FROM nd)),
u1 AS (SELECT edge_id, a.url AS su, b.url AS tu, e1.created_at FROM e1 JOIN n1 a ON a.node_id = e1.s JOIN n1 b ON b.node_id = e1.t),
u2 AS (SELECT edge_id, a.url AS su, b.url AS tu, e2.created_at FROM e2 JOIN n2 a ON a.node_id = e2.s JOIN n2 b ON b.node_id = e2.t)"""


def _union_sql(rule: dict[str, str]) -> str:
    def pick(c: str, source: str) -> str:
        a, b = (f"a.{c}", f"b.{c}") if c != "title" else ("a.metadata['title']", "b.metadata['title']")
        both = rule.get(c, rule["*"]).replace("{a}", a).replace("{b}", b)
        return f"CASE WHEN b.url IS NULL THEN {a} WHEN a.url IS NULL THEN {b} ELSE {both} END AS {c}"

    return f"WITH {_TWO} SELECT coalesce(a.url, b.url) AS url, {', '.join(pick(c, '') for c in (*_NODE[1:], 'title'))} FROM n1 a FULL JOIN n2 b ON a.url = b.url"


_MERGE = {"*": "{a}", "depth": "least({a}, {b})", "scanned": "coalesce({a}, false) OR coalesce({b}, false)", "response_status": "coalesce({b}, {a})", "content_hash": "coalesce({b}, {a})", "created_at": "least({a}, {b})", "lifecycle_stage": "CASE WHEN {b} = 'html_stage' THEN {b} ELSE {a} END", "title": "coalesce({b}, {a})"}


def _snap(spark: SparkSession, d: str, no: int) -> DataFrame:
    rows = table(spark, d, "node_snapshots").where(F.col("snapshot_no") == no)
    return rows.groupBy("url").agg(F.max(F.struct("created_at", "scanned", F.lower("content_hash").alias("content_hash"))).alias("m")).select("url", "m.scanned", "m.content_hash")


def _snap_sql(no: int) -> str:
    return f"(SELECT url, scanned, h AS content_hash FROM (SELECT url, scanned, lower(content_hash) AS h, row_number() OVER (PARTITION BY url ORDER BY created_at DESC NULLS LAST, scanned DESC NULLS LAST, lower(content_hash) DESC NULLS LAST) AS rn FROM node_snapshots WHERE snapshot_no = {no}) WHERE rn = 1)"


def _cyclic(n: int):
    return lambda s, d: stats.cycles(load(s, d).edges, n).select(F.concat_ws(">", "cycle").alias("cycle"))


def _connected(s: SparkSession, d: str) -> DataFrame:
    g = load(s, d)
    return stats.components(g.nodes, g.edges).agg((F.countDistinct("component") <= 1).alias("connected"))


def _reach(s: SparkSession, d: str) -> DataFrame:
    g = load(s, d)
    return stats.reachable(g.edges.where("target_node_id is not null"), g.nodes.where("depth = 0"), 3)


def _graph(f):
    return lambda s, d: f(load(s, d))


def _pair(f):
    return lambda s, d: f(*two(s, d))


QUERIES = {
    "graph_stats": _graph(lambda g: stats.graph_stats(g.nodes, g.edges)),
    "degrees": _graph(lambda g: stats.degrees(g.nodes, g.edges).drop("created_at")),
    "neighbour_counts": _graph(lambda g: stats.neighbours(g.nodes, g.edges).groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))),
    "top_in_degree": _graph(lambda g: stats.popular_nodes(g.nodes, g.edges, 10, "in_degree")),
    "top_out_degree": _graph(lambda g: stats.popular_nodes(g.nodes, g.edges, 10, "out_degree")),
    "top_total_degree": _graph(lambda g: stats.popular_nodes(g.nodes, g.edges, 10, "total_degree")),
    "edge_types": _graph(lambda g: stats.edge_type_counts(g.edges)),
    "edge_statistics": _graph(lambda g: stats.edge_statistics(g.nodes, g.edges)),
    "edges_any_type": _graph(lambda g: stats.edges_by_type(g.edges, ["internal", "same_depth"], "any").select("edge_id").distinct()),
    "edges_all_types": _graph(lambda g: stats.edges_by_type(g.edges, ["internal", "back"], "all").select("edge_id").distinct()),
    "edges_exact_types": _graph(lambda g: stats.edges_by_type(g.edges, ["external", "deeper"], "exact").select("edge_id").distinct()),
    "depth_histogram": _graph(lambda g: stats.depth_histogram(g.nodes)),
    "unscanned_nodes": _graph(lambda g: g.unscanned().select("node_id", "url")),
    "nodes_at_depth": _graph(lambda g: g.at_depth(2).select("node_id", "url")),
    "connected_components": _graph(lambda g: stats.components(g.nodes, g.edges)),
    "is_connected": _connected,
    "reachable_3": _reach,
    "cycles_1": _cyclic(1),
    "cycles_2": _cyclic(2),
    "cycles_3": _cyclic(3),
    "cycle_members": lambda s, d: stats.cycle_members(load(s, d).edges),
    "remove_nodes": _graph(lambda g: g.remove_nodes(g.nodes.where("response_status >= 400").select("node_id")).edges.select("edge_id").distinct()),
    "filter_graph": _graph(lambda g: g.filter(F.col("scanned")).edges.groupBy("source_node_id", "target_node_id").agg(F.count(F.lit(1)).alias("n"))),
    "compact_graph": _graph(lambda g: g.compact().edges.agg(F.count(F.lit(1)).alias("n_edges"))),
    **{f"graph_union_{s}": _union(s) for s in ("first", "last", "merge", "newest", "oldest")},
    "graph_union_edges": _pair(lambda a, b: _edge_urls(a.union(b, "last"))),
    "graph_difference": _pair(lambda a, b: _nodes(a - b)),
    "graph_difference_edges": _pair(lambda a, b: _edge_urls(a - b)),
    "graph_intersection": _pair(lambda a, b: _nodes(a & b)),
    "graph_intersection_edges": _pair(lambda a, b: _edge_urls(a & b)),
    "graph_xor": _pair(lambda a, b: _nodes(a ^ b)),
    "graph_compare": _pair(lambda a, b: a.compare(b)),
    "incremental_changes": lambda s, d: crawl_changes(_snap(s, d, 1), _snap(s, d, 2)),
    "export_edges": _graph(lambda g: export_edges(g).select("edge_id", "source_url", "target_url", "source_depth", "target_depth").distinct()),
    "dot_edge_lines": _graph(lambda g: dot_lines(g).where("part = 2").select("line").distinct()),
}

_TOP = "SELECT node_id, url, {0} AS degree FROM deg ORDER BY {0} DESC, created_at, node_id LIMIT 10"
SQL = {
    "graph_stats": "SELECT count(*) AS total_nodes, count(*) FILTER (scanned) AS scanned_nodes, count(*) FILTER (NOT coalesce(scanned, false)) AS unscanned_nodes, coalesce(avg(depth), 0.0) AS avg_depth, coalesce(max(depth), 0) AS max_depth, (SELECT count(*) FROM edges) AS total_edges FROM nodes",
    "degrees": f"WITH {_DEG} SELECT node_id, url, in_degree, out_degree, total_degree FROM deg",
    "neighbour_counts": f"WITH {_PAIRS}, {_KNOWN}, b AS (SELECT s AS a, t AS b FROM known UNION SELECT t, s FROM known) SELECT a AS node_id, count(*) AS n FROM b GROUP BY 1",
    "top_in_degree": f"WITH {_DEG} {_TOP.format('in_degree')}",
    "top_out_degree": f"WITH {_DEG} {_TOP.format('out_degree')}",
    "top_total_degree": f"WITH {_DEG} {_TOP.format('total_degree')}",
    "edge_types": f"SELECT link_type, count(*) AS n_edges FROM (SELECT unnest({_TYPES}) AS link_type FROM edges) GROUP BY 1",
    "edge_statistics": f"WITH {_E} SELECT count(*) AS total_edges, avg(try_cast(e.metadata['depth_diff'] AS integer)) AS avg_depth_diff, count(*) FILTER (coalesce(e.metadata['anchor_text'], '') <> '') AS with_anchor, count(*) FILTER (coalesce(e.metadata['anchor_text'], '') = '') AS without_anchor, count(*) FILTER (n.node_id IS NOT NULL AND coalesce(n.scanned, false)) AS to_scanned, count(*) FILTER (n.node_id IS NOT NULL AND NOT coalesce(n.scanned, false)) AS to_unscanned FROM e LEFT JOIN nodes n ON n.node_id = e.t",
    "edges_any_type": f"SELECT DISTINCT edge_id FROM edges WHERE list_has_any({_TYPES}, ['internal', 'same_depth'])",
    "edges_all_types": f"SELECT DISTINCT edge_id FROM edges WHERE list_has_all({_TYPES}, ['internal', 'back'])",
    "edges_exact_types": f"SELECT DISTINCT edge_id FROM edges WHERE list_sort(list_distinct({_TYPES})) = ['deeper', 'external']",
    "depth_histogram": "SELECT depth, count(*) AS n_nodes FROM nodes GROUP BY 1",
    "unscanned_nodes": "SELECT node_id, url FROM nodes WHERE NOT coalesce(scanned, false)",
    "nodes_at_depth": "SELECT node_id, url FROM nodes WHERE depth = 2",
    "connected_components": f"WITH RECURSIVE {_PAIRS}, {_KNOWN}, b AS (SELECT s AS a, t AS b FROM known UNION SELECT t, s FROM known), r(a, b) AS (SELECT node_id, node_id FROM nodes UNION SELECT r.a, b.b FROM r JOIN b ON b.a = r.b) SELECT a AS node_id, min(b) AS component FROM r GROUP BY 1",
    "is_connected": f"WITH RECURSIVE {_PAIRS}, {_KNOWN}, b AS (SELECT s AS a, t AS b FROM known UNION SELECT t, s FROM known), r(a) AS (SELECT min(node_id) FROM nodes UNION SELECT b.b FROM r JOIN b ON b.a = r.a) SELECT (SELECT count(*) FROM r) >= (SELECT count(*) FROM nodes) AS connected",
    "reachable_3": f"WITH RECURSIVE {_PAIRS}, r(node_id, steps) AS (SELECT node_id, 0 FROM nodes WHERE depth = 0 UNION SELECT p.t, r.steps + 1 FROM r JOIN p ON p.s = r.node_id WHERE r.steps < 3 AND p.t IS NOT NULL) SELECT node_id, min(steps) AS steps FROM r GROUP BY 1",
    "cycle_members": f"""WITH RECURSIVE {_PAIRS.lstrip()}, reach(u, v) AS (SELECT s, t FROM p WHERE s IS NOT NULL AND t IS NOT NULL UNION SELECT reach.u, p.t FROM reach JOIN p ON p.s = reach.v WHERE p.t IS NOT NULL)
SELECT x.u AS node_id, min(y.v) AS component FROM reach x JOIN reach y ON y.u = x.u JOIN reach z ON z.u = y.v AND z.v = x.u WHERE x.u = x.v GROUP BY 1""",
    "cycles_1": f"WITH {_PAIRS} SELECT s AS cycle FROM p WHERE s = t",
    "cycles_2": f"WITH {_PAIRS} SELECT a.s || '>' || a.t AS cycle FROM p a JOIN p b ON a.t = b.s AND b.t = a.s WHERE a.s < a.t",
    "cycles_3": f"WITH {_PAIRS} SELECT a.s || '>' || a.t || '>' || b.t AS cycle FROM p a JOIN p b ON a.t = b.s JOIN p c ON b.t = c.s AND c.t = a.s WHERE a.s < a.t AND a.s < b.t AND a.t <> b.t",
    "remove_nodes": f"WITH {_E}, bad AS (SELECT node_id FROM nodes WHERE response_status >= 400) SELECT DISTINCT edge_id FROM e WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.node_id = e.s OR bad.node_id = e.t)",
    "filter_graph": f"WITH {_E} SELECT s AS source_node_id, t AS target_node_id, count(*) AS n FROM e WHERE s IN (SELECT node_id FROM nodes WHERE scanned) AND t IN (SELECT node_id FROM nodes WHERE scanned) GROUP BY 1, 2",
    "compact_graph": f"WITH {_PAIRS} SELECT count(*) AS n_edges FROM p",
    "graph_union_first": _union_sql({"*": "{a}"}),
    "graph_union_last": _union_sql({"*": "{b}"}),
    "graph_union_merge": _union_sql(_MERGE),
    "graph_union_newest": _union_sql({"*": "CASE WHEN coalesce(b.created_at > a.created_at, false) THEN {b} ELSE {a} END"}),
    "graph_union_oldest": _union_sql({"*": "CASE WHEN coalesce(b.created_at < a.created_at, false) THEN {b} ELSE {a} END"}),
    "graph_union_edges": f"WITH {_TWO} SELECT su AS source_url, tu AS target_url, 1 AS n_edges FROM (SELECT su, tu FROM u1 UNION SELECT su, tu FROM u2)",
    "graph_difference": f"WITH {_TWO} SELECT {', '.join(_NODE)}, metadata['title'] AS title FROM n1 WHERE url NOT IN (SELECT url FROM n2)",
    "graph_difference_edges": f"WITH {_TWO} SELECT su AS source_url, tu AS target_url, count(*) AS n_edges FROM u1 WHERE su NOT IN (SELECT url FROM n2) AND tu NOT IN (SELECT url FROM n2) GROUP BY 1, 2",
    "graph_intersection": f"WITH {_TWO} SELECT {', '.join(_NODE)}, metadata['title'] AS title FROM n1 WHERE url IN (SELECT url FROM n2)",
    "graph_intersection_edges": f"WITH {_TWO}, own AS (SELECT su, tu, count(*) AS n FROM u1 WHERE su IN (SELECT url FROM n2) AND tu IN (SELECT url FROM n2) GROUP BY 1, 2), other AS (SELECT DISTINCT su, tu FROM u2 WHERE su IN (SELECT url FROM n1) AND tu IN (SELECT url FROM n1)) SELECT su AS source_url, tu AS target_url, n AS n_edges FROM own UNION ALL SELECT su, tu, 1 FROM other WHERE (su, tu) NOT IN (SELECT su, tu FROM own)",
    "graph_xor": f"WITH {_TWO} SELECT {', '.join(_NODE)}, metadata['title'] AS title FROM n1 WHERE url NOT IN (SELECT url FROM n2) UNION ALL SELECT {', '.join(_NODE)}, metadata['title'] FROM n2 WHERE url NOT IN (SELECT url FROM n1)",
    "graph_compare": f"WITH {_TWO}, x AS (SELECT a.url AS o, b.url AS n FROM (SELECT DISTINCT url FROM n1) a FULL JOIN (SELECT DISTINCT url FROM n2) b ON a.url = b.url) SELECT count(*) FILTER (o IS NULL) AS n_new, count(*) FILTER (n IS NULL) AS n_removed, count(*) FILTER (o IS NOT NULL AND n IS NOT NULL) AS n_common, count(*) FILTER (o IS NOT NULL AND n IS NOT NULL) / count(*) AS similarity FROM x",
    "incremental_changes": f"SELECT n.url, CASE WHEN o.url IS NULL THEN 'new' WHEN NOT coalesce(n.scanned AND o.scanned, false) OR n.content_hash IS NULL OR o.content_hash IS NULL THEN 'uncomparable' WHEN n.content_hash <> o.content_hash THEN 'changed' ELSE 'unchanged' END AS status, NOT coalesce(n.scanned AND o.scanned AND n.content_hash = o.content_hash, false) AS process_links FROM {_snap_sql(2)} n LEFT JOIN {_snap_sql(1)} o ON o.url = n.url",
    "export_edges": f"WITH {_E} SELECT DISTINCT edge_id, coalesce(a.url, '') AS source_url, coalesce(b.url, '') AS target_url, a.depth AS source_depth, b.depth AS target_depth FROM e LEFT JOIN nodes a ON a.node_id = e.s LEFT JOIN nodes b ON b.node_id = e.t",
    "dot_edge_lines": f"""WITH {_E} SELECT DISTINCT '  "' || s || '" -> "' || t || '"' || CASE WHEN list_contains({_TYPES}, 'external') THEN ' [color="red"]' WHEN list_contains({_TYPES}, 'back') THEN ' [color="orange"]' ELSE '' END || ';' AS line FROM e""",
}

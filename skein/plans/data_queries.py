"""Queries of the general data problems: snapshots, orphans, hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.hierarchy import descendants, hierarchy, hierarchy_paths
from skein.operators.orphans import orphan_references, orphan_report
from skein.operators.snapshots import snapshot_changes
from skein.shared import table, written


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_changes(table(spark, d, "node_snapshots"))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return p1_found(spark, d).groupBy("snapshot_no", "change_kind").agg(F.count(F.lit(1)).alias("n_urls"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return orphan_references(table(spark, d, "edges"), table(spark, d, "nodes"))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(p3_found(spark, d))


def _contains(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "edges").where(F.lower(F.trim(F.element_at("metadata", "edge_type"))) == "contains").select("source_node_id", "target_node_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy(_contains(spark, d))


def p5_paths(spark: SparkSession, d: str) -> DataFrame:
    """Full path of every node that has a root, from the root down."""
    links = _contains(spark, d)
    return hierarchy_paths(links, written(hierarchy(links), "levels")).select("node_id", F.array_join("path", "/").alias("path"), F.size("path").alias("path_nodes"))


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    """All descendants of every node."""
    return descendants(_contains(spark, d))


_P1 = """
v AS (SELECT snapshot_no, url, lower(content_hash) AS h,
        row_number() OVER (PARTITION BY snapshot_no, url ORDER BY created_at DESC NULLS LAST, lower(content_hash) DESC NULLS LAST) AS rn
      FROM node_snapshots WHERE snapshot_no IS NOT NULL AND url IS NOT NULL),
w AS (SELECT snapshot_no, url, h FROM v WHERE rn = 1),
n AS (SELECT snapshot_no AS s, lag(snapshot_no) OVER (ORDER BY snapshot_no) AS p FROM (SELECT DISTINCT snapshot_no FROM w)),
new AS (SELECT n.s, w.url, w.h FROM w JOIN n ON w.snapshot_no = n.s WHERE n.p IS NOT NULL),
old AS (SELECT n.s, w.url, w.h FROM w JOIN n ON w.snapshot_no = n.p),
found AS (SELECT coalesce(new.s, old.s) AS snapshot_no, coalesce(new.url, old.url) AS url,
        CASE WHEN new.url IS NULL THEN 'removed' WHEN old.url IS NULL THEN 'added' ELSE 'changed' END AS change_kind
      FROM new FULL JOIN old ON new.s = old.s AND new.url = old.url
      WHERE new.url IS NULL OR old.url IS NULL OR new.h IS DISTINCT FROM old.h)
"""

_ID = r"nullif(lower(regexp_replace({c}, '^[\s\x{{a0}}\x{{0b}}]+|[\s\x{{a0}}\x{{0b}}]+$', '', 'g')), '')"


def _id(c: str) -> str:
    return _ID.format(c=c)


_P3 = f"""
r AS (SELECT edge_id, created_at, 'source_node_id' AS field_name, {_id("source_node_id")} AS id FROM edges
      UNION ALL SELECT edge_id, created_at, 'target_node_id', {_id("target_node_id")} FROM edges),
k AS (SELECT {_id("node_id")} AS id, created_at AS born, try_cast(metadata['removed_at'] AS timestamp) AS gone FROM nodes),
found AS (SELECT DISTINCT edge_id, field_name,
        CASE WHEN k.id IS NULL THEN 'missing' WHEN k.born > r.created_at THEN 'late' WHEN k.gone <= r.created_at THEN 'deleted' END AS reason,
        strftime(r.created_at, '%Y-%m') AS month_key
      FROM r LEFT JOIN k ON r.id = k.id WHERE r.id IS NOT NULL)
"""

_P5 = f"""
WITH RECURSIVE a AS (SELECT DISTINCT {_id("source_node_id")} AS p, {_id("target_node_id")} AS c FROM edges
        WHERE lower(trim(metadata['edge_type'])) = 'contains' AND {_id("source_node_id")} IS NOT NULL AND {_id("target_node_id")} IS NOT NULL),
every AS (SELECT p AS node FROM a UNION SELECT c FROM a),
reach(u, v) AS (SELECT p, c FROM a UNION SELECT reach.u, a.c FROM reach JOIN a ON a.p = reach.v),
cyc AS (SELECT DISTINCT u AS node FROM reach WHERE u = v),
taint AS (SELECT v AS node FROM reach WHERE u IN (SELECT node FROM cyc) UNION SELECT node FROM cyc),
lv(node, root, d) AS (SELECT node, node, 0 FROM every WHERE node NOT IN (SELECT c FROM a)
        UNION SELECT a.c, lv.root, lv.d + 1 FROM lv JOIN a ON a.p = lv.node WHERE a.c NOT IN (SELECT node FROM taint)),
best AS (SELECT node, root, d, row_number() OVER (PARTITION BY node ORDER BY d, root) AS rn FROM lv)
@
SELECT e.node AS node_id, coalesce(b.root, '') AS root_id, CAST(coalesce(b.d, -1) AS INTEGER) AS level_no,
       CAST((SELECT count(*) FROM reach WHERE reach.u = e.node AND reach.v <> e.node) AS INTEGER) AS n_descendants,
       CAST(e.node IN (SELECT node FROM cyc) AS INTEGER) AS on_cycle
FROM every e LEFT JOIN best b ON b.node = e.node AND b.rn = 1
"""

_P5, _P5_FOUND = _P5.split("@")

QUERIES = {"p1_found": p1_found, "p1_report": p1_report, "p3_found": p3_found, "p3_report": p3_report, "p5_found": p5_found, "p5_paths": p5_paths, "p5_descendants": p5_descendants}

SQL = {
    "p1_found": f"WITH {_P1} SELECT snapshot_no, url, change_kind FROM found",
    "p1_report": f"WITH {_P1} SELECT snapshot_no, change_kind, count(*) AS n_urls FROM found GROUP BY 1, 2",
    "p3_found": f"WITH {_P3} SELECT edge_id, field_name, reason, month_key FROM found WHERE reason IS NOT NULL",
    "p3_report": f"WITH {_P3} SELECT field_name, reason, month_key, count(*) AS n_refs FROM found WHERE reason IS NOT NULL GROUP BY 1, 2, 3",
    "p5_found": _P5 + _P5_FOUND,
    "p5_paths": _P5 + """,
up AS (SELECT b.node, b.d, min(a.p) AS p FROM best b JOIN a ON a.c = b.node AND a.p <> a.c JOIN best q ON q.node = a.p AND q.rn = 1 AND q.d = b.d - 1 AND q.root = b.root WHERE b.rn = 1 GROUP BY 1, 2),
path(node, path, n) AS (SELECT node, node, 1 FROM best WHERE rn = 1 AND d = 0 UNION SELECT up.node, path.path || '/' || up.node, path.n + 1 FROM path JOIN up ON up.p = path.node)
SELECT node AS node_id, path, n AS path_nodes FROM path""",
    "p5_descendants": f"""
WITH RECURSIVE a AS (SELECT DISTINCT {_id("source_node_id")} AS p, {_id("target_node_id")} AS c FROM edges
        WHERE lower(trim(metadata['edge_type'])) = 'contains' AND {_id("source_node_id")} IS NOT NULL AND {_id("target_node_id")} IS NOT NULL),
w(u, v, n) AS (SELECT p, c, 1 FROM a WHERE p <> c UNION SELECT w.u, a.c, w.n + 1 FROM w JOIN a ON a.p = w.v WHERE a.p <> a.c AND w.n < 200)
SELECT u AS node_id, v AS descendant_id, CAST(min(n) AS INTEGER) AS steps FROM w WHERE u <> v GROUP BY 1, 2""",
}

"""Queries on the event log as crawl telemetry, and on vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import vectors as V
from skein.operators import search as S
from skein.operators import telemetry as T
from skein.shared import table


def requests(spark: SparkSession, d: str) -> DataFrame:
    """Events as requests: the user is the key, an error event a failure, the value the milliseconds."""
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), "ts", F.col("user_id").alias("key"), (F.col("event_type") != "error").alias("ok"), (F.col("value") / 100).alias("seconds"), F.col("event_type").alias("kind"), F.concat_ws(" ", F.lit("HTTP"), F.get_json_object("props", "$.k"), F.lit("timeout")).alias("error"))


def _r(f):
    return lambda s, d: f(requests(s, d))


def error_classes(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("ConnectionError", "HTTPStatusError", "ParseError", "ValidationError", "AuthError", "DriverError", "ValueError")))
    texts = F.array(*map(F.lit, ("404 page", "fatal 500", "connection reset", "invalid url", "429 rate", "no space", "utf-8", "403 forbidden", "browser crash")))
    e = table(spark, d, "events").select(F.get(kinds, F.pmod("event_id", F.lit(7)).cast("int")).alias("kind"), F.get(texts, F.pmod("user_id", F.lit(9)).cast("int")).alias("message"))
    c = T.error_category(F.col("kind"), F.col("message"))
    return e.groupBy("kind", "message", c.alias("category"), T.error_severity(c, F.col("message")).alias("severity"), T.is_retryable(c, F.col("message")).alias("retryable"), T.recovery_kind(F.col("message")).alias("recovery")).agg(F.count(F.lit(1)).alias("n"))


def retry_delays(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "responses").where("status_code is not null").select("response_id", "status_code").distinct()
    return rows.select("response_id", T.retry_delay(F.col("status_code"), F.lit(2)).alias("delay"))


def queue_counts(spark: SparkSession, d: str) -> DataFrame:
    q = _queue(spark, d)
    return T.queue_stats(q)


def _queue(spark: SparkSession, d: str) -> DataFrame:
    """Nodes as a crawl's queue: scanned ones are done, refused ones failed."""
    n = table(spark, d, "nodes")
    status = F.when(F.col("response_status") >= 400, "failed").when(F.col("scanned"), "done").otherwise("pending")
    return n.select(F.col("node_id").alias("id"), "url", "priority", "created_at", status.alias("status"))


def queue_next(spark: SparkSession, d: str) -> DataFrame:
    return T.queue_pop(_queue(spark, d).withColumn("priority", F.coalesce("priority", F.lit(5))), 25)


def jobs_second_page(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"))
    return T.jobs_page(j, status="O", limit=20, offset=20)


def _near(metric: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        v = table(spark, d, "embeddings")
        found = S.search(v, v.where("vec_id % 50 = 0"), top_k=10, metric=metric)
        return found.select("query_id", "vec_id", "rank", F.round("similarity", 4).alias("similarity"))

    return query


def search_threshold(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    return S.search(v, v.where("vec_id % 50 = 0"), top_k=5, metric="cosine", threshold=0.2).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))


def compare_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each vector with the next one."""
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    pairs = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    r = lambda c: F.round(c, 4)
    a, b = F.col("a"), F.col("b")
    return pairs.select("vec_id", r(V.cosine_similarity(a, b)).alias("cosine"), r(V.dot_product(a, b)).alias("dot"), r(V.euclidean_distance(a, b)).alias("euclid"), V.compare(a, b)["is_similar"].alias("similar"))


def vector_clusters_dbscan(spark: SparkSession, d: str) -> DataFrame:
    c = S.dbscan(table(spark, d, "embeddings"), eps=0.5, min_samples=2)
    return c.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


def vector_clusters_kmeans(spark: SparkSession, d: str) -> DataFrame:
    return S.kmeans(table(spark, d, "embeddings"), 10).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


def vector_clusters_ward(spark: SparkSession, d: str) -> DataFrame:
    return S.ward(table(spark, d, "embeddings"), 10).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


def vector_clusters_bisecting(spark: SparkSession, d: str) -> DataFrame:
    return S.bisecting(table(spark, d, "embeddings"), 10).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "crawl_metrics": _r(T.crawl_metrics),
    "crawl_metrics_by_kind": _r(lambda r: T.crawl_metrics(r, ["kind"])),
    "fetch_histogram": _r(lambda r: T.histogram(r, "seconds", T.FETCH_BUCKETS)),
    "dead_letters": _r(T.dead_letters),
    "consecutive_errors": _r(T.consecutive_errors),
    "sliding_rate": _r(lambda r: T.sliding_rate(r, 3600)),
    "fixed_rate": _r(lambda r: T.fixed_rate(r, 3600)),
    "request_sessions": _r(lambda r: T.session_count(r, "30 minutes")),
    "history_last_n": _r(lambda r: T.last_n(r, 5).select("id", "key", "recency")),
    "proxy_scores": _r(T.proxy_scores),
    "best_proxies": _r(lambda r: T.best_proxies(r, 10).select("key", "n", "rate")),
    "round_robin": _r(lambda r: T.round_robin(r, ["a", "b", "c"]).groupBy("member").agg(F.count(F.lit(1)).alias("n"))),
    "throttle_delays": _r(T.throttle),
    "token_bucket_waits": _r(lambda r: T.token_bucket(r, rate=0.001)),
    "dns_cache_hits": _r(T.dns_cache),
    "status_counts": lambda s, d: T.status_counts(table(s, d, "responses").select("response_id", "status_code").distinct()),
    "cosine_topk": _near("cosine"),
    "dot_topk": _near("dot"),
    "euclidean_topk": _near("euclidean"),
} | {f.__name__: f for f in (error_classes, retry_delays, queue_counts, queue_next, jobs_second_page, search_threshold, compare_pairs, vector_clusters_dbscan, vector_clusters_kmeans, vector_clusters_ward, vector_clusters_bisecting)}

_R = "r AS (SELECT event_id AS id, ts, user_id AS key, event_type <> 'error' AS ok, value / 100 AS seconds, event_type AS kind, 'HTTP ' || json_extract_string(props, '$.k') || ' timeout' AS error FROM events)"
_METRICS = "count(*) AS n_requests, count(*) FILTER (ok) AS n_ok, count(*) FILTER (NOT ok) AS n_failed, avg(seconds) AS avg_seconds, min(seconds) AS min_seconds, max(seconds) AS max_seconds, count(*) FILTER (ok) * 100.0 / count(*) AS success_percent"
_ERR = """
x AS (SELECT kind, message, lower(kind) AS k, lower(message) AS m FROM (SELECT ['ConnectionError', 'HTTPStatusError', 'ParseError', 'ValidationError', 'AuthError', 'DriverError', 'ValueError'][event_id % 7 + 1] AS kind,
  ['404 page', 'fatal 500', 'connection reset', 'invalid url', '429 rate', 'no space', 'utf-8', '403 forbidden', 'browser crash'][user_id % 9 + 1] AS message FROM events)),
c AS (SELECT *, CASE WHEN regexp_matches(k, 'connection|timeout|network') OR regexp_matches(m, 'connection|timeout|network') THEN 'network' WHEN regexp_matches(k, 'http|status') OR regexp_matches(m, '404|500|502|503') THEN 'http' WHEN regexp_matches(k, 'parse|decode|encoding') THEN 'parsing' WHEN regexp_matches(k, 'validation|invalid') THEN 'validation' WHEN regexp_matches(k, 'auth|permission|forbidden') OR regexp_matches(m, '401|403|unauthorized|forbidden') THEN 'authentication' WHEN regexp_matches(m, 'rate|429') THEN 'rate_limit' WHEN regexp_matches(k, 'driver|playwright|selenium') THEN 'driver' ELSE 'unknown' END AS category FROM x)
"""
_SIM = {
    "cosine": "list_cosine_similarity(CAST(q.embedding AS double[]), CAST(v.embedding AS double[]))",
    "dot": "list_inner_product(CAST(q.embedding AS double[]), CAST(v.embedding AS double[]))",
    "euclidean": "1 / (1 + list_distance(CAST(q.embedding AS double[]), CAST(v.embedding AS double[])))",
}


_ORDERED = f"""{_R}, o AS (SELECT id, key, CAST(epoch_us(ts) AS DOUBLE) / 1e6 AS t, ok, CAST(seconds AS DOUBLE) AS seconds, row_number() OVER (PARTITION BY key ORDER BY ts, id) AS k,
  sum(CAST(ok AS INTEGER)) OVER (PARTITION BY key ORDER BY ts, id) AS n_ok FROM r)"""
_THROTTLE = f"""WITH RECURSIVE {_ORDERED},
good AS (SELECT key, n_ok, avg(seconds) OVER (PARTITION BY key ORDER BY k ROWS 99 PRECEDING) AS mean FROM o WHERE ok),
bad AS (SELECT *, avg(CAST(NOT ok AS INTEGER)) OVER (PARTITION BY key ORDER BY k ROWS 99 PRECEDING) AS errors FROM o),
turn AS (SELECT bad.key, bad.k // 10 AS j, CASE WHEN errors > 0.1 THEN 1 WHEN mean < 0.5 THEN -1 ELSE 0 END AS way FROM bad LEFT JOIN good USING (key, n_ok) WHERE bad.k % 10 = 0),
d(key, j, delay) AS (SELECT DISTINCT key, CAST(0 AS BIGINT), CAST(0.5 AS DOUBLE) FROM o UNION ALL SELECT d.key, turn.j, CASE way WHEN 1 THEN least(CAST(5 AS DOUBLE), d.delay * CAST(1.5 AS DOUBLE)) WHEN -1 THEN greatest(CAST(0.1 AS DOUBLE), d.delay * CAST(0.8 AS DOUBLE)) ELSE d.delay END FROM d JOIN turn ON turn.key = d.key AND turn.j = d.j + 1)
SELECT o.id, o.key, d.delay FROM o JOIN d ON d.key = o.key AND d.j = o.k // 10"""
_BUCKET = f"""WITH RECURSIVE {_ORDERED},
s(key, k, id, t, tokens) AS (SELECT key, k, id, t, CAST(0.002 AS DOUBLE) FROM o WHERE k = 1 UNION ALL
  SELECT o.key, o.k, o.id, o.t, least(CAST(0.002 AS DOUBLE), s.tokens - 1 + (o.t - s.t) * CAST(0.001 AS DOUBLE)) FROM s JOIN o ON o.key = s.key AND o.k = s.k + 1)
SELECT id, key, CASE WHEN tokens >= 1 THEN CAST(0 AS DOUBLE) ELSE (1 - tokens) / CAST(0.001 AS DOUBLE) END AS wait FROM s"""
_DBSCAN = f"""WITH RECURSIVE n AS (SELECT q.vec_id AS a, v.vec_id AS b FROM embeddings q, embeddings v WHERE q.vec_id <> v.vec_id AND 1 - {_SIM["cosine"]} <= 0.5),
core AS (SELECT a FROM n GROUP BY a HAVING count(*) + 1 >= 2),
w(a, b) AS (SELECT a, a FROM core UNION SELECT w.a, n.b FROM w JOIN n ON n.a = w.b WHERE n.b IN (SELECT a FROM core)),
named AS (SELECT a, min(b) AS cluster FROM w GROUP BY 1),
edge AS (SELECT n.a, arg_min(named.cluster, n.b) AS cluster FROM n JOIN named ON named.a = n.b WHERE n.a NOT IN (SELECT a FROM core) GROUP BY 1)
SELECT CAST(coalesce(named.cluster, edge.cluster, -1) AS BIGINT) AS cluster, count(*) AS n FROM embeddings e LEFT JOIN named ON named.a = e.vec_id LEFT JOIN edge ON edge.a = e.vec_id GROUP BY 1"""


def _top(metric: str, k: int = 10) -> str:
    return f"SELECT query_id, vec_id, CAST(rank AS integer) AS rank, round(similarity, 4) AS similarity FROM (SELECT q.vec_id AS query_id, v.vec_id, {_SIM[metric]} AS similarity, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_SIM[metric]}, 9) DESC, v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0) WHERE rank <= {k}"


_QUEUE = "qu AS (SELECT node_id AS id, url, priority, created_at, CASE WHEN response_status >= 400 THEN 'failed' WHEN scanned THEN 'done' ELSE 'pending' END AS status FROM nodes)"
SQL = {
    "throttle_delays": _THROTTLE,
    "token_bucket_waits": _BUCKET,
    "vector_clusters_dbscan": _DBSCAN,
    "crawl_metrics": f"WITH {_R} SELECT {_METRICS} FROM r",
    "crawl_metrics_by_kind": f"WITH {_R} SELECT kind, {_METRICS} FROM r GROUP BY 1",
    "fetch_histogram": f"WITH {_R} " + " UNION ALL ".join(f"SELECT CAST({b} AS double) AS bound, count(*) FILTER (seconds <= {b}) AS n FROM r" for b in T.FETCH_BUCKETS) + " UNION ALL SELECT CAST('inf' AS double), count(seconds) FROM r",
    "dead_letters": f"WITH {_R}, g AS (SELECT key, max(ts) AS good FROM r WHERE ok GROUP BY 1), f AS (SELECT r.* FROM r LEFT JOIN g ON g.key = r.key WHERE NOT ok AND (good IS NULL OR ts > good)), a AS (SELECT key, count(*) AS attempts, epoch_us(min(ts)) / 1e6 AS first_failed, epoch_us(max(ts)) / 1e6 AS last_failed, arg_max(error, (ts, error)) AS last_error FROM f GROUP BY 1) SELECT *, attempts >= 3 AS permanent, CASE WHEN attempts < 3 THEN last_failed + pow(2, attempts - 1) END AS retry_after FROM a",
    "consecutive_errors": f"WITH {_R}, i AS (SELECT key, ok, sum(CAST(ok AS integer)) OVER (PARTITION BY key ORDER BY ts, id) AS island FROM r), n AS (SELECT key, island, count(*) AS run FROM i WHERE NOT ok GROUP BY 1, 2) SELECT k.key, coalesce(max(run), 0) AS longest_run FROM (SELECT DISTINCT key FROM r) k LEFT JOIN n ON n.key = k.key GROUP BY 1",
    "sliding_rate": f"WITH {_R} SELECT id, key, count(*) OVER (PARTITION BY key ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS n_recent FROM r",
    "fixed_rate": f"WITH {_R} SELECT key, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n FROM r GROUP BY 1, 2",
    "request_sessions": f"WITH {_R}, s AS (SELECT key, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY key ORDER BY ts) + INTERVAL 30 MINUTES OR lag(ts) OVER (PARTITION BY key ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM r), g AS (SELECT key, ts, sum(new) OVER (PARTITION BY key ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM s) SELECT key, min(ts) AS session_start, count(*) AS n FROM g GROUP BY key, g",
    "history_last_n": f"WITH {_R} SELECT id, key, CAST(recency AS integer) AS recency FROM (SELECT id, key, row_number() OVER (PARTITION BY key ORDER BY ts DESC, id DESC) AS recency FROM r) WHERE recency <= 5",
    "proxy_scores": f"WITH {_R} SELECT key, count(*) AS n, avg(CAST(ok AS double)) AS rate, avg(CASE WHEN ok THEN seconds END) AS avg_seconds, avg(CAST(ok AS double)) >= 0.5 OR count(*) < 10 AS good FROM r GROUP BY 1",
    "best_proxies": f"WITH {_R} SELECT key, n, rate FROM (SELECT key, count(*) AS n, avg(CAST(ok AS double)) AS rate, avg(CASE WHEN ok THEN seconds END) AS s FROM r GROUP BY 1) WHERE rate >= 0.5 OR n < 10 ORDER BY rate DESC, s NULLS LAST, key LIMIT 10",
    "round_robin": "SELECT ['a', 'b', 'c'][event_id % 3 + 1] AS member, count(*) AS n FROM events GROUP BY 1",
    "dns_cache_hits": f"WITH RECURSIVE {_R}, o AS (SELECT id, key, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY key ORDER BY ts, id) AS rn FROM r), f AS (SELECT id, key, rn, t AS missed, 0.0::double AS hit FROM o WHERE rn = 1 UNION ALL SELECT o.id, o.key, o.rn, CASE WHEN o.t <= f.missed + 3600 THEN f.missed ELSE o.t END, CASE WHEN o.t <= f.missed + 3600 THEN 1.0 ELSE 0.0 END FROM f JOIN o ON o.key = f.key AND o.rn = f.rn + 1) SELECT id, key, hit FROM f",
    "status_counts": "SELECT status_code, count(*) AS n FROM (SELECT DISTINCT response_id, status_code FROM responses) GROUP BY 1",
    "cosine_topk": _top("cosine"),
    "dot_topk": _top("dot"),
    "euclidean_topk": _top("euclidean"),
    "search_threshold": f"SELECT query_id, count(*) AS n FROM ({_top('cosine', 5)}) WHERE similarity >= 0.2 GROUP BY 1",
    "compare_pairs": f"SELECT q.vec_id, round({_SIM['cosine']}, 4) AS cosine, round({_SIM['dot']}, 4) AS dot, round(list_distance(CAST(q.embedding AS double[]), CAST(v.embedding AS double[])), 4) AS euclid, {_SIM['cosine']} > 0.5 AS similar FROM embeddings q JOIN embeddings v ON v.vec_id = q.vec_id + 1",
    "error_classes": f"WITH {_ERR} SELECT kind, message, category, CASE WHEN category = 'validation' OR regexp_matches(m, 'fatal|critical') THEN 'critical' WHEN category IN ('authentication', 'rate_limit') OR regexp_matches(m, '500|502|503') THEN 'high' WHEN category IN ('network', 'driver') OR regexp_matches(m, 'timeout') THEN 'medium' WHEN regexp_matches(m, '404') THEN 'low' ELSE 'medium' END AS severity, NOT (category IN ('validation', 'authentication') OR regexp_matches(m, '404|401|403') OR (regexp_matches(m, 'invalid') AND regexp_matches(m, 'url'))) AND category IN ('network', 'http', 'driver', 'rate_limit', 'parsing') AS retryable, CASE WHEN regexp_matches(m, 'timeout|connection|dns|network|unreachable|refused|reset|timed out') THEN 'network' WHEN regexp_matches(m, 'driver|browser|playwright|selenium|webdriver|crash|terminated') THEN 'driver' WHEN regexp_matches(m, 'parse|html|decode|encoding|malformed|invalid markup|beautifulsoup') THEN 'parsing' WHEN regexp_matches(m, 'storage|disk|write|save|database|sqlite|mongodb|no space') THEN 'storage' ELSE 'unknown' END AS recovery, count(*) AS n FROM c GROUP BY ALL",
    "retry_delays": "SELECT response_id, CASE status_code WHEN 429 THEN 12.0 WHEN 503 THEN 2.0 ELSE 4.0 END AS delay FROM (SELECT DISTINCT response_id, status_code FROM responses) WHERE status_code IS NOT NULL",
    "queue_counts": f"WITH {_QUEUE} SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'processing') AS processing, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'failed') AS failed, count(*) AS total FROM qu",
    "queue_next": f"WITH {_QUEUE} SELECT id, url, coalesce(priority, 5) AS priority, created_at, status FROM qu WHERE status = 'pending' ORDER BY coalesce(priority, 5) DESC, created_at, id LIMIT 25",
    "jobs_second_page": "SELECT o_orderkey AS job_id, o_orderstatus AS status, o_orderdate AS created_at FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 20",
}

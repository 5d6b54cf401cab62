"""Queries on urls, page source, rules and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import extract, rules, text, urls
from skein.operators.expand import CrawlPlan, apply_edge_strategy, expand, link_kind, page_links
from skein.operators.sitemap import sitemap_edges
from skein.shared import table

_RULES = [
    rules.URLRule(r"sitemap", priority=9, should_scan=True, should_follow_links=True),
    rules.URLRule(r"\.html$", priority=7),
    rules.URLRule(r"[?&]page=", priority=2, should_scan=False),
    rules.URLRule(r"/20\d\d/", priority=6, should_scan=True, should_follow_links=False),
]
_DOMAIN = rules.DomainFilter("rone-canal.test", ("domain+subdomains", "dotrite.invalid"), ("www.dotrite.invalid",))
_PATH = rules.PathFilter(include=("^/[a-z]",), exclude=("sitemaps", r"\.xml$"))


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nodes")


def _responses(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "responses").dropDuplicates(["response_id"])


def url_functions(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return _nodes(spark, d).select("node_id", urls.normalize_url(u).alias("normal"), urls.get_domain(u).alias("domain"), urls.get_root_domain(u).alias("root_domain"), urls.is_valid_url(u).alias("valid"), urls.sanitize_url(u).alias("sanitized"))


def domain_histogram(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d).groupBy(urls.get_root_domain(F.lower("url")).alias("domain")).agg(F.count(F.lit(1)).alias("n"))


def domain_depth_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = _nodes(spark, d).select(urls.get_root_domain(F.lower("url")).alias("domain"), "depth", "scanned")
    return rows.rollup("domain", "depth").agg(F.count(F.lit(1)).alias("n"), F.count_if("scanned").alias("n_scanned"), F.grouping_id().cast("int").alias("level"))


def link_counts(spark: SparkSession, d: str) -> DataFrame:
    return _responses(spark, d).where("html is not null").select("response_id", F.size(extract.hrefs(F.col("html"))).alias("n_links"))


def page_link_pairs(spark: SparkSession, d: str) -> DataFrame:
    pages = _responses(spark, d).where("html is not null").groupBy("url").agg(F.max("html").alias("html"))
    return page_links(pages).groupBy("url", "target").agg(F.count(F.lit(1)).alias("n"))


def page_metadata(spark: SparkSession, d: str) -> DataFrame:
    return _responses(spark, d).where("html is not null").select("response_id", extract.page_metadata(F.col("html")).alias("m")).select("response_id", "m.*")


def page_text_hash(spark: SparkSession, d: str) -> DataFrame:
    return _responses(spark, d).select("response_id", text.content_hash(F.col("html")).alias("hash"))


def contacts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    rows = table(spark, d, "documents").select("doc_id", extract.emails(t).alias("e"), extract.phones(t).alias("p"), extract.prices(t).alias("m"))
    return rows.select("doc_id", F.concat_ws(",", "e").alias("emails"), F.concat_ws(",", "p").alias("phones"), F.concat_ws(",", F.transform("m", lambda x: F.concat_ws("=", x["currency"], x["value"]))).alias("prices"))


def emails(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.concat_ws(",", extract.emails(F.col("text"))).alias("emails"))


def phones(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.concat_ws(",", extract.phones(F.col("text"))).alias("phones"))


def price_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(extract.prices(F.col("text"))).alias("n_prices"))


def challenges(spark: SparkSession, d: str) -> DataFrame:
    rows = _responses(spark, d)
    return rows.groupBy(extract.challenge_kind(F.col("html"), F.col("status_code"), F.col("headers")).alias("challenge"), extract.captcha_kind(F.col("html"))["captcha_type"].alias("captcha")).agg(F.count(F.lit(1)).alias("n"))


def response_flags(spark: SparkSession, d: str) -> DataFrame:
    ok = F.col("error").isNull() & F.col("html").isNotNull()
    return _responses(spark, d).select("response_id", ok.alias("success"), F.coalesce(F.col("status_code").between(200, 299), F.lit(False)).alias("is_2xx"), F.coalesce(F.col("final_url") != F.col("url"), F.lit(False)).alias("redirected"), F.size(F.coalesce("redirect_chain", F.array().cast("array<string>"))).alias("n_hops"), F.coalesce(extract.header(F.col("headers"), "content-type"), F.lit("")).alias("content_type"))


def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    return _responses(spark, d).where("status_code = 200 and error is null").select("response_id", F.md5("url").alias("cache_key"))


def filters(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return _nodes(spark, d).select("node_id", _DOMAIN(u).alias("by_domain"), _PATH(u).alias("by_path"))


def rule_match(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    decision = rules.scan_decision(u, _RULES, _DOMAIN, _PATH)
    return _nodes(spark, d).select("node_id", rules.first_rule(u, _RULES).alias("rule"), rules.priority(u, F.col("priority"), _RULES).alias("priority"), decision["scan"].alias("scan"), decision["follow"].alias("follow"))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """Orders as links from customers to suppliers' parts, in order of time; depths from the keys' own columns."""
    o, i, s = (table(spark, d, t) for t in ("orders", "lineitem", "supplier"))
    rows = i.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.select(
        F.struct(F.col("o_orderdate").cast("string").alias("a"), F.col("l_orderkey").alias("b"), F.col("l_linenumber").alias("c"), F.col("l_partkey").alias("d")).alias("seq"),
        F.concat(F.lit("c"), F.col("o_custkey")).alias("source"),
        F.concat(F.lit("s"), F.col("l_suppkey")).alias("target"),
        F.col("l_linenumber").alias("source_depth"),
        (F.col("s_nationkey") % 7 + 1).cast("int").alias("target_depth"),
    )
    first = rows.groupBy("target").agg(F.min("seq").alias("first"))
    return rows.join(first, "target").withColumn("created", F.col("seq") == F.col("first")).select("seq", "source", "target", "source_depth", "target_depth", "created")


def _strategy(name: str, **more):
    def query(spark: SparkSession, d: str) -> DataFrame:
        kept = apply_edge_strategy(_candidates(spark, d), name, **more)
        return kept.groupBy("target").agg(F.count(F.lit(1)).alias("n_edges"), F.countDistinct("source").alias("n_sources"))

    return query


def link_kinds(spark: SparkSession, d: str) -> DataFrame:
    n = _nodes(spark, d).select("node_id", "url", "depth", "scanned")
    from skein.shared import clean_id

    e = table(spark, d, "edges").select(clean_id(F.col("source_node_id")).alias("s"), clean_id(F.col("target_node_id")).alias("t"))
    rows = e.join(n.select(F.col("node_id").alias("s"), F.col("url").alias("su"), F.col("depth").alias("sd")), "s").join(n.select(F.col("node_id").alias("t"), F.col("url").alias("tu"), F.col("depth").alias("td"), F.col("scanned").alias("ts")), "t")
    return rows.groupBy(F.concat_ws(",", link_kind(F.col("su"), F.col("tu"), F.col("td") - F.col("sd"), F.coalesce("ts", F.lit(False)))).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def crawl_expansion(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "responses").where("html is not null").select("url", "html", "status_code")
    seed = pages.agg(F.min("url")).first()[0]
    g = expand(pages, seed, CrawlPlan(max_depth=2, same_domain=True))
    return g.nodes.groupBy("depth", "scanned").agg(F.count(F.lit(1)).alias("n"))


def _crawl(spark: SparkSession, d: str):
    """Crawl five levels deep over pages that hold the links of the stored graph."""
    from skein.shared import clean_id

    e = table(spark, d, "edges").select(clean_id(F.col("source_node_id")).alias("s"), clean_id(F.col("target_node_id")).alias("t")).where("s is not null and t is not null").distinct()
    at = lambda c: F.concat(F.lit("https://crawl.test/"), c)
    pages = e.groupBy(at(F.col("s")).alias("url")).agg(F.array_join(F.sort_array(F.collect_set(F.concat(F.lit("<a href='/"), "t", F.lit("'>x</a>")))), " ").alias("html"))
    seed = e.agg(at(F.min("s"))).first()[0]
    return expand(pages, seed, CrawlPlan(max_depth=5))


def crawl_levels(spark: SparkSession, d: str) -> DataFrame:
    return _crawl(spark, d).nodes.groupBy("depth", "scanned").agg(F.count(F.lit(1)).alias("n"), F.min("url").alias("first"), F.max("num").alias("last_num"))


def crawl_edges(spark: SparkSession, d: str) -> DataFrame:
    return _crawl(spark, d).edges.groupBy(F.element_at("metadata", "depth_diff").cast("int").alias("depth_diff")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("target_node_id").alias("n_targets"))


def sitemap_links(spark: SparkSession, d: str) -> DataFrame:
    """Sitemaps written from the containment edges' hosts, read back."""
    from skein.functions.urls import get_domain

    locs = _nodes(spark, d).where("url is not null").groupBy(get_domain(F.lower("url")).alias("host")).agg(F.sort_array(F.collect_set(F.concat(F.lit("<url><loc> "), F.replace(F.trim("url"), F.lit("&"), F.lit("&amp;")), F.lit(" </loc></url>")))).alias("l"))
    maps = locs.where("host is not null").select(F.concat(F.lit("https://"), F.col("host"), F.lit("/sitemap.xml")).alias("url"), F.concat(F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), F.array_join("l", ""), F.lit("</urlset>")).alias("xml"))
    return sitemap_edges(maps).groupBy("parent", "child_kind").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (url_functions, domain_histogram, domain_depth_rollup, link_counts, page_link_pairs, page_metadata, page_text_hash, contacts, emails, phones, price_counts, challenges, response_flags, cache_keys, filters, rule_match, link_kinds, crawl_expansion, crawl_levels, crawl_edges, sitemap_links)
} | {
    "edge_strategy_all": _strategy("all"),
    "edge_strategy_new_only": _strategy("new_only"),
    "edge_strategy_max_in_degree": _strategy("max_in_degree", max_in_degree=25),
    "edge_strategy_first_encounter": _strategy("first_encounter_only"),
    "edge_strategy_same_depth": _strategy("same_depth_only"),
    "edge_strategy_deeper": _strategy("deeper_only"),
}

_R = "r AS (SELECT DISTINCT ON (response_id) * FROM responses)"
_DOM = "nullif(regexp_extract({u}, '^[a-zA-Z][a-zA-Z0-9+.\\-]*://([^/?#]*)', 1), '')"


def _dom(u: str) -> str:
    return _DOM.replace("{u}", u)


def _root(u: str) -> str:
    return f"regexp_replace({_dom(u)}, '^www\\.', '')"


def _meta(name: str) -> str:
    return _cut(f"""regexp_extract(html, '(?is)<meta\\s+name=["'']{name}["'']\\s+content=["'']([^"'']*)["'']', 1)""")


def _cut(x: str, most: int = 500) -> str:
    return f"(SELECT CASE WHEN length(v) > {most} THEN v[1:{most}] || '...' ELSE nullif(v, '') END FROM (SELECT trim(regexp_replace({x}, '\\s+', ' ', 'g')) AS v))"


_FILTER_D = f"(SELECT coalesce(x = 'rone-canal.test' OR x LIKE '%.rone-canal.test' OR x = 'dotrite.invalid' OR x LIKE '%.dotrite.invalid', false) AND NOT coalesce(x = 'www.dotrite.invalid' OR x LIKE '%.www.dotrite.invalid', false) FROM (SELECT regexp_replace(lower({_dom('url')}), '^www\\.', '') AS x))"
_PATH_SQL = "regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\\-]*://[^/?#]*([^?#]*)', 1)"
_FILTER_P = f"coalesce(regexp_matches({_PATH_SQL}, '^/[a-z]') AND NOT regexp_matches({_PATH_SQL}, 'sitemaps|\\.xml$'), false)"
_RULE = "CASE WHEN regexp_matches(url, 'sitemap') THEN 0 WHEN regexp_matches(url, '\\.html$') THEN 1 WHEN regexp_matches(url, '[?&]page=') THEN 2 WHEN regexp_matches(url, '/20\\d\\d/') THEN 3 END"
_CAND = "c AS (SELECT (CAST(o_orderdate AS varchar), l_orderkey, l_linenumber, l_partkey) AS seq, 'c' || o_custkey AS source, 's' || l_suppkey AS target, l_linenumber AS source_depth, s_nationkey % 7 + 1 AS target_depth, row_number() OVER (PARTITION BY l_suppkey ORDER BY CAST(o_orderdate AS varchar), l_orderkey, l_linenumber, l_partkey) = 1 AS created FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey)"
_WALK = r"""
e AS (SELECT DISTINCT nullif(lower(regexp_replace(source_node_id, '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g')), '') AS s, nullif(lower(regexp_replace(target_node_id, '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g')), '') AS t FROM edges),
l AS (SELECT * FROM e WHERE s IS NOT NULL AND t IS NOT NULL),
w(node, depth) AS (SELECT min(s), 0 FROM l UNION SELECT l.t, w.depth + 1 FROM w JOIN l ON l.s = w.node WHERE w.depth <= 5),
v AS (SELECT node, min(depth) AS depth FROM w GROUP BY 1)
"""
_KEPT = "SELECT target, count(*) AS n_edges, count(DISTINCT source) AS n_sources FROM {0} GROUP BY 1"



def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_FOUND_PHONES = "list_concat(" * (len(extract.PHONES) - 1) + f"regexp_extract_all(text, {_q(extract.PHONES[0])})" + "".join(f", regexp_extract_all(text, {_q(p)}))" for p in extract.PHONES[1:])
_FOUND_PRICES = "list_concat(" * (len(extract.PRICES) - 1) + f"regexp_extract_all(text, {_q('(?i)' + extract.PRICES[0][0])})" + "".join(f", regexp_extract_all(text, {_q('(?i)' + p)}))" for p, _ in extract.PRICES[1:])
_HREF = """regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*(?:"([^"]*)"|''([^'']*)'')')"""

SQL = {
    "emails": f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, {_q(extract.EMAIL)}), lambda e: lower(e)), lambda e: NOT list_contains({extract.FAKE_DOMAINS}, regexp_extract(e, '@([^@]*)$', 1)) AND NOT regexp_matches(e, '\\.(png|jpg|jpeg|gif|svg|webp|ico)$')))), ',') AS emails FROM documents",
    "phones": f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform({_FOUND_PHONES}, lambda x: regexp_replace(x, '[^0-9+]', '', 'g')), lambda x: length(replace(x, '+', '')) BETWEEN 10 AND 15 AND NOT regexp_matches(replace(x, '+', ''), '^(0+|1+)$')))), ',') AS phones FROM documents",
    "price_counts": f"SELECT doc_id, CAST(len(list_distinct(list_filter(list_transform({_FOUND_PRICES}, lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: length(x) >= 2))) AS integer) AS n_prices FROM documents",
    "page_link_pairs": f"""WITH p AS (SELECT url, max(html) AS html FROM responses WHERE html IS NOT NULL GROUP BY 1), h AS (SELECT url, unnest(list_transform({_HREF}, lambda a: regexp_extract(a, '(?i)href\\s*=\\s*["'']([^"'']*)["'']$', 1))) AS href FROM p),
t AS (SELECT url, regexp_replace(regexp_replace(CASE WHEN href LIKE '/%' THEN regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.\\-]*://[^/?#]*)', 1) || replace(href, '&amp;', '&') ELSE replace(href, '&amp;', '&') END, '(?s)#.*$', ''), '[?;]$', '') AS target FROM h WHERE href <> '' AND NOT regexp_matches(href, '^(mailto:|javascript:|tel:|#|data:)'))
SELECT url, target, count(*) AS n FROM t WHERE regexp_matches(target, '^https?://[^/?#]+') GROUP BY 1, 2""",
    "sitemap_links": f"SELECT 'https://' || host || '/sitemap.xml' AS parent, 'url' AS child_kind, count(DISTINCT u) AS n FROM (SELECT {_dom('lower(url)')} AS host, regexp_replace(url, '^\\s+|\\s+$', '', 'g') AS u FROM nodes) WHERE host IS NOT NULL GROUP BY 1",
    "url_functions": f"SELECT node_id, regexp_replace(regexp_replace(url, '(?s)#.*$', ''), '[?;]$', '') AS normal, {_dom('url')} AS domain, {_root('url')} AS root_domain, coalesce(regexp_matches(url, '^https?://[^/?#]+'), false) AS valid, url AS sanitized FROM nodes",
    "domain_histogram": f"SELECT {_root('lower(url)')} AS domain, count(*) AS n FROM nodes GROUP BY 1",
    "domain_depth_rollup": f"SELECT domain, depth, count(*) AS n, count(*) FILTER (scanned) AS n_scanned, CAST(grouping(domain, depth) AS integer) AS level FROM (SELECT {_root('lower(url)')} AS domain, depth, scanned FROM nodes) GROUP BY ROLLUP (domain, depth)",
    "link_counts": f"""WITH {_R} SELECT response_id, CAST(len(regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*(?:"([^"]*)"|''([^'']*)'')')) AS integer) AS n_links FROM r WHERE html IS NOT NULL""",
    "page_metadata": f"WITH {_R} SELECT response_id, {_cut('regexp_extract(html, ' + chr(39) + '(?is)<title[^>]*>(.*?)</title>' + chr(39) + ', 1)')} AS title, {_meta('description')} AS description, {_meta('keywords')} AS keywords, {_cut('regexp_replace(regexp_extract(html, ' + chr(39) + '(?is)<h1[^>]*>(.*?)</h1>' + chr(39) + ', 1), ' + chr(39) + '<[^>]*>' + chr(39) + ', ' + chr(39) + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')} AS h1 FROM r WHERE html IS NOT NULL",
    "page_text_hash": f"WITH {_R} SELECT response_id, sha256(coalesce(html, '')) AS hash FROM r",
    "response_flags": f"WITH {_R} SELECT response_id, error IS NULL AND html IS NOT NULL AS success, coalesce(status_code BETWEEN 200 AND 299, false) AS is_2xx, coalesce(final_url <> url, false) AS redirected, CAST(coalesce(len(redirect_chain), 0) AS integer) AS n_hops, coalesce(list_filter(map_entries(headers), lambda e: lower(e.key) = 'content-type')[1].value, '') AS content_type FROM r",
    "cache_keys": f"WITH {_R} SELECT response_id, md5(url) AS cache_key FROM r WHERE status_code = 200 AND error IS NULL",
    "challenges": f"""WITH {_R}, h AS (SELECT coalesce(html, '') AS t, coalesce(status_code, 0) AS st, coalesce(lower(list_filter(map_entries(headers), lambda e: lower(e.key) = 'server')[1].value), '') LIKE 'cloudflare%' AS cdn FROM r),
f AS (SELECT *, regexp_matches(t, {_q("(?s)" + extract.CHALLENGE_FORM)}) AS form FROM h),
g AS (SELECT *, form AND st IN (429, 503) AND contains(t, '{extract.CHALLENGE_TRACES[0]}') AS iuam, form AND st = 403 AND regexp_matches(t, {_q(extract.CHALLENGE_TRACES[1])}) AS cap FROM f)
SELECT CASE WHEN NOT cdn THEN 'none' WHEN st = 403 AND contains(t, {_q(extract.FIREWALL_CODE)}) THEN 'firewall_1020' WHEN cap AND regexp_matches(t, {_q(extract.CHALLENGE_SCRIPT.format(kind="(?:captcha|managed)"))}) THEN 'captcha_v2' WHEN cap THEN 'captcha_v1'
  WHEN regexp_matches(t, {_q("(?i)" + "|".join(extract.TURNSTILE))}) THEN 'turnstile' WHEN iuam AND regexp_matches(t, {_q(extract.CHALLENGE_SCRIPT.format(kind="jsch"))}) THEN 'iuam_v2' WHEN iuam THEN 'iuam_v1' ELSE 'none' END AS challenge,
  CASE {" ".join(f"WHEN regexp_matches(t, {_q(p)}) THEN '{n}'" for n, p in extract.CAPTCHAS)} WHEN regexp_matches(lower(t), '{extract.GEETEST}') THEN 'geetest' END AS captcha, count(*) AS n FROM g GROUP BY 1, 2""",
    "filters": f"SELECT node_id, {_FILTER_D} AS by_domain, {_FILTER_P} AS by_path FROM nodes",
    "rule_match": f"SELECT node_id, rule, coalesce(priority, [9, 7, 2, 6][rule + 1], 5) AS priority, scan, CASE WHEN rule = 2 THEN false ELSE scan AND coalesce(CASE rule WHEN 0 THEN true WHEN 3 THEN false END, true) END AS follow FROM (SELECT node_id, priority, rule, coalesce(CASE rule WHEN 0 THEN true WHEN 2 THEN false WHEN 3 THEN true END, d AND p) AS scan FROM (SELECT node_id, priority, {_RULE} AS rule, {_FILTER_D} AS d, {_FILTER_P} AS p FROM nodes))",
    "crawl_levels": f"WITH RECURSIVE {_WALK} SELECT depth, depth <= 5 AS scanned, count(*) AS n, 'https://crawl.test/' || min(node) AS first, CAST(sum(count(*)) OVER (ORDER BY depth) - 1 AS BIGINT) AS last_num FROM v GROUP BY 1",
    "crawl_edges": f"WITH RECURSIVE {_WALK} SELECT CAST(b.depth - a.depth AS INTEGER) AS depth_diff, count(*) AS n, count(DISTINCT l.t) AS n_targets FROM l JOIN v a ON a.node = l.s AND a.depth <= 5 JOIN v b ON b.node = l.t GROUP BY 1",
    "edge_strategy_new_only": f"WITH {_CAND} {_KEPT.format('(SELECT * FROM c WHERE created)')}",
    "edge_strategy_all": f"WITH {_CAND} {_KEPT.format('c')}",
    "edge_strategy_max_in_degree": f"WITH {_CAND}, f AS (SELECT *, CAST(row_number() OVER (PARTITION BY target, source ORDER BY seq) = 1 AS integer) AS first FROM c), k AS (SELECT *, coalesce(sum(first) OVER (PARTITION BY target ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f) {_KEPT.format('(SELECT * FROM k WHERE before < 25)')}",
    "edge_strategy_first_encounter": f"WITH {_CAND} {_KEPT.format('(SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY target ORDER BY seq) = 1)')}",
    "edge_strategy_same_depth": f"WITH {_CAND} {_KEPT.format('(SELECT * FROM c WHERE source_depth = target_depth)')}",
    "edge_strategy_deeper": f"WITH {_CAND} {_KEPT.format('(SELECT * FROM c WHERE source_depth < target_depth)')}",
    "link_kinds": f"WITH e AS (SELECT nullif(lower(regexp_replace(source_node_id, '^[\\s\\x{{a0}}]+|[\\s\\x{{a0}}]+$', '', 'g')), '') AS s, nullif(lower(regexp_replace(target_node_id, '^[\\s\\x{{a0}}]+|[\\s\\x{{a0}}]+$', '', 'g')), '') AS t FROM edges) SELECT CASE WHEN {_dom('a.url')} IS NOT DISTINCT FROM {_dom('b.url')} THEN 'internal' ELSE 'external' END || ',' || CASE WHEN b.depth = a.depth THEN 'same_depth' WHEN b.depth > a.depth THEN 'deeper' ELSE 'back' END || ',' || CASE WHEN b.scanned THEN 'to_scanned' ELSE 'to_unscanned' END AS kind, count(*) AS n FROM e JOIN nodes a ON a.node_id = e.s JOIN nodes b ON b.node_id = e.t GROUP BY 1",
}

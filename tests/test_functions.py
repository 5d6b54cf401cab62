"""Functions, rules, crawl expansion, telemetry folds, search and streams on small inputs."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skein.functions import extract, text, urls
from skein.functions import vectors as V
from skein.functions.text import page_text, visible_text
from skein.functions.rules import DomainFilter, EdgeRule, PathFilter, URLRule, edge_decision, scan_decision
from skein.operators import search, sitemap
from skein.operators import telemetry as T
from skein.operators.expand import CrawlPlan, apply_edge_strategy, expand, page_links
from skein.operators.incremental import crawl_changes, metadata_changed


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("x")).first()["x"]


def test_urls(spark):
    assert one(spark, "http://a.b/x?q=1#top", urls.normalize_url) == "http://a.b/x?q=1"
    assert one(spark, "HTTP://a.b", urls.is_valid_url) is False and one(spark, "http://", urls.is_valid_url) is False and one(spark, None, urls.is_valid_url) is False
    assert one(spark, "http://www.a.b:80/", urls.get_root_domain) == "a.b:80"
    assert one(spark, "ftp://u:p@Host.com:21/x", urls.sanitize_url) == "ftp://***:***@host.com:21/x" and one(spark, "http://a.b/@x", urls.sanitize_url) == "http://a.b/@x"
    assert one(spark, "server=x; Password = top pwd=y", urls.sanitize_connection_string) == "server=x; Password = *** pwd=***"
    safe = lambda u: one(spark, u, urls.is_url_safe)
    assert safe("https://a.b/") and not any(map(safe, ("ftp://a.b", "http://localhost/", "http://10.1.2.3/", "http://192.168.0.1:81/", "http://a.b:6379/", "http://[::1]/", "http://172.20.1.1", None)))
    base = lambda r: one(spark, r, lambda c: urls.make_absolute(F.lit("http://a.b/c/d?x"), c))
    assert [base(r) for r in ("/e", "e", "../e", "//h/e", "?q", "http://z/y", "/x/../y")] == ["http://a.b/e", "http://a.b/c/e", "http://a.b/e", "http://h/e", "http://a.b/c/d?q", "http://z/y", "http://a.b/y"]
    assert one(spark, ["http://a/#x", "bad", "http://a/"], urls.clean_urls, "array<string>") == ["http://a/"]
    assert one(spark, "http://a/?x=1#f", lambda c: urls.add_query_params(c, {"x": "2", "y z": "3"})) == "http://a/?x=1&y+z=3#f"


def test_text_and_extract(spark):
    page = "Mail a@Corp.com, x@example.com, img@2x.png $1,200.50 and $2k call +38 (067) 123-45-67 or 0000000000"
    assert one(spark, page, extract.emails) == ["a@corp.com"] and one(spark, None, extract.emails) == []
    assert one(spark, page, extract.phones) == ["+380671234567", "0671234567"]
    assert [(p["value"], p["currency"]) for p in one(spark, page, extract.prices)] == [("$1,200.50", "USD"), ("$2", "USD"), ("$2k", "USD")]
    assert one(spark, None, text.content_hash) == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert one(spark, " a  <b> ", text.sanitize_text) == "a &lt;b&gt;" and one(spark, "", text.sanitize_text) is None
    assert one(spark, "x" * 600, lambda c: text.sanitize_text(c, 500)) == "x" * 500 + "..."
    html = "<title> T </title><meta name='description' content='D'><h1>A <b>b</b></h1><a href='/x'>y</a><a class=q href=\"z\">z</a>"
    assert one(spark, html, extract.page_metadata).asDict() == {"title": "T", "description": "D", "keywords": None, "h1": "A b"}
    assert one(spark, html, extract.hrefs) == ["/x", "z"] and one(spark, "", extract.hrefs) == []
    cap = lambda h: one(spark, h, extract.captcha_kind)
    assert cap('<div class="g-recaptcha" data-sitekey="k1">')["site_key"] == "k1" and cap("GeeTest here")["captcha_type"] == "geetest" and cap("plain") is None
    form = '<form id="challenge-form" x="challenge-form" action="/a__cf_chl_f_tk=1">'
    kinds = [(403, '<span class="cf-error-code">1020</span>'), (503, "/cdn-cgi/images/trace/jsch/" + form), (403, "/cdn-cgi/images/trace/managed/" + form), (200, "cf-turnstile"), (200, "x")]
    df = spark.createDataFrame([(h, s, {"Server": "Cloudflare-nginx"}) for s, h in kinds] + [("cf-turnstile", 200, {"server": "other"})], "h string, s int, m map<string,string>")
    assert [r[0] for r in df.select(extract.challenge_kind(F.col("h"), F.col("s"), F.col("m"))).collect()] == ["firewall_1020", "iuam_v1", "captcha_v1", "turnstile", "none", "none"]


def test_filters_and_rules(spark):
    table = {"http://example.com/": (1, 0, 1), "http://blog.example.com/": (0, 1, 1), "http://badexample.com/": (0, 0, 0), "http://example.com:8080/": (0, 0, 0)}
    for u, want in table.items():
        got = tuple(int(one(spark, u, DomainFilter("example.com", (k,)))) for k in ("domain", "subdomains", "domain+subdomains"))
        assert got == want, u
    assert one(spark, "http://evil.com/", DomainFilter("example.com", ("*",), ("evil.com",))) is True
    path = PathFilter(include=("^/docs",), exclude=("private",))
    assert one(spark, "http://a/docs/x", path) and not one(spark, "http://a/docs/private", path) and not one(spark, "http://a/blog", path)
    rules = [URLRule("skip", should_scan=False), URLRule("deep", should_scan=True, should_follow_links=False), URLRule("(", should_scan=False), URLRule("open")]
    got = lambda u: tuple(one(spark, u, lambda c: scan_decision(c, rules, DomainFilter("a"), PathFilter())))
    assert got("http://a/skip/deep") == (False, False) and got("http://b/deep") == (True, False) and got("http://a/open") == (True, True) and got("http://b/open") == (False, False)
    edge = lambda u, d: one(spark, u, lambda c: edge_decision(F.lit("http://a/"), c, F.lit(d), [URLRule("never", create_edge=False)], [EdgeRule(target_pattern="http://x", action="skip"), EdgeRule(max_depth_diff=1)], F.lit(False)))
    assert (edge("http://x/never", 0), edge("http://x/", 0), edge("http://y/", 1), edge("http://y/", 3)) == (False, False, True, False)
    with pytest.raises(ValueError):
        URLRule("x", priority=11)


LINKS = {"S": "PQP", "P": "QSR", "Q": "RP", "R": ""}


def crawl(spark, **plan):
    pages = [(f"http://h/{u}", "".join(f'<a href="/{v}">l</a>' for v in vs)) for u, vs in LINKS.items()]
    return expand(spark.createDataFrame(pages, "url string, html string"), "http://h/S", CrawlPlan(**plan))


def test_golden_crawl(spark):
    g = crawl(spark, max_depth=2)
    assert {(r["url"][-1], r["depth"], r["scanned"]) for r in g.nodes.collect()} == {("S", 0, True), ("P", 1, True), ("Q", 1, True), ("R", 2, True)}
    order = [r["source"][-1] + r["target"][-1] for r in g.edges.orderBy("seq").collect()]
    assert order == ["SP", "SQ", "SP", "PQ", "PS", "PR", "QR", "QP"]
    shallow = crawl(spark, max_depth=1)
    assert {(r["url"][-1], r["scanned"]) for r in shallow.nodes.collect()} == {("S", True), ("P", True), ("Q", True), ("R", False)}


def test_markup_as_parsers_read_it(spark):
    links = """<A HREF=/u>1</A><!-- <a href="/no">x</a> --><a class="x>y" data-href='/d' href='/q?a=1&amp;b=2'>2</a><script>'<a href="/s">'</script><a name=t>3</a><a href="">4</a><abbr href="/z">"""
    assert one(spark, links, extract.hrefs) == ["/u", "/q?a=1&b=2", ""]
    meta = """<html lang=en><meta content='b' name="description"><meta name='description' content="c &amp; d"><meta name=keywords content=k><link href="/c" rel=canonical><img alt="a" src=/i.png><iframe src='/f'></iframe>"""
    m = one(spark, meta, extract.page_metadata)
    assert (m["description"], m["keywords"], m["title"]) == ("c & d", "k", None)
    assert one(spark, meta, extract.canonical_url) == "/c" and one(spark, meta, extract.page_language) == "en"
    assert one(spark, meta, lambda c: extract.sources(c, "img")) == ["/i.png"] and one(spark, meta, lambda c: extract.sources(c, "iframe")) == ["/f"]
    assert one(spark, "<p>a &lt; b</p><script>var x</script><!-- no -->", visible_text) == "a < b var x"
    assert one(spark, "<p>a</p><script>var x</script>", lambda c: visible_text(c, scripts=False)) == "a" and len(one(spark, "<p>" + "x" * 20_000, page_text)) == 10_003


def test_articles(spark):
    html = """<title>T</title><meta property="og:title" content="A &amp; B"><meta content="Ann, Bo" name=author><meta property='article:published_time' content='2025-01-02T03:04:05Z'><meta name=keywords content="x; y,"><img src=i.png>"""
    a = one(spark, html, extract.article)
    assert (a["title"], a["authors"], str(a["publish_date"]), a["summary"], a["top_image"], a["keywords"]) == ("A & B", ["Ann", "Bo"], "2025-01-02 03:04:05", None, "i.png", ["x", "y"])
    b = one(spark, None, extract.article)
    assert b["title"] is None and b["authors"] == [] and one(spark, "<meta name=date content=soon>", extract.article)["publish_date"] is None


def test_challenges_and_captchas(spark):
    s = "html string, status int, headers map<string,string>"
    form = '<form id="challenge-form" class="challenge-form" action="/x__cf_chl_f_tk=1">'
    cf = {"Server": "cloudflare"}
    rows = [
        ('<span class="cf-error-code">1020</span>', 403, cf, "firewall_1020"), ("<div class='cf-turnstile'>", 200, cf, "turnstile"), ("/cdn-cgi/images/trace/jsch/" + form, 503, cf, "iuam_v1"),
        ("/cdn-cgi/images/trace/managed/" + form, 403, {"SERVER": "Cloudflare-x"}, "captcha_v1"), ("/cdn-cgi/images/trace/jsch/" + form, 200, cf, "none"), ("<div class='cf-turnstile'>", 200, {}, "none"), (None, 403, None, "none"),
    ]
    df = spark.createDataFrame([(h, st, hd) for h, st, hd, _ in rows], s)
    assert [r[0] for r in df.select(extract.challenge_kind(F.col("html"), F.col("status"), F.col("headers"))).collect()] == [k for *_, k in rows]
    kind = lambda t: one(spark, t, extract.captcha_kind)
    assert tuple(kind('<div class="g-recaptcha" data-sitekey="k1">')) == ("recaptcha_v2", "k1") and tuple(kind("grecaptcha.execute('k2')")) == ("recaptcha_v3", "k2")
    assert tuple(kind('<div class="h-captcha" data-sitekey="k3">')) == ("hcaptcha", "k3") and tuple(kind("<p class=GT-captcha>")) == ("geetest", "") and kind("none") is None


def crawl_pages(spark, width):
    """A seed with many links, whose pages have as many, five levels deep; pages of a level link to the next."""
    rows = [(f"http://h/{d}-{k}", " ".join(f"<a href='/{d + 1}-{j}'>x</a>" for j in range(width))) for d in range(1, 6) for k in range(width)]
    return spark.createDataFrame([("http://h/0", " ".join(f"<a href='/1-{j}'>x</a>" for j in range(width))), *rows], "url string, html string")


@pytest.mark.parametrize("depth", [3, 4, 5])
def test_deep_crawls_number_nodes_densely(spark, depth):
    g = expand(crawl_pages(spark, 13), "http://h/0", CrawlPlan(max_depth=depth))
    got = sorted((r["num"], r["depth"], r["url"]) for r in g.nodes.collect())
    assert [n for n, _, _ in got] == list(range(1 + 13 * (depth + 1)))
    assert [u for _, _, u in got[1:14]] == [f"http://h/1-{j}" for j in range(13)] and [d for _, d, _ in got] == sorted(d for _, d, _ in got)
    assert g.edges.count() == 13 + 169 * depth


def test_redirects_within_a_crawl(spark):
    pages = spark.createDataFrame([("http://h/S", "<a href=/P>p</a><a href=/Q>q</a><a href=/T>t</a>", "http://h/S"), ("http://h/P", "<a href=/R>r</a>", "http://h/Q"), ("http://h/Q", "q", None), ("http://h/T", "t", "http://h/new"), ("http://h/R", "r", "not valid")], "url string, html string, final_url string")
    g = expand(pages, "http://h/S", CrawlPlan(max_depth=2))
    assert {r["url"]: r["num"] for r in g.nodes.collect()} == {"http://h/S": 0, "http://h/Q": 2, "http://h/new": 3, "http://h/R": 4}
    assert sorted((r["source"][-1], r["target"][9:], r["metadata"]["was_redirect"]) for r in g.edges.collect()) == [("Q", "R", "false"), ("S", "Q", "false"), ("S", "Q", "true"), ("S", "new", "true")]
    assert g.nodes.where("content_hash is null").count() == 0


def test_near_pairs_against_brute_force(spark, monkeypatch):
    import numpy as np

    x = np.random.default_rng(4).normal(size=(150, 5))
    x[40:60] = x[:20] + 0.01
    df = spark.createDataFrame([(k, [float(y) for y in v]) for k, v in enumerate(x)] + [(900, None)], "vec_id bigint, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    for eps in (0.02, 0.2):
        want = {(a, b) for a in range(150) for b in range(a + 1, 150) if 1 - u[a] @ u[b] <= eps}
        for rows in (2_000, 10):
            monkeypatch.setattr(search, "ROWS_PER_REGION", rows)
            got = [tuple(r) for r in search.near_pairs(df, eps=eps).collect()]
            assert set(got) == want and len(got) == len(want)


def test_edge_strategies(spark):
    depth = {"S": 0, "P": 1, "Q": 1, "R": 2}
    links = [(k + 1, s, t, depth[s], depth[t], c) for k, (s, t, c) in enumerate([("S", "P", True), ("S", "Q", True), ("S", "P", False), ("P", "Q", False), ("P", "S", False), ("P", "R", True), ("Q", "R", False), ("Q", "P", False)])]
    df = spark.createDataFrame(links, "seq int, source string, target string, source_depth int, target_depth int, created boolean")
    kept = lambda s, **k: sorted(r["seq"] for r in apply_edge_strategy(df, s, **k).collect())
    assert kept("all") == list(range(1, 9)) and kept("new_only") == [1, 2, 6] and kept("first_encounter_only") == [1, 2, 5, 6]
    assert kept("max_in_degree", max_in_degree=1) == [1, 2, 5, 6] and kept("max_in_degree", max_in_degree=2) == list(range(1, 9))
    assert kept("same_depth_only") == [4, 8] and kept("deeper_only") == [1, 2, 3, 6, 7]
    assert kept("max_in_degree", max_in_degree=0) == []
    hub = spark.createDataFrame([(k, f"s{k // 3}", "T", 0, 1, k == 0) for k in range(300)], df.schema)
    for k in (1, 7, 99, 100, 101):
        assert sorted(r["seq"] for r in apply_edge_strategy(hub, "max_in_degree", max_in_degree=k).collect()) == list(range(300 if k > 100 else 3 * (k - 1) + 1 if k <= 100 else 300))
    with pytest.raises(ValueError):
        CrawlPlan(edge_strategy="none")


def test_links_and_sitemaps(spark):
    pages = spark.createDataFrame([("http://h/a/b", '<a href="mailto:x">m</a><a href="c#f">c</a><a href="">e</a><a href="http://z/?a=1&amp;b=2">z</a>'), ("http://h/n", None)], "url string, html string")
    assert [r["target"] for r in page_links(pages).orderBy("pos").collect()] == ["http://h/a/c", "http://z/?a=1&b=2"]
    xml = "<urlset xmlns='x'><url><loc> http://h/1 </loc></url><url><loc><![CDATA[http://h/2]]></loc></url><url><loc></loc></url></urlset>"
    index = "<s:sitemapindex><s:sitemap><s:loc>http://h/s1.xml</s:loc></s:sitemap></s:sitemapindex>"
    df = spark.createDataFrame([("http://h/s1.xml", xml), ("http://h/s2.xml", xml), ("http://h/i.xml", index), ("http://h/bad", "oops"), ("http://h/null", None)], "url string, xml string")
    got = {(r["parent"][-6:], r["child"], r["child_kind"]) for r in sitemap.sitemap_edges(df).collect()}
    assert got == {("s1.xml", "http://h/1", "url"), ("s1.xml", "http://h/2", "url"), ("/i.xml", "http://h/s1.xml", "sitemap")}
    assert sitemap.sitemap_edges(df, max_urls=1).count() == 2
    assert one(spark, "User-agent: *\nSitemap: http://h/s.xml \n sitemap:http://h/t.xml", sitemap.robots_sitemaps) == ["http://h/s.xml", "http://h/t.xml"]
    rob = spark.createDataFrame([("h", "User-agent: *\nDisallow: /no")], "domain string, text string")
    u = spark.createDataFrame([("http://h/no/x", "h"), ("http://h/yes", "h"), ("http://k/no", "k")], "url string, domain string")
    assert {r["url"]: r["allowed"] for r in sitemap.allowed_by_robots(u, rob).collect()} == {"http://h/no/x": False, "http://h/yes": True, "http://k/no": True}


def test_incremental(spark):
    s = "url string, scanned boolean, content_hash string"
    old = spark.createDataFrame([("a", True, "1"), ("b", True, "1"), ("c", True, None)], s)
    new = spark.createDataFrame([("a", True, "1"), ("b", True, "2"), ("c", True, "3"), ("d", True, "4")], s)
    assert {r[0]: r[1] for r in crawl_changes(old, new).collect()} == {"a": "unchanged", "b": "changed", "c": "uncomparable", "d": "new"}
    m = spark.createDataFrame([({"a": "1"}, {"a": "2"}), ({"a": "1"}, {"b": "1"}), ({"a": "1", "b": "2"}, {"a": "1"})], "x map<string,string>, y map<string,string>")
    assert [r[0] for r in m.select(metadata_changed(F.col("x"), F.col("y"))).collect()] == [True, None, False]


def requests(spark, rows):
    t0 = datetime(2025, 1, 1)
    return spark.createDataFrame([(i, t0 + timedelta(seconds=t), k, ok, s, "k", "e") for i, (t, k, ok, s) in enumerate(rows)], "id bigint, ts timestamp_ntz, key bigint, ok boolean, seconds double, kind string, error string")


def test_telemetry(spark):
    dlq = T.dead_letters(requests(spark, [(0, 1, False, 0.1), (5, 1, False, 0.1), (0, 2, False, 1.0), (5, 2, False, 1.0), (20, 2, False, 1.0), (0, 3, False, 1.0), (1, 3, True, 1.0)]))
    got = {r["key"]: (r["attempts"], r["permanent"], r["retry_after"] and r["retry_after"] - r["first_failed"]) for r in dlq.collect()}
    assert got == {1: (2, False, 7.0), 2: (3, True, None)}
    status = spark.createDataFrame([(429,), (503,), (500,)], "s int")
    assert [r[0] for r in status.select(T.retry_delay(F.col("s"), F.lit(2))).collect()] == [12.0, 2.0, 4.0]
    folds = requests(spark, [(i, 1, True, 0.1) for i in range(10)] + [(10 + i, 1, False, None) for i in range(10)])
    delays = [round(r["delay"], 6) for r in T.throttle(folds).orderBy("id").collect()]
    assert delays[8] == 0.5 and delays[9] == 0.4 and delays[19] == 0.6
    waits = [r["wait"] for r in T.token_bucket(requests(spark, [(0, 1, True, 1.0)] * 5), rate=2.0, capacity=4.0).orderBy("id").collect()]
    assert waits == [0, 0, 0, 0, 0.5]
    assert [r["hit"] for r in T.dns_cache(requests(spark, [(0, 1, True, 1.0), (3600, 1, True, 1.0), (3601, 1, True, 1.0)])).orderBy("id").collect()] == [0.0, 1.0, 0.0]
    runs = {r[0]: r[1] for r in T.consecutive_errors(requests(spark, [(0, 1, False, 1.0), (1, 1, False, 1.0), (2, 1, True, 1.0), (3, 1, False, 1.0), (0, 2, True, 1.0)])).collect()}
    assert runs == {1: 2, 2: 0}
    empty = requests(spark, [])
    assert T.crawl_metrics(empty).first()["success_percent"] == 0.0 and T.throttle(empty).count() == 0 and T.dead_letters(empty).count() == 0
    err = spark.createDataFrame([("TimeoutError", "Connection timeout"), ("X", "HTTP 404")], "k string, m string")
    c = T.error_category(F.col("k"), F.col("m"))
    assert [tuple(r) for r in err.select(c, T.error_severity(c, F.col("m")), T.is_retryable(c, F.col("m"))).collect()] == [("network", "medium", True), ("http", "low", False)]


def test_queue(spark):
    s = "id bigint, scan_id string, url string, priority int, status string, created_at timestamp_ntz, processed_at timestamp_ntz"
    t0 = datetime(2025, 1, 1)
    q = spark.createDataFrame([(1, "s", "a", 5, "pending", t0, None), (2, "s", "b", 9, "pending", t0, None), (3, "s", "c", 9, "processing", t0, t0)], s)
    assert [r["id"] for r in T.queue_pop(q, 2).collect()] == [2, 1]
    assert T.queue_reset_stuck(q, F.lit(t0 + timedelta(seconds=301)), 300).where("status = 'pending'").count() == 3
    more = T.queue_push(q, spark.createDataFrame([("s", "a", 1), ("s", "d", 1), ("s", "d", 1)], "scan_id string, url string, priority int"))
    assert T.queue_stats(more).first().asDict() == {"pending": 3, "processing": 1, "done": 0, "failed": 0, "total": 4}


def test_vectors(spark):
    s = "vec_id bigint, embedding array<float>"
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (50, [1.0, 0.0])], s)
    pair = lambda a, b, f: spark.createDataFrame([(a, b)], "a array<float>, b array<float>").select(f(F.col("a"), F.col("b"))).first()[0]
    assert round(pair([1.0, 0.0], [1.0, 1.0], V.cosine_similarity), 5) == 0.70711 and pair([0.0, 0.0], [1.0, 1.0], V.cosine_similarity) == 0.0
    c = pair([0.0, 0.0], [3.0, 4.0], lambda a, b: V.compare(a, b, "euclidean"))
    assert round(c["similarity"], 6) == round(1 / 6, 6) and not c["is_similar"]
    assert one(spark, [1.0], lambda v: V.fitted(v, 3), "array<float>") == [1.0, 0.0, 0.0] and one(spark, None, lambda v: V.fitted(v, 2), "array<float>") == [0.0, 0.0]
    got = [(r["query_id"], r["vec_id"], r["rank"]) for r in search.search(df, df.where("vec_id = 0"), top_k=3).orderBy("rank").collect()]
    assert got == [(0, 0, 1), (0, 50, 2), (0, 1, 3)]
    pts = spark.createDataFrame([(k, [1.0, 0.01 * k]) for k in range(4)] + [(10 + k, [0.01 * k, 1.0]) for k in range(3)] + [(20, [-1.0, -1.0])], s)
    labels = {r[0]: r[1] for r in search.dbscan(pts, eps=0.05).collect()}
    assert {r[0]: r[1] for r in search.dbscan(pts.unionByName(pts), eps=0.05).collect()} == labels
    assert labels == {0: 0, 1: 0, 2: 0, 3: 0, 10: 10, 11: 10, 12: 10, 20: -1}
    ward = {r[0]: r[1] for r in search.ward(pts, 3).collect()}
    assert len({ward[k] for k in range(4)}) == 1 and len(set(ward.values())) == 3
    assert search.kmeans(pts, 3).select("cluster").distinct().count() == 3 and search.kmeans(pts.limit(1), 3).count() == 0


def test_ward_does_not_change_its_method(spark, monkeypatch):
    pts = spark.createDataFrame([(k, [1.0, 0.01 * k]) for k in range(8)], "vec_id bigint, embedding array<float>")
    monkeypatch.setattr(search, "MAX_WARD", 7)
    with pytest.raises(ValueError, match="at most 7"):
        search.ward(pts, 3)
    assert search.ward(pts.limit(7), 3).count() == 7 and search.bisecting(pts, 3).count() == 8

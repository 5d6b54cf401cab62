"""Crawl as graph expansion over a snapshot of pages, level by level.

A level joins the frontier to the pages, takes their links in order, filters
them, and finds the urls not seen before.  The order of discovery is the order
of (source's number, place of the link), so that results do not depend on how
the data is partitioned.  Every level is written to the shared folder.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.extract import hrefs
from skein.functions.rules import DomainFilter, EdgeRule, PathFilter, URLRule, edge_decision, priority, scan_decision
from skein.functions.urls import get_domain, is_special_link, is_valid_url, make_absolute, normalize_url
from skein.functions.text import content_hash, visible_text
from skein.operators.graph import WebGraph
from skein.shared import parts_for, written

#: Parts into which the links of one target are split before they are ranked.
SALTS = 32
#: Targets up to which their bounds are broadcast.
BROADCAST_TARGETS = 200_000

EDGE_STRATEGIES = ("all", "new_only", "max_in_degree", "same_depth_only", "deeper_only", "first_encounter_only")


@dataclass(frozen=True)
class CrawlPlan:
    """What a crawl may do."""

    max_depth: int = 3
    max_pages: int | None = None
    same_domain: bool = True
    url_rules: tuple[URLRule, ...] = ()
    edge_rules: tuple[EdgeRule, ...] = ()
    edge_strategy: str = "all"
    max_in_degree: int = 100
    path: PathFilter = field(default_factory=PathFilter)

    def __post_init__(self) -> None:
        if self.edge_strategy not in EDGE_STRATEGIES:
            raise ValueError(f"unknown edge strategy {self.edge_strategy!r}")


def node_id(url: Column) -> Column:
    return F.sha2(url, 256)


def page_links(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """``(url, pos, target)``: valid links of each page in order, without fragments, repeated ones kept."""
    raw = pages.select(F.col(url).alias("url"), F.posexplode(F.transform(F.filter(hrefs(F.col(html)), lambda h: (h != "") & ~is_special_link(h)), lambda h: F.replace(h, F.lit("&amp;"), F.lit("&")))).alias("pos", "href"))
    return raw.select("url", "pos", normalize_url(make_absolute(F.col("url"), F.col("href"))).alias("target")).where(is_valid_url(F.col("target")))


def link_kind(source: Column, target: Column, depth_diff: Column, target_scanned: Column) -> Column:
    """The three types of a link: by host, by depth, by the state of its target."""
    return F.array(
        F.when(get_domain(source).eqNullSafe(get_domain(target)), "internal").otherwise("external"),
        F.when(depth_diff == 0, "same_depth").when(depth_diff > 0, "deeper").otherwise("back"),
        F.when(target_scanned, "to_scanned").otherwise("to_unscanned"),
    )


def apply_edge_strategy(candidates: DataFrame, strategy: str, *, max_in_degree: int = 100, edge_rules: tuple[EdgeRule, ...] = (), url_rules: tuple[URLRule, ...] = ()) -> DataFrame:
    """Candidates ``(seq, source, target, source_depth, target_depth, created)`` that become edges.

    ``created`` says whether the link made its target known.  ``seq`` orders the
    candidates.  Rules decide first; what they leave open, the strategy.
    """
    diff = F.col("target_depth") - F.col("source_depth")
    df = candidates
    if strategy == "all":
        keep = F.lit(True)
    elif strategy == "new_only":
        keep = F.col("created")
    elif strategy == "same_depth_only":
        keep = diff == 0
    elif strategy == "deeper_only":
        keep = diff > 0
    else:
        # The last place at which a link to the target is still kept: of its first link, or of the first one from its last allowed source.
        if strategy == "first_encounter_only":
            bound = df.groupBy("target").agg(F.min("seq").alias("bound"))
        else:
            firsts = df.groupBy("target", "source").agg(F.min("seq").alias("seq"))
            bound = _kth_smallest(firsts, max(max_in_degree, 0))
        few = bound.limit(BROADCAST_TARGETS + 1).count() <= BROADCAST_TARGETS
        df = df.join(F.broadcast(bound) if few else bound, "target", "left")
        keep = F.lit(False) if strategy == "max_in_degree" and max_in_degree < 1 else F.col("bound").isNull() | (F.col("seq") <= F.col("bound"))
    return df.where(edge_decision(F.col("source"), F.col("target"), diff, list(url_rules), list(edge_rules), keep)).select(*candidates.columns)


def _kth_smallest(firsts: DataFrame, k: int) -> DataFrame:
    """``(target, bound)``: the k-th smallest ``seq`` of the targets that have as many.

    Taken in salted parts first, so that no task sorts all links of one target.
    """
    part = F.pmod(F.xxhash64("source"), F.lit(SALTS)).alias("part")
    least = firsts.select("target", "seq", part).withColumn("k", F.row_number().over(Window.partitionBy("target", "part").orderBy("seq"))).where(F.col("k") <= k)
    nth = least.withColumn("k", F.row_number().over(Window.partitionBy("target").orderBy("seq"))).where(F.col("k") <= k)
    return nth.where(F.col("k") == k).select("target", F.col("seq").alias("bound"))


def _numbered(fresh: DataFrame, total: int) -> DataFrame:
    """``(url, depth, num)``: numbers from ``total`` on, dense, in the order of ``seq``."""
    n = parts_for(fresh.count())
    placed = written(fresh.repartitionByRange(n, "seq").sortWithinPartitions("seq").withColumn("at", F.monotonically_increasing_id()), "ordered")
    # The upper bits are the number of the range, the lower ones the row within it.
    part, row = F.shiftrightunsigned("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    ahead = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    return placed.withColumn("part", part).join(F.broadcast(ahead), "part").select("url", "depth", (F.lit(total) + F.col("ahead") + row).cast("long").alias("num"))


def _follow_redirects(nodes: DataFrame, candidates: DataFrame, moved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and links after redirects ``(url, final)``: a page stands at its final address.

    If that address is a node itself, it takes the links of the redirected one;
    of several pages with one new address the first discovered stays.
    """
    nodes = nodes.drop("final")
    to = nodes.join(moved, "url", "left").withColumn("own", F.col("final").isNull()).withColumn("url", F.coalesce("final", "url")).drop("final")
    rest = [c for c in to.columns if c not in ("url", "own")]
    kept = to.groupBy("url").agg(F.min(F.struct((~F.col("own")).alias("moved"), F.col("num").alias("first"), *[F.col(c) for c in rest])).alias("m")).select("url", *[F.col(f"m.{c}").alias(c) for c in rest])
    for side in ("source", "target"):
        candidates = candidates.join(moved.select(F.col("url").alias(side), F.col("final").alias(f"{side}_final")), side, "left").withColumn(side, F.coalesce(f"{side}_final", side))
    marked = candidates.withColumn("redirected", F.col("target_final").isNotNull()).drop("source_final", "target_final")
    return kept.select(*nodes.columns), marked


def expand(pages: DataFrame, seed: str, plan: CrawlPlan = CrawlPlan()) -> WebGraph:
    """Graph of the crawl from ``seed`` over ``pages(url, html[, status_code, final_url])``.

    Nodes one level below ``max_depth`` exist but are not scanned.  Within a
    level pages are taken by priority, then by discovery; priorities do not
    reach across levels.  A page without html is scanned and has no links.  Of
    several rows of a page the one with the longest html counts.  A page with
    another ``final_url`` is a node at that address; links to it are marked with
    ``was_redirect``.  ``content_hash`` is of the visible text of scanned pages.
    """
    spark = pages.sparkSession
    has_status = "status_code" in pages.columns
    final = F.when(is_valid_url(F.col("final_url")), normalize_url(F.col("final_url"))) if "final_url" in pages.columns else F.lit(None).cast("string")
    snapshot = pages.select(normalize_url(F.col("url")).alias("url"), "html", (F.col("status_code") if has_status else F.lit(200)).cast("int").alias("status"), final.alias("final")).groupBy("url").agg(F.max(F.struct(F.length("html"), "html", "status", "final")).alias("m")).select("url", "m.html", "m.status", "m.final")
    base = spark.range(1).select(get_domain(F.lit(seed)).alias("d")).first()["d"] or ""
    domain = DomainFilter(base.removeprefix("www."), ("domain+subdomains",) if plan.same_domain else ("*",))
    rules = list(plan.url_rules)

    front = written(spark.createDataFrame([(seed, 0, 0)], "url string, depth int, num bigint"), "front")
    unread = [F.lit(False).alias("scanned"), F.lit(None).cast("int").alias("status"), F.lit(None).cast("string").alias("content_hash"), F.lit(None).cast("string").alias("final")]
    nodes = front.select("*", *unread).limit(0)
    candidates = None
    known, total, scanned = front, 1, 0
    for depth in range(plan.max_depth + 1):
        ranked = front.withColumn("p", priority(F.col("url"), F.lit(None).cast("int"), rules))
        if plan.max_pages is not None:
            todo = ranked.orderBy(F.desc("p"), "num").limit(max(0, plan.max_pages - scanned))
        else:
            todo = ranked
        fetched = written(todo.join(snapshot, "url", "left").select("url", "depth", "num", "html", "status", "final", F.lit(True).alias("scanned"), content_hash(visible_text(F.col("html"))).alias("content_hash")), "fetched")
        scanned += fetched.count()
        waiting = front.join(fetched.select("url"), "url", "left_anti").select("url", "depth", "num", *unread)
        nodes = nodes.unionByName(fetched.select(*nodes.columns)).unionByName(waiting)
        links = page_links(fetched.where(F.col("html").isNotNull())).join(fetched.select("url", "num", "depth"), "url")
        allowed = links.withColumn("d", scan_decision(F.col("target"), rules, domain, plan.path)).where("d.scan").select(F.col("url").alias("source"), "target", F.col("depth").alias("source_depth"), "num", "pos")
        allowed = written(allowed.join(known.select(F.col("url").alias("target"), F.col("depth").alias("known_depth")), "target", "left"), "links")
        first = Window.partitionBy("target").orderBy("num", "pos")
        seen = allowed.withColumn("created", F.col("known_depth").isNull() & (F.row_number().over(first) == 1)).withColumn("target_depth", F.coalesce("known_depth", F.lit(depth + 1)))
        seen = written(seen.select(F.struct(F.lit(depth).alias("level"), "num", "pos").alias("seq"), "source", "target", "source_depth", "target_depth", "created"), "candidates")
        candidates = seen if candidates is None else candidates.unionByName(seen)
        fresh = seen.where("created").select(F.col("target").alias("url"), F.lit(depth + 1).alias("depth"), "seq")
        n = fresh.count()
        if not n:
            front = front.limit(0)
            break
        front = written(_numbered(fresh, total), "front")
        total += n
        known = known.unionByName(front)
    nodes = nodes.unionByName(front.join(nodes.select("url"), "url", "left_anti").select("url", "depth", "num", *unread))
    candidates = candidates.withColumn("redirected", F.lit(False))
    if "final_url" in pages.columns:
        moved = written(nodes.where(F.col("final").isNotNull() & (F.col("final") != F.col("url"))).select("url", "final"), "moved")
        nodes, candidates = _follow_redirects(nodes, candidates.drop("redirected"), moved)
    edges = apply_edge_strategy(candidates, plan.edge_strategy, max_in_degree=plan.max_in_degree, edge_rules=plan.edge_rules, url_rules=plan.url_rules)
    marks = nodes.select(F.col("url").alias("target"), F.col("scanned").alias("t"))
    edges = edges.join(marks, "target", "left")
    diff = F.col("target_depth") - F.col("source_depth")
    meta = F.map_from_arrays(F.array(*map(F.lit, ("depth_diff", "target_scanned", "link_type", "was_redirect"))), F.array(diff.cast("string"), F.col("t").cast("string"), F.to_json(link_kind(F.col("source"), F.col("target"), diff, F.coalesce("t", F.lit(False)))), F.col("redirected").cast("string")))
    out_edges = edges.select(F.sha2(F.concat_ws(" ", "source", "target", F.col("seq").cast("string")), 256).alias("edge_id"), node_id(F.col("source")).alias("source_node_id"), node_id(F.col("target")).alias("target_node_id"), meta.alias("metadata"), F.lit(None).cast("timestamp_ntz").alias("created_at"), "source", "target", "seq")
    out_nodes = nodes.select(
        node_id(F.col("url")).alias("node_id"), "url", "depth", "scanned", F.lit(True).alias("should_scan"), F.lit(True).alias("can_create_edges"), F.lit(None).cast("map<string,string>").alias("metadata"), F.lit(None).cast("map<string,string>").alias("user_data"),
        F.col("status").alias("response_status"), "content_hash", F.lit(None).cast("int").alias("priority"), F.lit(None).cast("timestamp_ntz").alias("created_at"), F.when(F.col("scanned"), "html_stage").otherwise("url_stage").alias("lifecycle_stage"), "num",
    )
    return WebGraph(out_nodes, out_edges)

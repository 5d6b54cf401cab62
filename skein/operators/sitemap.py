"""Sitemaps and robots files to urls and containment edges."""

from __future__ import annotations

import urllib.robotparser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def robots_sitemaps(text: Column) -> Column:
    """Addresses of the ``Sitemap:`` lines of a robots file."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?im)^[ \t]*sitemap[ \t]*:[ \t]*(\S+)"), F.lit(1)), F.trim)


def sitemap_kind(xml: Column) -> Column:
    """``sitemapindex``, ``urlset`` or null, from the root element."""
    return F.nullif(F.lower(F.regexp_extract(xml, r"(?is)<(?:\w+:)?(sitemapindex|urlset)[\s>]", 1)), F.lit(""))


def sitemap_locations(xml: Column) -> Column:
    """Texts of the loc elements in order, with or without a namespace, trimmed, none empty."""
    loc = F.regexp_extract_all(F.coalesce(xml, F.lit("")), F.lit(r"(?is)<(?:\w+:)?loc\s*>\s*(.*?)\s*</(?:\w+:)?loc\s*>"), F.lit(1))
    bare = F.transform(loc, lambda x: F.replace(F.trim(F.regexp_replace(x, r"(?s)^<!\[CDATA\[(.*)\]\]>$", "$1")), F.lit("&amp;"), F.lit("&")))
    return F.filter(bare, lambda x: x != "")


def sitemap_edges(sitemaps: DataFrame, *, max_urls: int | None = None) -> DataFrame:
    """``(parent, child, child_kind, pos)`` from ``sitemaps(url, xml)``; of a repeated child the first parent counts.

    ``max_urls`` limits the urls of each sitemap (in document order), which is
    the feature of the same name.
    """
    rows = sitemaps.select("url", sitemap_kind(F.col("xml")).alias("kind"), F.posexplode(sitemap_locations(F.col("xml"))).alias("pos", "child")).where(F.col("kind").isNotNull())
    if max_urls is not None:
        rows = rows.where((F.col("kind") != "urlset") | (F.col("pos") < max_urls))
    first = rows.groupBy("child").agg(F.min(F.struct("url", "pos", "kind")).alias("m"))
    return first.select(F.col("m.url").alias("parent"), "child", F.when(F.col("m.kind") == "sitemapindex", "sitemap").otherwise("url").alias("child_kind"), F.col("m.pos").alias("pos"))


def allowed_by_robots(urls: DataFrame, robots: DataFrame, agent: str = "*") -> DataFrame:
    """``urls(url, domain)`` with ``allowed``, by ``robots(domain, text)``; a domain without a file allows all."""

    @F.pandas_udf("boolean")
    def can_fetch(text: pd.Series, url: pd.Series) -> pd.Series:
        parsers: dict[str, urllib.robotparser.RobotFileParser] = {}
        out = []
        for t, u in zip(text, url):
            if t is None or u is None:
                out.append(True)
                continue
            if t not in parsers:
                parsers[t] = urllib.robotparser.RobotFileParser()
                parsers[t].parse(t.splitlines())
            out.append(parsers[t].can_fetch(agent, u))
        return pd.Series(out)

    one = robots.groupBy("domain").agg(F.max("text").alias("text"))
    return urls.join(one, "domain", "left").withColumn("allowed", can_fetch("text", "url")).drop("text")


def is_gzipped(url: Column, kind: Column) -> Column:
    return F.coalesce(kind == "xml.gz", F.lit(False)) | F.coalesce(url.endswith(".gz"), F.lit(False))


def first_discovery(links: DataFrame) -> DataFrame:
    """First link to each target by ``seq``."""
    return links.withColumn("rn", F.row_number().over(Window.partitionBy("target").orderBy("seq"))).where("rn = 1").drop("rn")

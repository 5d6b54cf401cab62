"""Text functions and content hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Longest metadata texts.
MAX_TITLE, MAX_DESCRIPTION, MAX_KEYWORDS, MAX_H1, MAX_TEXT = 500, 1000, 500, 500, 10_000


def clean_text(c: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def truncated(c: Column, most: int) -> Column:
    """At most ``most`` characters, then three dots."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def sanitize_text(c: Column, most: int = MAX_TITLE, escape: bool = True) -> Column:
    """HTML-escaped if wanted, collapsed, cut; empty text gives null when escaping, else ``''``."""
    t = c
    if escape:
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
            t = F.replace(t, F.lit(a), F.lit(b))
    t = truncated(clean_text(t), most)
    return F.when(F.coalesce(c, F.lit("")) != "", t) if escape else F.coalesce(t, F.lit(""))


def content_hash(text: Column, stage: Column | None = None) -> Column:
    """sha256 of the text (null as empty); null outside the html stage, if a stage is given."""
    h = F.sha2(F.coalesce(text, F.lit("")), 256)
    return h if stage is None else F.when(stage == "html_stage", h)


def unescaped(c: Column) -> Column:
    """Character references of the markup signs, of quotes and of the hard blank decoded."""
    for names, sign in ((("&lt;", "&#60;", "&#x3c;"), "<"), (("&gt;", "&#62;", "&#x3e;"), ">"), (("&quot;", "&#34;", "&#x22;"), '"'), (("&apos;", "&#39;", "&#x27;"), "'"), (("&nbsp;", "&#160;", "&#xa0;"), "\u00a0"), (("&amp;", "&#38;", "&#x26;"), "&")):
        for name in names:
            c = F.replace(c, F.lit(name), F.lit(sign))
    return c


def visible_text(html: Column, scripts: bool = True) -> Column:
    """Text of the markup without tags and comments, collapsed; ``scripts`` says whether that of scripts and styles counts."""
    t = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    if not scripts:
        t = F.regexp_replace(t, r"(?is)<(script|style)\b.*?</(script|style)\s*>", " ")
    return clean_text(unescaped(F.regexp_replace(t, r"(?s)<[a-zA-Z/!?][^>]*>", " ")))


def page_text(html: Column) -> Column:
    """Visible text, cut at ``MAX_TEXT`` characters."""
    return truncated(visible_text(html), MAX_TEXT)

"""Extraction from page source: links, metadata, e-mail, phone, price, challenges.

All built from regular expressions that mean the same in Java and RE2, so that
nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.text import MAX_DESCRIPTION, MAX_H1, MAX_KEYWORDS, MAX_TITLE, clean_text, truncated, unescaped

# --- fixed values: patterns and lists of the extractors -------------------------------------------
EMAIL = r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b"
FAKE_DOMAINS = ["example.com", "example.org", "example.net", "test.com", "test.org", "test.net", "localhost", "127.0.0.1", "domain.com", "email.com", "yoursite.com", "yourdomain.com"]
IMAGE_ENDINGS = [".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".ico"]
PHONES = [
    r"\+?3?8?\s?\(?\d{3}\)?\s?\d{3}[-\s]?\d{2}[-\s]?\d{2}",
    r"\+?7?\s?\(?\d{3}\)?\s?\d{3}[-\s]?\d{2}[-\s]?\d{2}",
    r"\+?1?\s?\(?\d{3}\)?\s?\d{3}[-\s]?\d{4}",
    r"\+\d{1,3}\s?\(?\d{1,4}\)?\s?\d{1,4}[-\s]?\d{1,4}[-\s]?\d{1,9}",
    r"tel:\+?\d+",
]
PRICES = [
    (r"\$\s?\d{1,3}(?:,\d{3})*(?:\.\d{2})?", "USD"),
    (r"\$\s?\d+(?:\.\d+)?[kKmMbB]", "USD"),
    (r"\d+(?:\.\d+)?\s?USD", "USD"),
    (r"€\s?\d{1,3}(?:,\d{3})*(?:\.\d{2})?", "EUR"),
    (r"\d{1,3}(?:,\d{3})*(?:\.\d{2})?\s?€", "EUR"),
    (r"\d+\s?EUR", "EUR"),
    (r"₴\s?\d{1,3}(?:,\d{3})*", "UAH"),
    (r"\d{1,3}(?:\s?\d{3})*\s?(?:грн|гривень|гривні)", "UAH"),
    (r"від\s+\d+(?:\s?\d{3})*\s?(?:грн|гривень)", "UAH_RANGE"),
    (r"до\s+\d+(?:\s?\d{3})*\s?(?:грн|гривень)", "UAH_RANGE"),
    (r"\$\s?\d+[kK]?\s*[-–—]\s*\$?\s?\d+[kK]?", "USD_RANGE"),
    (r"\d+[kK]?\s*[-–—]\s*\d+[kK]?\s*(?:USD|dollars?)", "USD_RANGE"),
]
CHALLENGE_FORM = r'<form .*?="challenge-form" action="/\S+__cf_chl_f_tk='
CHALLENGE_SCRIPT = r"""cpo.src\s*=\s*['"/]cdn-cgi/challenge-platform/\S+orchestrate/{kind}/v1"""
CHALLENGE_TRACES = ("/cdn-cgi/images/trace/jsch/", "/cdn-cgi/images/trace/(?:captcha|managed)/")
FIREWALL_CODE = '<span class="cf-error-code">1020</span>'
CAPTCHAS = [
    ("recaptcha_v2", r"""(?i)g-recaptcha["\s]+.*?data-sitekey=["']([^"']+)"""),
    ("recaptcha_v3", r"""grecaptcha\.execute\(["']([^"']+)["']"""),
    ("hcaptcha", r"""(?i)h-captcha["\s]+.*?data-sitekey=["']([^"']+)"""),
    ("funcaptcha", r"""(?is)data-callback=["']setupCaptcha["'].*?data-public-key=["']([^"']+)"""),
]
GEETEST = "geetest|gt-captcha"
TURNSTILE = [r"challenges\.cloudflare\.com/turnstile", "cf-turnstile", r"data-sitekey.*turnstile", r"turnstile/v0/api\.js"]
# --- end of fixed values --------------------------------------------------------------------------


def all_matches(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def emails(c: Column) -> Column:
    """Valid addresses in lower case, each once, sorted; none for null."""
    low = F.transform(all_matches(F.coalesce(c, F.lit("")), EMAIL), F.lower)
    domain = lambda e: F.regexp_extract(e, r"@([^@]*)$", 1)
    ok = lambda e: ~domain(e).isin(*FAKE_DOMAINS) & ~e.rlike("(?:" + "|".join(x.replace(".", r"\.") for x in IMAGE_ENDINGS) + ")$")
    return F.array_sort(F.array_distinct(F.filter(low, ok)))


def phones(c: Column) -> Column:
    """Numbers of 10 to 15 digits, digits and ``+`` only, not all zeros or ones; each once, sorted."""
    found = F.flatten(F.array(*[all_matches(F.coalesce(c, F.lit("")), p) for p in PHONES]))
    bare = F.transform(found, lambda x: F.regexp_replace(x, r"[^\d+]", ""))
    digits = lambda x: F.replace(x, F.lit("+"), F.lit(""))
    return F.array_sort(F.array_distinct(F.filter(bare, lambda x: F.length(digits(x)).between(10, 15) & ~digits(x).rlike("^(?:0+|1+)$"))))


def prices(c: Column) -> Column:
    """``array<struct<value, currency, original>>`` in order of pattern and place, each value once."""
    text = F.coalesce(c, F.lit(""))
    found = lambda currency: lambda x: F.struct(F.trim(F.regexp_replace(x, r"\s+", " ")).alias("value"), F.lit(currency).alias("currency"), x.alias("original"))
    per = [F.transform(all_matches(text, "(?i)" + p), found(currency)) for p, currency in PRICES]
    every = F.filter(F.flatten(F.array(*per)), lambda s: F.length(s["value"]) >= 2)
    return F.filter(every, lambda s, i: F.array_position(F.transform(every, lambda t: t["value"]), s["value"]) == i + 1)


def _markup(html: Column) -> Column:
    """Markup whose tags are elements: without comments, scripts and styles."""
    t = F.coalesce(html, F.lit(""))
    return F.regexp_replace(t, r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>", " ")


def _tags(html: Column, name: str) -> Column:
    """Opening tags of an element, whole, in order."""
    return F.regexp_extract_all(_markup(html), F.lit(rf"""(?is)<{name}\s(?:[^>"']|"[^"]*"|'[^']*')*>"""), F.lit(0))


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of a tag, quoted or not, decoded; null if the tag has none."""
    pattern = rf"""(?is)^<[a-z0-9]+(?:\s+(?!{name}[\s=])[^\s=>"'/]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]*))?|\s*/)*\s+{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.when(tag.rlike(pattern), unescaped(F.concat(*[F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)])))


def hrefs(html: Column) -> Column:
    """Values of href of all anchors that have one, in order, repeated ones kept."""
    return F.filter(F.transform(_tags(html, "a"), lambda t: attribute(t, "href")), lambda h: h.isNotNull())


def sources(html: Column, element: str) -> Column:
    """Values of src of all ``img`` or ``iframe`` elements, in order."""
    return F.filter(F.transform(_tags(html, element), lambda t: attribute(t, "src")), lambda h: h.isNotNull() & (h != ""))


def page_title(html: Column) -> Column:
    t = clean_text(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    return F.when(t != "", truncated(t, MAX_TITLE))


def page_h1(html: Column) -> Column:
    """Text of the first h1, tags inside taken out."""
    t = clean_text(F.regexp_replace(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1), r"<[^>]*>", ""))
    return F.when(t != "", truncated(t, MAX_H1))


def meta_content(html: Column, name: str, most: int) -> Column:
    """Content of the last meta element of a name, whatever the order of its attributes."""
    named = F.filter(_tags(html, "meta"), lambda t: attribute(t, "name") == name)
    t = clean_text(attribute(F.get(named, F.size(named) - 1), "content"))
    return F.when(t != "", truncated(t, most))


def canonical_url(html: Column) -> Column:
    """Address of the first canonical link element; null if there is none."""
    return attribute(F.get(F.filter(_tags(html, "link"), lambda t: F.lower(attribute(t, "rel")) == "canonical"), F.lit(0)), "href")


def page_language(html: Column) -> Column:
    """Language of the html element; null if it has none."""
    return F.nullif(attribute(F.get(_tags(html, "html"), F.lit(0)), "lang"), F.lit(""))


def meta_property(html: Column, name: str) -> Column:
    """Content of the first meta element whose name or property is ``name``, without letter case; null if blank."""
    named = F.filter(_tags(html, "meta"), lambda t: F.lower(F.coalesce(attribute(t, "property"), attribute(t, "name"))) == name)
    t = clean_text(attribute(F.get(named, F.lit(0)), "content"))
    return F.when(t != "", t)


def article(html: Column) -> Column:
    """Struct of an article's title, authors, publish_date, summary, top_image and keywords, from its metadata; null where absent."""
    listed = lambda c: F.filter(F.transform(F.split(c, r"\s*[,;]\s*"), F.trim), lambda x: x != "")
    when = F.coalesce(meta_property(html, "article:published_time"), meta_property(html, "date"), attribute(F.get(_tags(html, "time"), F.lit(0)), "datetime"))
    return F.struct(
        F.coalesce(meta_property(html, "og:title"), page_title(html)).alias("title"),
        F.coalesce(listed(F.coalesce(meta_property(html, "author"), meta_property(html, "article:author"))), F.array().cast("array<string>")).alias("authors"),
        when.try_cast("timestamp").alias("publish_date"),
        F.coalesce(meta_property(html, "og:description"), meta_content(html, "description", MAX_DESCRIPTION)).alias("summary"),
        F.coalesce(meta_property(html, "og:image"), F.get(sources(html, "img"), F.lit(0))).alias("top_image"),
        F.coalesce(listed(meta_property(html, "keywords")), F.array().cast("array<string>")).alias("keywords"),
    )


def page_metadata(html: Column) -> Column:
    """Struct of title, description, keywords and h1; null where absent."""
    return F.struct(page_title(html).alias("title"), meta_content(html, "description", MAX_DESCRIPTION).alias("description"), meta_content(html, "keywords", MAX_KEYWORDS).alias("keywords"), page_h1(html).alias("h1"))


def header(headers: Column, name: str) -> Column:
    """Value of a header whatever the case of its name."""
    return F.get(F.map_values(F.map_filter(headers, lambda k, v: F.lower(k) == name)), F.lit(0))


def challenge_kind(html: Column, status: Column, headers: Column) -> Column:
    """Kind of a bot challenge, ``none`` if there is none; only of servers that name the CDN."""
    text = F.coalesce(html, F.lit(""))
    form = text.rlike("(?ms)" + CHALLENGE_FORM)
    iuam = status.isin(429, 503) & text.contains(CHALLENGE_TRACES[0]) & form
    captcha = (status == 403) & text.rlike(CHALLENGE_TRACES[1]) & form
    v2 = lambda kind: text.rlike(CHALLENGE_SCRIPT.format(kind=kind))
    kind = (
        F.when((status == 403) & text.contains(FIREWALL_CODE), "firewall_1020")
        .when(captcha & v2("(?:captcha|managed)"), "captcha_v2")
        .when(captcha, "captcha_v1")
        .when(text.rlike("(?i)" + "|".join(TURNSTILE)), "turnstile")
        .when(iuam & v2("jsch"), "iuam_v2")
        .when(iuam, "iuam_v1")
        .otherwise("none")
    )
    return F.when(F.coalesce(F.lower(header(headers, "server")).startswith("cloudflare"), F.lit(False)), kind).otherwise("none")


def captcha_kind(html: Column) -> Column:
    """Struct of captcha type and site key, null if there is none."""
    text = F.coalesce(html, F.lit(""))
    out = None
    for name, pattern in CAPTCHAS:
        hit = F.struct(F.lit(name).alias("captcha_type"), F.regexp_extract(text, pattern, 1).alias("site_key"))
        out = F.when(text.rlike(pattern), hit) if out is None else out.when(text.rlike(pattern), hit)
    return out.when(F.lower(text).rlike(GEETEST), F.struct(F.lit("geetest").alias("captcha_type"), F.lit("").alias("site_key")))

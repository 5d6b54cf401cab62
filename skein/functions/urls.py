"""URL functions as Column expressions; only joining a relative reference needs Python."""

from __future__ import annotations

import ipaddress
from functools import lru_cache
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

# What may not be fetched.
BLOCKED_HOSTS = ["localhost", "127.0.0.1", "0.0.0.0", "169.254.169.254", "169.254.169.253", "::1", "[::1]", "metadata.google.internal", "metadata.goog"]
BLOCKED_PORTS = [22, 23, 25, 3306, 5432, 6379, 27017, 9200, 11211]
SPECIAL_LINKS = ["mailto:", "javascript:", "tel:", "#", "data:"]


def normalize_url(url: Column) -> Column:
    """URL without its fragment; an emptied query or parameter mark goes too."""
    return F.regexp_replace(F.regexp_replace(url, r"(?s)#.*$", ""), r"[?;]$", "")


def get_domain(url: Column) -> Column:
    """Network location with port and user, null if there is none."""
    return F.nullif(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1), F.lit(""))


def get_root_domain(url: Column) -> Column:
    """Domain without a leading ``www.``."""
    return F.regexp_replace(get_domain(url), r"^www\.", "")


def is_valid_url(url: Column) -> Column:
    """Begins with http:// or https:// (case-sensitive) and has a host; null counts as invalid."""
    return F.coalesce(url.rlike(r"^https?://[^/?#]+"), F.lit(False))


def is_special_link(href: Column) -> Column:
    return href.rlike("^(?:" + "|".join(SPECIAL_LINKS) + ")")


def clean_urls(urls: Column) -> Column:
    """Valid ones of an array, normalised, each once, in order."""
    return F.array_distinct(F.transform(F.filter(urls, is_valid_url), normalize_url))


def sanitize_url(url: Column, mask: str = "***") -> Column:
    """Credentials masked, host in lower case if there were any."""
    head = F.regexp_extract(url, r"^([^:/?#]+://)[^/?#]*@", 1)
    host = F.lower(F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*@([^/?#]*)", 1))
    return F.when(url.rlike(r"^[^:/?#]+://[^/?#@]+@|^[^:/?#]+://[^/?#]*:[^/?#]*@"), F.concat(head, F.lit(f"{mask}:{mask}@"), host, F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*(.*)$", 1))).otherwise(url)


def sanitize_connection_string(text: Column) -> Column:
    masked = F.regexp_replace(F.regexp_replace(text, r"(?i)(password\s*=\s*)([^\s]+)", "$1***"), r"(?i)(pwd\s*=\s*)([^\s]+)", "$1***")
    return F.when(F.instr(text, "://") > 0, sanitize_url(text)).otherwise(masked)


def host_of(url: Column) -> Column:
    """Host without user and port, lower case."""
    return F.nullif(F.lower(F.regexp_extract(get_domain(url), r"^(?:[^@]*@)?(\[[^\]]*\]|[^:]*)", 1)), F.lit(""))


def port_of(url: Column) -> Column:
    return F.regexp_extract(get_domain(url), r":(\d{1,5})$", 1).try_cast("int")


@lru_cache(maxsize=100_000)
def _private(host: str) -> bool:
    try:
        ip = ipaddress.ip_address(host.strip("[]"))
    except ValueError:
        return False
    return ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_multicast or ip.is_reserved or ip.is_unspecified


@F.pandas_udf(BooleanType())
def _private_v6(hosts: pd.Series) -> pd.Series:
    return hosts.map(lambda h: h is not None and _private(h))


def is_private_v4(host: Column) -> Column:
    """Private, loopback, link-local, reserved or multicast IPv4 address, by its octets."""
    o = [F.regexp_extract(host, r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", k).try_cast("int") for k in (1, 2)]
    a, b = o
    return F.coalesce(a.isin(0, 10, 127) | (a >= 224) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)), F.lit(False))


def is_url_safe(url: Column, python_v6: bool = True) -> Column:
    """http(s), a host that is not blocked nor private, and a port that is not blocked."""
    host, port = host_of(url), port_of(url)
    v6 = F.when(F.instr(host, "[") > 0, _private_v6(host) if python_v6 else F.lit(True)).otherwise(False)
    return F.coalesce(url.rlike(r"(?i)^https?://") & host.isNotNull() & ~host.isin(*BLOCKED_HOSTS) & ~is_private_v4(host) & ~v6 & ~F.coalesce(port.isin(*BLOCKED_PORTS), F.lit(False)), F.lit(False))


@F.pandas_udf(StringType())
def _urljoin(base: pd.Series, ref: pd.Series) -> pd.Series:
    out = []
    for b, r in zip(base, ref):
        try:
            out.append(None if r is None else urljoin(b or "", r))
        except ValueError:
            out.append(None)
    return pd.Series(out)


def make_absolute(base: Column, ref: Column) -> Column:
    """Reference resolved against a base.

    Absolute and root-relative references without dot segments stay in the JVM;
    the rest goes through ``urljoin``.
    """
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1)
    plain = ~F.coalesce(ref.rlike(r"/\.{1,2}(?:[/?#]|$)"), F.lit(False))
    return F.when(ref.rlike(r"^https?://[^/?#]+/") & plain, ref).when(ref.rlike(r"^/(?!/)") & plain & (origin != ""), F.concat(origin, ref)).otherwise(_urljoin(base, ref))


def add_query_params(url: Column, params: dict[str, str]) -> Column:
    """Adds the parameters whose names the query does not have yet."""
    bare, frag = F.regexp_extract(url, r"(?s)^([^#]*)", 1), F.regexp_extract(url, r"(?s)(#.*)$", 1)
    for k, v in params.items():
        has = bare.rlike(r"[?&]" + k + r"(?:=|&|$)")
        sep = F.when(F.instr(bare, "?") == 0, "?").when(bare.rlike(r"[?&]$"), "").otherwise("&")
        bare = F.when(has, bare).otherwise(F.concat(bare, sep, F.url_encode(F.lit(k)), F.lit("="), F.url_encode(F.lit(v))))
    return F.concat(bare, frag)

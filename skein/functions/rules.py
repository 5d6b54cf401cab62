"""Rules of a crawl compiled to Column expressions: first match wins, evaluated once per row."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.urls import get_domain


@dataclass(frozen=True)
class URLRule:
    """Pattern (searched) with what it decides; None leaves a decision open."""

    pattern: str
    priority: int = 5
    should_scan: bool | None = None
    should_follow_links: bool | None = None
    create_edge: bool | None = None

    def __post_init__(self) -> None:
        if not 1 <= self.priority <= 10:
            raise ValueError("priority must be 1..10")


@dataclass(frozen=True)
class EdgeRule:
    """Patterns (anchored at the start) of source and target, and the largest depth difference."""

    source_pattern: str | None = None
    target_pattern: str | None = None
    max_depth_diff: int | None = None
    action: str = "create"


def usable(rules: list[URLRule]) -> list[URLRule]:
    """Rules whose patterns compile."""
    out = []
    for r in rules:
        try:
            re.compile(r.pattern)
        except re.error:
            continue
        out.append(r)
    return out


def first_rule(url: Column, rules: list[URLRule]) -> Column:
    """Index of the first matching rule, null if none matches."""
    out = F.lit(None).cast("int")
    for k, r in reversed(list(enumerate(usable(rules)))):
        out = F.when(url.rlike(r.pattern), F.lit(k)).otherwise(out)
    return out


def rule_value(index: Column, rules: list[URLRule], name: str, kind: str) -> Column:
    """Field of the matched rule."""
    values = [getattr(r, name) for r in usable(rules)]
    return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), index) if values else F.lit(None).cast(kind)


def priority(url: Column, own: Column, rules: list[URLRule]) -> Column:
    """The node's own priority, else the rule's, else 5."""
    return F.coalesce(own, rule_value(first_rule(url, rules), rules, "priority", "int"), F.lit(5))


@dataclass(frozen=True)
class DomainFilter:
    """Allowed domains; ``*``, ``domain``, ``subdomains`` and ``domain+subdomains`` are special."""

    base_domain: str
    allowed: tuple[str, ...] = ("domain+subdomains",)
    blocked: tuple[str, ...] = field(default=())
    enabled: bool = True

    def __call__(self, url: Column) -> Column:
        if not self.enabled:
            return F.lit(True)
        d = F.regexp_replace(F.lower(get_domain(url)), r"^www\.", "")
        base = self.base_domain.lower().removeprefix("www.")
        if "*" in self.allowed:
            return d.isNotNull()
        sub = d.endswith("." + base)
        ok = F.lit(False)
        for a in self.allowed:
            if a == "domain":
                ok = ok | (d == base)
            elif a == "subdomains":
                ok = ok | sub
            elif a == "domain+subdomains":
                ok = ok | (d == base) | sub
            else:
                ok = ok | (d == a.lower()) | d.endswith("." + a.lower())
        for b in self.blocked:
            ok = ok & ~((d == b.lower()) | d.endswith("." + b.lower()))
        return F.coalesce(ok, F.lit(False))


@dataclass(frozen=True)
class PathFilter:
    """Patterns searched in the path: none of the excluded, and one of the included if there are any."""

    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()

    def __call__(self, url: Column) -> Column:
        path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
        ok = F.lit(True)
        if self.exclude:
            ok = ok & ~path.rlike("|".join(f"(?:{p})" for p in self.exclude))
        if self.include:
            ok = ok & path.rlike("|".join(f"(?:{p})" for p in self.include))
        return F.coalesce(ok, F.lit(False))


def scan_decision(url: Column, rules: list[URLRule], domain: DomainFilter, path: PathFilter, explicit: Column | None = None) -> Column:
    """Struct (scan, follow): explicit decision, else the first rule, else the filters."""
    i = first_rule(url, rules)
    scan, follow = rule_value(i, rules, "should_scan", "boolean"), rule_value(i, rules, "should_follow_links", "boolean")
    passed = domain(url) & path(url)
    said = F.coalesce(explicit, scan) if explicit is not None else scan
    decided = F.coalesce(said, passed)
    return F.struct(decided.alias("scan"), F.when(said.isNotNull() & ~said, False).otherwise(decided & F.coalesce(follow, F.lit(True))).alias("follow"))


def edge_decision(source: Column, target: Column, depth_diff: Column, url_rules: list[URLRule], edge_rules: list[EdgeRule], strategy: Column) -> Column:
    """The target's URL rule, else the first edge rule that matches, else the strategy."""
    out = F.lit(None).cast("boolean")
    for r in reversed(edge_rules):
        hit = F.lit(True)
        if r.source_pattern:
            hit = hit & source.rlike(f"^(?:{r.source_pattern})")
        if r.target_pattern:
            hit = hit & target.rlike(f"^(?:{r.target_pattern})")
        if r.max_depth_diff is not None:
            hit = hit & (F.abs(depth_diff) <= r.max_depth_diff)
        out = F.when(hit, F.lit(r.action == "create")).otherwise(out)
    i = first_rule(target, url_rules)
    return F.coalesce(rule_value(i, url_rules, "create_edge", "boolean"), out, strategy)

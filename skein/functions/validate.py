"""Checks of values: each gives a message for a bad value and null for a good one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Schemes that an address may have.
SCHEMES = ["http://", "https://", "ftp://", "ws://", "wss://"]


def _message(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("None")) for p in parts])


def check_choice(value: Column, field: str, allowed: list[str], case_sensitive: bool = False) -> Column:
    """One of the allowed names."""
    ok = value.isin(allowed) if case_sensitive else F.lower(value).isin([a.lower() for a in allowed])
    return F.when(~F.coalesce(ok, F.lit(False)), _message(f"Invalid {field}: ", value, f". Allowed: {allowed}"))


def check_number(value: Column, field: str, *, allow_zero: bool = False, least: float | None = None, most: float | None = None) -> Column:
    """A positive number within bounds; null is bad."""
    low = value < 0 if allow_zero else value <= 0
    out = F.when(value.isNull() | low, _message(f"{field} must be {'non-negative' if allow_zero else 'positive'}, got ", value))
    if least is not None:
        out = out.when(value < least, _message(f"{field} must be >= {least}, got ", value))
    return out if most is None else out.when(value > most, _message(f"{field} must be <= {most}, got ", value))


def check_length(value: Column, field: str, *, least: int | None = None, most: int | None = None, allow_empty: bool = True) -> Column:
    """A text of a length within bounds; null counts as empty."""
    n = F.length(F.coalesce(value, F.lit("")))
    out = F.when(F.lit(not allow_empty) & (n == 0), f"{field} cannot be empty")
    if least is not None:
        out = out.when(n < least, _message(f"{field} must be at least {least} characters, got ", n))
    return out if most is None else out.when(n > most, _message(f"{field} must be at most {most} characters, got ", n))


def check_url(value: Column, field: str, *, require_scheme: bool = True, allowed_schemes: list[str] | None = None) -> Column:
    """An address that is not blank, with a known scheme, or with one of the allowed ones."""
    text = F.trim(F.coalesce(value, F.lit("")))
    starts = lambda prefixes: text.rlike("^(?:" + "|".join(prefixes) + ")")
    out = F.when(text == "", f"{field} cannot be empty")
    if require_scheme:
        out = out.when(~starts(SCHEMES), f"{field} must start with a scheme")
    return out if not allowed_schemes else out.when(~starts([f"{s}://" for s in allowed_schemes]), f"{field} must use one of {allowed_schemes}")


def check_port(value: Column, field: str) -> Column:
    return check_number(value, field, least=1, most=65535)


def check_percentage(value: Column, field: str) -> Column:
    return check_number(value, field, allow_zero=True, least=0, most=100)

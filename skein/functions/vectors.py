"""Similarity of float arrays, accumulated in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(c: Column) -> Column:
    return F.transform(c, lambda x: x.cast("double"))


def dot_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_d(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 if a norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot_product(a, b) / n)


def euclidean_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def similarity(a: Column, b: Column, metric: str = "cosine") -> Column:
    """Cosine, dot, or 1/(1+d) for the euclidean distance."""
    if metric == "cosine":
        return cosine_similarity(a, b)
    if metric == "dot":
        return dot_product(a, b)
    if metric == "euclidean":
        return 1.0 / (1.0 + euclidean_distance(a, b))
    raise ValueError(f"unknown metric {metric!r}")


def compare(a: Column, b: Column, metric: str = "cosine") -> Column:
    """Struct of similarity and verdict (above 0.5, for dot above 0)."""
    s = similarity(a, b, metric)
    return F.struct(s.alias("similarity"), (s > (0.0 if metric == "dot" else 0.5)).alias("is_similar"))


def fitted(v: Column, size: int) -> Column:
    """Padded with zeros or cut to ``size``; null gives zeros."""
    return F.slice(F.concat(F.coalesce(v, F.array().cast("array<float>")), F.array_repeat(F.lit(0.0).cast("float"), size)), 1, size)

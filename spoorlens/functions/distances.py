"""Six distances between two ``array<double>`` columns of equal length, as JVM expressions.

Each is null where an array is null or holds a null; where the definition divides by zero the
result is NaN (cosine, Bray-Curtis) or the term is zero (Canberra).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("euclidean", "manhattan", "cosine", "chebyshev", "canberra", "braycurtis")


def _sum(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def manhattan(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def chebyshev(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(float("nan"))).otherwise(1 - dot(a, b) / norm)


def canberra(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.when(F.abs(x) + F.abs(y) == 0, 0.0).otherwise(F.abs(x - y) / (F.abs(x) + F.abs(y)))))


def braycurtis(a: Column, b: Column) -> Column:
    whole = _sum(F.zip_with(a, b, lambda x, y: F.abs(x + y)))
    return F.when(whole == 0, F.lit(float("nan"))).otherwise(manhattan(a, b) / whole)


def distance(metric: str, a: str | Column, b: str | Column) -> Column:
    """The named distance of two array columns."""
    if metric not in METRICS:
        raise ValueError(f"metric {metric!r} is none of {', '.join(METRICS)}")
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return globals()[metric](a, b)


def all_distances(a: str, b: str, prefix: str = "dist_") -> list[Column]:
    return [distance(m, a, b).alias(prefix + m) for m in METRICS]

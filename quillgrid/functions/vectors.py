"""Vector functions over array columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    """Sum of products; null where either is null or their sizes differ."""
    total = F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(_double(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of the angle; null for vectors of no length, of different sizes or null."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)


def normalized(v: Column) -> Column:
    n = norm(v)
    return F.when(n > 0, F.transform(_double(v), lambda x: x / n))


def vector_problem(v: Column, dimensions: int, least: float = 0.1, most: float = 10.0) -> Column:
    """The first of missing, dimension, nan, infinite and norm that holds; null for a sound vector."""
    inf = F.lit(float("inf"))
    return (
        F.when(v.isNull(), "missing")
        .when(F.size(v) != dimensions, "dimension")
        .when(F.exists(v, lambda x: x.isNull() | F.isnan(x)), "nan")
        .when(F.exists(_double(v), lambda x: F.abs(x) == inf), "infinite")
        .when((norm(v) < least) | (norm(v) > most), "norm")
    )

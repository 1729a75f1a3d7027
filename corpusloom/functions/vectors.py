"""Vector expressions over ``array<double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine of the angle; 0 where either vector is zero."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0.0, F.lit(0.0)).otherwise(dot(a, b) / scale)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null where either vector is zero."""
    return F.lit(1.0) - dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def unit(a: Column) -> Column:
    """Vector scaled to length 1; a zero vector stays zero."""
    length = norm(a)
    return F.when(length == 0.0, a).otherwise(F.transform(a, lambda x: x / length))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scale(a: Column, factor: float) -> Column:
    return F.transform(a, lambda x: x * F.lit(factor))


def zeros(dimension: int) -> Column:
    return F.array_repeat(F.lit(0.0), dimension)


def is_nonzero(a: Column) -> Column:
    return F.exists(a, lambda x: x != 0.0)

"""Vector functions on array<float> columns, in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vector(values: list[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 for empty, unequal or zero vectors."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when((F.size(a) == 0) | (F.size(a) != F.size(b)) | (norm == 0), 0.0).otherwise(dot(a, b) / norm)


def normalised(a: Column) -> Column:
    norm = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(0.0))


def score_of(distance: Column) -> Column:
    return 1 / (1 + distance)

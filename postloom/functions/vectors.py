"""Vector helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STRONG_FROM, MODERATE_FROM = 0.55, 0.40


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0), lambda acc, v: acc + v,
    )


def norm2(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine of two arrays, 0 where one has no length; norms may be given."""
    size = (norm2(a) if norm_a is None else norm_a) * (norm2(b) if norm_b is None else norm_b)
    return F.when(size == 0.0, F.lit(0.0)).otherwise(dot(a, b) / size)


def match_tier(score: Column) -> Column:
    return (
        F.when(score >= STRONG_FROM, "strong").when(score >= MODERATE_FROM, "moderate").otherwise("weak")
    )

"""Vector arithmetic on array columns, in double precision and JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-10


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, epsilon: float = EPSILON) -> Column:
    """Cosine similarity; the epsilon makes it 0 rather than NaN for a zero vector."""
    return dot(a, b) / ((norm(a) + epsilon) * (norm(b) + epsilon))


def as_floats(v: Column) -> Column:
    return v.cast("array<float>")

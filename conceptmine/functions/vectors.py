"""Vector expressions over array columns, always in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null (never NaN) when either vector has no length."""
    a, b = as_double(a), as_double(b)
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot(a, b) / lengths)

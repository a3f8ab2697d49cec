"""Vector expressions, in double precision and without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """Unit vector, as doubles: with these, cosine is a dot product. Null for a zero vector."""
    return F.transform(F.array(F.nullif(norm(a), F.lit(0.0))), lambda n: F.transform(a, lambda x: x.cast("double") / n))[0]


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))

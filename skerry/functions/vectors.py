"""Vector arithmetic in double precision as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(_dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    return _dot(a, b) / (norm(a) * norm(b))


def l2_normalize(v: Column) -> Column:
    length = norm(v)
    return F.transform(v, lambda x: x.cast("double") / length)


def cosine_of_unit_distance(distance: Column) -> Column:
    """Cosine of unit vectors that lie ``distance`` apart."""
    return F.lit(1.0) - distance * distance / 2

"""Vectors as array<float>: products in the JVM for single queries, NumPy on Arrow batches for batches of queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a, b) -> Column:
    zero = F.lit(0.0)
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), zero, lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(a) -> Column:
    """Unit length; an all-zero vector stays as it is."""
    a = F.col(a) if isinstance(a, str) else a
    return F.when(norm(a) > 0, F.transform(a, lambda x: x.cast("double") / norm(a))).otherwise(F.transform(a, lambda x: x.cast("double")))


def score_from_l2(cosine) -> Column:
    """1 - squared distance of unit vectors."""
    return 2 * cosine - 1

"""Distances and scores as Columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 if either vector is all zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


def distance_to_relevance(distance: Column) -> Column:
    return 1 / (1 + distance)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def tier_score(tier: Column) -> Column:
    """Score of a chunk found over a call edge of this resolution tier."""
    return F.when(tier == 1, 0.85).when(tier == 2, 0.80).otherwise(0.75)

"""Vector metrics as column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column) -> Column:
    """At unit length; a zero vector stays as it is."""
    return F.transform(F.array(norm(a)), lambda n: F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double"))))[0]  # the norm once, not for each place


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cos; null where either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, 1 - dot(a, b) / n)


def euclidean_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def dot_distance(a: Column, b: Column) -> Column:
    return -dot(a, b)


METRICS = {"cosine": cosine_distance, "euclidean": euclidean_distance, "dotproduct": dot_distance}


def distance(metric: str | None, a: Column, b: Column) -> Column:
    if (metric or "cosine") not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    return METRICS[metric or "cosine"](a, b)


def score(d: Column) -> Column:
    return 1 - d


def shown(x: Column, digits: int = 6) -> Column:
    """Rounded for results, half away from zero in binary as the SQL's round is; never -0.0."""
    unit = 10.0**digits
    return F.when(F.abs(x * unit) < float("inf"), F.round(x * unit) / unit).otherwise(x) + F.lit(0.0)

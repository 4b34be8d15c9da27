"""Functions of vectors (arrays of floats), computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Vector of length 1 in the same direction; a zero vector stays."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def score_of_distance(d: Column) -> Column:
    """1 - d, but not below 0."""
    return F.greatest(F.lit(0.0), 1 - d)


#: Distances by name.
METRICS = ["cosine", "ip", "l2sq"]


def distance(a: Column, b: Column, metric: str = "l2sq") -> Column:
    kinds = {"l2sq": squared_distance, "cosine": lambda x, y: 1 - cosine(x, y), "ip": lambda x, y: 1 - dot(x, y)}
    if metric not in kinds:
        raise ValueError(f"metric must be one of {sorted(kinds)}")
    return kinds[metric](a, b)

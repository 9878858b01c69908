"""Vector expressions over array<float> columns, computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "euclidean", "combined")
#: Default thresholds of searches and of clustering; each metric has its own.
SEARCH_THRESHOLDS = {"cosine": 0.85, "euclidean": 0.45, "combined": 0.46}
CLUSTER_THRESHOLDS = {"cosine": 0.90, "euclidean": 0.45, "combined": 0.46}
MIN_NORM = 1e-9


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def once(value: Column, body) -> Column:
    """body(value) with the value worked out once, not again in each step of a lambda."""
    return F.get(F.transform(F.array(value), body), 0)


def unit(v: Column) -> Column:
    return once(norm(v), lambda length: F.transform(v, lambda x: x.cast("double") / length))


def valid(v: Column, dim: int | None = None) -> Column:
    """Whether v is of the dimension and not (almost) zero."""
    ok = v.isNotNull() & (norm(v) >= MIN_NORM)
    return ok if dim is None else ok & (F.size(v) == dim)


def from_cosine(c: Column, metric: str) -> Column:
    """A cosine as the metric's value: itself, a distance of unit vectors, or an angle."""
    check(metric)
    if metric == "cosine":
        return c
    if metric == "euclidean":
        return F.sqrt(F.greatest(F.lit(0.0), 2.0 - 2.0 * c))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))


def passes(value: Column, metric: str, threshold: float) -> Column:
    return value >= threshold if metric == "cosine" else value <= threshold


def least_cosine(metric: str, threshold: float) -> float:
    """The cosine that just passes the metric's threshold."""
    import math

    check(metric)
    if metric == "cosine":
        return threshold
    return 1 - threshold * threshold / 2 if metric == "euclidean" else math.cos(threshold)


def check(metric: str) -> None:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; there are {', '.join(METRICS)}")


def min_max(v: Column) -> Column:
    """Scaled to 0..1 and rounded to 4 places; 0.5 throughout if all are equal."""
    ends = F.struct(F.array_min(v).cast("double").alias("low"), F.array_max(v).cast("double").alias("high"))
    part = lambda x, e: F.when(e["high"] > e["low"], F.round((x.cast("double") - e["low"]) / (e["high"] - e["low"]), 4)).otherwise(F.lit(0.5))
    return once(ends, lambda e: F.transform(v, lambda x: part(x, e)))


def softmax_first(a: Column, b: Column) -> Column:
    """exp(a) / (exp(a) + exp(b)), without overflow."""
    return 1.0 / (1.0 + F.exp(b - a))

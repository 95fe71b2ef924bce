"""Vector metrics and score modifiers as columns; sums are in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

HIGHER_IS_BETTER = {"cosine": True, "dot": True, "euclidean": False, "euclidean_squared": False}


def literal(q: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in q])


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _fit(a: Column, b: Column, value: Column) -> Column:
    """0 for empty vectors and for lengths that differ."""
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), value).otherwise(F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return _fit(a, b, _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))))


def magnitude(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    norm = magnitude(a) * magnitude(b)
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def euclidean_squared(a: Column, b: Column) -> Column:
    step = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return _fit(a, b, _sum(step))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(euclidean_squared(a, b))


METRICS = {"cosine": cosine, "dot": dot, "euclidean": euclidean, "euclidean_squared": euclidean_squared}


def metric(name: str, a: Column, b: Column) -> Column:
    """Unknown names mean cosine."""
    return METRICS.get(name, cosine)(a, b)


def higher_is_better(name: str) -> bool:
    return HIGHER_IS_BETTER.get(name, True)


def normalize(a: Column) -> Column:
    """Length one; a zero vector is unchanged."""
    m = magnitude(a)
    return F.when(m > 0, F.transform(a, lambda x: x.cast("double") / m)).otherwise(F.transform(a, lambda x: x.cast("double")))


def decay(score: Column, age: Column, kind: str | None, half_life: float) -> Column:
    """``score`` by age in seconds: exponential, linear or gaussian; unchanged for no kind or no half-life."""
    if half_life <= 0 or kind not in ("exponential", "linear", "gaussian"):
        return score
    ratio = age / F.lit(float(half_life))
    factor = {
        "exponential": F.pow(F.lit(2.0), -ratio),
        "linear": F.greatest(F.lit(0.0), 1 - ratio),
        "gaussian": F.exp(-0.5 * ratio * ratio),
    }[kind]
    return score * factor


def boost(score: Column, importance: Column, by: float) -> Column:
    return score * (1 + F.lit(float(by)) * importance) if by > 0 else score

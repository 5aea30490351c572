"""Vector functions as Column expressions: double arithmetic, inside the JVM.

A vector is an array of floats or doubles. Null vectors give null; of two lengths, zip_with gives null, so unequal dimensions never score.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "euclidean", "cosine_full")


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def literal(values: Iterable[float]) -> Column:
    """A constant vector."""
    return F.array(*[F.lit(float(x)) for x in values]).cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(doubles(v), lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """1 - dot product: for unit vectors, like the index that it stands for."""
    return F.lit(1.0) - dot(a, b)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))))


def cosine_full(a: Column, b: Column) -> Column:
    """Normalises both; 1 where one is zero."""
    return F.when(F.size(a) == F.size(b), F.coalesce(F.lit(1.0) - F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(1.0)))


def weighted(metric: str, a: Column, b: Column, w: Column) -> Column:
    """Each dimension of both vectors times its weight."""
    return distance(metric, F.zip_with(doubles(a), w, lambda x, y: x * y), F.zip_with(doubles(b), w, lambda x, y: x * y))


def distance(metric: str, a: Column, b: Column) -> Column:
    if metric not in METRICS:
        raise ValueError(f"there is no metric {metric}; there are {', '.join(METRICS)}")
    return {"cosine": cosine, "euclidean": euclidean, "cosine_full": cosine_full}[metric](a, b)


def normalized(v: Column) -> Column:
    """Null where the norm is zero or not finite."""
    n = norm(v)
    good = (n > 0) & ~F.isnan(n) & (n < F.lit(float("inf")))
    return F.when(good, F.transform(doubles(v), lambda x: x / n))


def projected(v: Column, mask: Mapping[int, float], dim: int) -> Column:
    """Dimensions times the weights of mask; others stay."""
    if bad := [k for k in mask if not 0 <= k < dim]:
        raise ValueError(f"dimensions {bad} are outside 0..{dim - 1}")
    return F.zip_with(doubles(v), dense(mask, dim), lambda x, w: x * w)


def dense(mask: Mapping[int, float], dim: int) -> Column:
    """The weights of all dimensions: 1 where mask has none; those outside are left out."""
    return literal(mask.get(k, 1.0) for k in range(dim))


def multiplied(a: Column, b: Column) -> Column:
    """Element by element, as far as both reach."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(doubles(a), F.lit(1), n), F.slice(doubles(b), F.lit(1), n), lambda x, y: x * y)


def average_of(a: Column, n: Column, b: Column, m: Column) -> Column:
    """The mean of two means of n and m vectors."""
    return F.zip_with(doubles(a), doubles(b), lambda x, y: (x * n + y * m) / (n + m))


def floats(v: Column) -> Column:
    return v.cast("array<float>")

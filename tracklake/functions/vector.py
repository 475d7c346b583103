"""Vector expressions over array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, least: float = 1e-8) -> Column:
    """0 for missing vectors, unequal sizes or a tiny product of norms."""
    usable = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (norm(a) * norm(b) > least)
    return F.when(usable, dot(a, b) / (norm(a) * norm(b))).otherwise(F.lit(0.0))


def l2_normalize(a: Column) -> Column:
    return F.transform(a, lambda x: x / F.greatest(norm(a), F.lit(1e-12)))


def mean_vector(column: str, size: int) -> Column:
    """The mean of an array column over a group: one partial average per place, no collecting."""
    return F.array(*[F.avg(F.col(column)[i]) for i in range(size)])


def weighted_mean_vector(column: str, weight: Column, size: int) -> Column:
    return F.array(*[F.sum(F.col(column)[i] * weight) / F.sum(weight) for i in range(size)])


def median_vector(column: str, size: int) -> Column:
    """Component-wise exact median over a group."""
    return F.array(*[F.percentile(F.col(column)[i], F.lit(0.5)) for i in range(size)])


def ema(values: Column, keep: float) -> Column:
    """Exponential moving average of an ordered array; null if it is empty."""
    return F.aggregate(
        F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.get(values, F.lit(0)), lambda a, x: a * keep + x * (1 - keep)
    )

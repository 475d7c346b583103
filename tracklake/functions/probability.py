"""Probability expressions: guarded logarithms, softmax and distributions held as maps."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def safe_log(value: Column, least: float = 1e-6) -> Column:
    return F.ln(F.greatest(value, F.lit(least)))


def softmax(score: Column, over: WindowSpec, temperature: float = 1.0) -> Column:
    """Softmax of a column within a window, shifted by its maximum."""
    shifted = F.exp((score - F.max(score).over(over)) / F.lit(max(temperature, 1e-6)))
    return shifted / F.sum(shifted).over(over)


def share(value: Column, over: WindowSpec) -> Column:
    total = F.sum(value).over(over)
    return F.when(total > 0, value / total).otherwise(F.lit(0.0))


def normalize_map(m: Column) -> Column:
    total = F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x)
    return F.when(total > 0, F.transform_values(m, lambda k, v: v / total)).otherwise(m)


def drop_tail(m: Column, least: float = 0.02) -> Column:
    """Without the values below ``least`` (held against it at fourteen digits, as sums hang on their order beyond that), renormalised."""
    return normalize_map(F.map_filter(m, lambda k, v: F.round(v, 14) >= least))


def merge_max(a: Column, b: Column) -> Column:
    zero = F.lit(0.0)
    return F.map_zip_with(a, b, lambda k, x, y: F.greatest(F.coalesce(x, zero), F.coalesce(y, zero)))


def keep_known(m: Column, known: Column, *, empty_if_none: bool) -> Column:
    """Only the keys in an array, renormalised; with none left either empty or the map as it was."""
    kept = F.map_filter(m, lambda k, v: F.array_contains(known, k))
    other = F.map_filter(m, lambda k, v: F.lit(False)) if empty_if_none else m
    return F.when(F.size(kept) > 0, normalize_map(kept)).otherwise(other)


def track_confidence(n: Column, mean_confidence: Column) -> Column:
    return F.least(F.lit(0.99), 0.35 + 0.35 * F.least(F.lit(1.0), n / 18.0) + 0.30 * mean_confidence)


def position_prior(position: Column, mean_y: Column, span_y: Column, default: float = 0.5, strength: float = 0.12) -> Column:
    """A weak prior from a nominal position and how the track's centres move vertically."""
    role = F.upper(position)
    shift = (
        F.when(role.startswith("GK"), F.when(span_y > 35, -0.04).otherwise(0.03))
        .when(role.startswith("DF"), F.when(span_y < 90, 0.01).otherwise(-0.01))
        .when(role.startswith("MF"), F.when(span_y >= 15, 0.02).otherwise(0.0))
        .when(role.startswith("FW") | role.startswith("ST"), F.when(mean_y > 0, 0.01).otherwise(0.0))
        .otherwise(0.0)
    )
    prior = F.greatest(F.lit(0.05), F.least(F.lit(0.95), default + strength * shift))
    return F.when(F.coalesce(position, F.lit("")) == "", F.lit(default)).otherwise(prior)

"""Box and interval expressions. A box is four columns x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    return tuple(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2"))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def width(b: Box) -> Column:
    return F.greatest(F.lit(0.0), b[2] - b[0])


def height(b: Box) -> Column:
    return F.greatest(F.lit(0.0), b[3] - b[1])


def area(b: Box) -> Column:
    return width(b) * height(b)


def center(b: Box) -> tuple[Column, Column]:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2


def foot_point(b: Box) -> tuple[Column, Column]:
    return (b[0] + b[2]) / 2, b[3]


def distance(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return F.sqrt((a[0] - b[0]) * (a[0] - b[0]) + (a[1] - b[1]) * (a[1] - b[1]))


def clip_to_frame(b: Box, frame_width: int, frame_height: int) -> Box:
    """The box inside the frame; the last pixel is width - 1, height - 1."""
    x = lambda c: clamp(c, 0.0, frame_width - 1.0)
    y = lambda c: clamp(c, 0.0, frame_height - 1.0)
    return x(b[0]), y(b[1]), x(b[2]), y(b[3])


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 if the union has no area."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))


def overlap_seconds(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(end_a, end_b) - F.greatest(start_a, start_b))


def interval_iou(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Overlap over the hull of both intervals; 0 for an empty hull."""
    hull = F.greatest(end_a, end_b) - F.least(start_a, start_b)
    return F.when(hull > 0, overlap_seconds(start_a, end_a, start_b, end_b) / hull).otherwise(F.lit(0.0))


def interpolate(at: Column, t0: Column, v0: Column, t1: Column, v1: Column) -> Column:
    """The line through both points at ``at``; the first value if they share a time."""
    return F.when(t1 == t0, v0).otherwise(v0 + (v1 - v0) * (at - t0) / (t1 - t0))

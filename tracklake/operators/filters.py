"""Filters and gates over tracks, detections and observations, with three-valued logic made plain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklake.functions import geometry as G

SPECIAL = ("referee", "goalkeeper")


def is_special() -> Column:
    return F.coalesce(F.col("role").isin(*SPECIAL), F.lit(False))


def ordered_numbers(labels: DataFrame, column: str) -> DataFrame:
    """The distinct labels with their place by length and then text, as numbers are listed."""
    from pyspark.sql import Window

    distinct = labels.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("label")).distinct()
    return distinct.withColumn("place", F.row_number().over(Window.orderBy(F.length("label"), "label")))  # a roster's labels


def eligible(tracks: DataFrame) -> DataFrame:
    """Players that are neither referee nor goalkeeper; an unknown is_player counts as a player."""
    return tracks.where(F.coalesce(F.col("is_player"), F.lit(True)) & ~is_special())


def without(tracks: DataFrame, excluded: DataFrame) -> DataFrame:
    """The tracks whose id is not excluded."""
    return tracks.join(excluded.select("track_id").distinct(), "track_id", "left_anti")


def clear_special(tracks: DataFrame, columns: list[str]) -> DataFrame:
    """Referees and goalkeepers lose the given columns' values before labels are deduplicated."""
    return tracks.withColumns({c: F.when(~is_special(), F.col(c)) for c in columns})


def rendered(tracks: DataFrame, *, least_likelihood: float = 0.5, least_duration: float = 0.25) -> DataFrame:
    """Tracks that are drawn: long enough, and special or likely players."""
    likely = F.coalesce(F.col("is_player"), F.lit(False)) & (F.col("likelihood") >= least_likelihood)
    return tracks.where((F.col("duration") >= least_duration) & (is_special() | likely))


def of_class(detections: DataFrame, class_id: int) -> DataFrame:
    return detections.where(F.col("class_id") == class_id)


def judged_categories(annotations: DataFrame) -> DataFrame:
    """Annotations that count: not the root category, and not a referee or an unnumbered person."""
    return annotations.where((F.col("role") != "root") & ~is_special() & F.col("jersey").isNotNull())


def gate_evidence(obs: DataFrame, *, least_width: float = 0, least_height: float = 0, least_legible: float = 0.0) -> DataFrame:
    """Observations with the map ``probs`` emptied and ``quality`` 0 where the box is too small or not legible; no row is dropped.

    Sizes are whole pixels; a limit of 0 is off, and an unknown legibility passes.
    """
    w, h = (F.col("x2") - F.col("x1")).cast("int"), (F.col("y2") - F.col("y1")).cast("int")
    small = (F.lit(least_height > 0) & (h < least_height)) | (F.lit(least_width > 0) & (w < least_width))
    shut = small | F.coalesce(F.col("legible") < least_legible, F.lit(False))
    empty = F.map_filter("probs", lambda k, v: F.lit(False))
    return obs.withColumns({"probs": F.when(shut, empty).otherwise(F.col("probs")), "quality": F.when(shut, F.lit(0.0)).otherwise(F.col("quality"))})


def plausible_boxes(
    boxes: DataFrame,
    frame_width: int,
    frame_height: int,
    *,
    least_area: float = 120.0,
    most_share: float = 0.08,
    least_height: float = 18.0,
    aspect: tuple[float, float] = (0.12, 1.1),
    border: float = 2.0,
    floor: float = 0.45,
) -> DataFrame:
    """Blobs that can be a person, clipped to the frame, with their confidence from fill and size.

    boxes: x1, y1, x2, y2 and fill (share of the box that the blob covers).
    """
    b = G.box()
    area, ratio = G.area(b), G.width(b) / F.greatest(F.lit(1.0), G.height(b))
    fits = (area >= least_area) & (area <= most_share * frame_width * frame_height) & (G.height(b) >= least_height)
    fits = fits & (ratio >= aspect[0]) & (ratio <= aspect[1]) & (F.col("y1") >= border) & (F.col("y2") <= frame_height - border)
    clipped = dict(zip(("x1", "y1", "x2", "y2"), G.clip_to_frame(b, frame_width, frame_height)))
    kept = boxes.where(fits).withColumns(clipped)
    confidence = F.least(F.lit(0.96), floor + 0.25 * F.col("fill") + F.least(F.lit(0.3), G.area(G.box()) / 8000.0))
    return kept.withColumn("confidence", confidence)


def crop_quality(area_score: Column, sharpness: Column) -> Column:
    """0.55 of the size and 0.45 of the sharpness, both from 0 to 1."""
    return G.clamp(0.55 * area_score + 0.45 * sharpness, 0.0, 1.0)

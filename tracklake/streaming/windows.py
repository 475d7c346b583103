"""Sliding windows over a stream of observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def seen_in_windows(obs: DataFrame, length: str, step: str, *, time: str = "at", delay: str = "0 seconds", start: str = "0 seconds") -> DataFrame:
    """window_start, n_tracks and id_sum: the tracks with an observation in each sliding window, also over a stream.

    Windows are half open and anchored at ``start`` (after 1970). Two aggregations follow each other: one row for each window and track, then one
    for each window, so a window with very many tracks is not one group's state. In append mode a window comes out once the watermark has passed its end.
    """
    seen = obs.withWatermark(time, delay) if obs.isStreaming else obs
    each = seen.groupBy(F.window(time, length, step, start), "track_id").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("window").agg(F.count(F.lit(1)).alias("n_tracks"), F.sum("track_id").alias("id_sum")).select(F.col("window.start").alias("window_start"), "n_tracks", "id_sum")

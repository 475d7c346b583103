"""Tracks: extents, filters, edge touches, likelihood, roles, segmentation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklake.functions import color as C
from tracklake.functions import geometry as G
from tracklake.functions import vector as V
from tracklake.operators.ranking import global_rank


def extents(obs: DataFrame) -> DataFrame:
    """track_id, n, start, end, duration, mean quality and probability."""
    return obs.groupBy("track_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("ts_s").alias("start_s"),
        F.max("ts_s").alias("end_s"),
        F.greatest(F.lit(0.0), F.max("ts_s") - F.min("ts_s")).alias("duration"),
        F.coalesce(F.avg("quality"), F.lit(0.0)).alias("mean_quality"),
        F.coalesce(F.avg("prob"), F.lit(0.0)).alias("mean_prob"),
    )


def with_min_observations(obs: DataFrame, least: int) -> DataFrame:
    """Observations of tracks with enough of them, with the canonical track order track_seq."""
    kept = obs.groupBy("track_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts_s").alias("start_s")).where(F.col("n") >= least)
    order = global_rank(kept, F.floor(F.col("start_s") / 3600), ["start_s", "track_id"], "track_seq")
    return obs.join(order.select("track_id", "track_seq"), "track_id")


def ends(obs: DataFrame) -> DataFrame:
    """First and last position of every track."""
    at = F.struct("seq", "ts_s", "x", "y")
    return obs.groupBy("track_id").agg(F.min_by(at, "seq").alias("first"), F.max_by(at, "seq").alias("last"))


def edge_touches(boxes: DataFrame, frame_width: float, frame_height: float, margin: float) -> DataFrame:
    """Share of boxes that touch each edge, and upper medians of the coordinates."""
    share = lambda cond: F.count_if(cond) / F.greatest(F.lit(1), F.count(F.lit(1)))
    upper = lambda c: F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {c} DESC)")
    return boxes.groupBy("track_id").agg(
        share(F.col("x1") <= margin).alias("left_share"),
        share(F.col("x2") >= frame_width - margin).alias("right_share"),
        share(F.col("y1") <= margin).alias("top_share"),
        share(F.col("y2") >= frame_height - margin).alias("bottom_share"),
        *[upper(c).alias(f"median_{c}") for c in ("x1", "y1", "x2", "y2")],
    )


def player_likelihood(tracks: DataFrame, edges: DataFrame, *, threshold: float = 0.5, min_duration: float = 0.2, side: float = 0.5) -> DataFrame:
    """likelihood = 0.85 quality + 0.15 probability, times 0.15 on the sideline; is_player."""
    touched = F.greatest("top_share", "bottom_share") >= side
    raw = 0.85 * F.col("mean_quality") + 0.15 * F.col("mean_prob")
    return (
        tracks.join(edges, "track_id", "left")
        .withColumn("likelihood", F.when(F.coalesce(touched, F.lit(False)), raw * 0.15).otherwise(raw))
        .withColumn("is_player", (F.col("likelihood") >= threshold) & (F.col("duration") >= min_duration))
        .select("track_id", "likelihood", "is_player")
    )


def jump_segments(obs: DataFrame, max_step: float) -> DataFrame:
    """Adds segment: a new one where the speed since the observation before is above ``max_step`` units a second."""
    order = Window.partitionBy("track_id").orderBy("seq")
    gone = G.distance((F.col("x"), F.col("y")), (F.lag("x").over(order), F.lag("y").over(order)))
    time = F.greatest(F.lit(1.0), F.col("ts_s") - F.lag("ts_s").over(order))
    return obs.withColumn("jump", F.coalesce(gone / time > max_step, F.lit(False)).cast("int")).withColumn(
        "segment", F.sum("jump").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )


def switch_segments(obs: DataFrame, max_step: float = 80.0, drop: float = 0.2) -> DataFrame:
    """Adds segment: a new one where the step per frame is above ``max_step``, or the embedding is unlike the last one seen.

    Unlike: cosine below 0.5 - drop, against the last row of the track with an embedding. obs: track_id, frame, x, y,
    embedding (nullable).
    """
    order = Window.partitionBy("track_id").orderBy("frame")
    gone = G.distance((F.col("x"), F.col("y")), (F.lag("x").over(order), F.lag("y").over(order)))
    frames = F.greatest(F.lit(1), F.col("frame") - F.lag("frame").over(order))
    seen = F.last("embedding", True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = obs.withColumn("_seen", seen).withColumn("_far", F.coalesce(gone / frames > max_step, F.lit(False)))
    unlike = F.col("embedding").isNotNull() & F.col("_seen").isNotNull() & (V.cosine(F.col("embedding"), F.col("_seen")) < 0.5 - drop)
    cut = rows.withColumn("_cut", (F.col("_far") | unlike).cast("int"))
    return cut.withColumn("segment", F.sum("_cut").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_seen", "_far", "_cut")


def team_by_hue(rows: DataFrame, hues: dict[str, int], *, least_saturation: int = 30, reach: int = 35) -> DataFrame:
    """Adds team: that of the nearest hue (the first of equal ones) if the colour is saturated and near enough, else null. rows: r, g, b."""
    h, s, _ = C.hsv((F.col("r"), F.col("g"), F.col("b")))
    gone = [C.hue_distance(F.col("_h"), F.lit(hue)) for hue in hues.values()]
    least = F.least(*gone) if len(gone) > 1 else gone[0]
    near = F.coalesce(*[F.when(d == least, F.lit(team)) for team, d in zip(hues, gone)])
    fits = (F.col("_s") >= least_saturation) & (least <= reach)
    return rows.withColumn("_h", h).withColumn("_s", s).withColumn("team", F.when(fits, near)).drop("_h", "_s")


def mean_colors(obs: DataFrame, floor: float = 0.05) -> DataFrame:
    """track_id, r, g, b: the mean colour with weights max(floor, quality); tracks without a colour are absent."""
    w = F.greatest(F.lit(floor), F.col("quality"))
    seen = obs.where("r is not null")
    return seen.groupBy("track_id").agg(*[(F.sum(F.col(c) * w) / F.sum(w)).alias(c) for c in "rgb"])


def shirt_distance(colors: DataFrame, kits: DataFrame) -> DataFrame:
    """track_id, team, distance of a track's mean colour to each team's shirt of the kit table (team, sr, sg, sb); null if either is missing."""
    cut = lambda c: F.col(c).cast("int")
    far = C.kit_distance((cut("r"), cut("g"), cut("b")), (F.col("sr"), F.col("sg"), F.col("sb")))
    teams = kits.withColumn("one", F.lit(1))
    j = colors.withColumn("one", F.lit(1)).join(F.broadcast(teams), "one")  # the kits of a clip
    return j.select("track_id", "team", F.when(F.col("r").isNotNull() & F.col("sr").isNotNull(), far).alias("distance"))


def segment_extents(segmented: DataFrame, first_new_id: int = 30000) -> DataFrame:
    """Extent of each segment; tracks that were split get new ids for all their segments."""
    spans = segmented.groupBy("track_id", "segment").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts_s").alias("start_s"), F.max("ts_s").alias("end_s")
    )
    parts = F.count(F.lit(1)).over(Window.partitionBy("track_id"))
    return spans.withColumn("parts", parts).withColumn(
        "new_id", F.when(F.col("parts") > 1, F.concat_ws("-", F.lit(first_new_id), "track_id", "segment")).otherwise(F.col("track_id").cast("string"))
    )


def team_flip_segments(obs: DataFrame, look_ahead: int = 3) -> DataFrame:
    """Adds segment: a new one where the team changes and the next known team within ``look_ahead`` rows confirms it.

    The carried team is a state machine, so a track's rows are folded in order. Columns: track_id, seq, team (nullable).
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq").reset_index(drop=True)
        teams = [None if pd.isna(t) else t for t in rows["team"]]
        current, segment, out = None, 0, []
        for i, team in enumerate(teams):
            if team is not None and current is None:
                current = team
            elif team is not None and team != current:
                ahead = next((t for t in teams[i + 1 : i + 1 + look_ahead] if t is not None), None)
                if ahead == team:
                    current, segment = team, segment + 1
            out.append(segment)
        return rows.assign(segment=out)[["track_id", "seq", "team", "segment"]]

    return obs.select("track_id", "seq", "team").groupBy("track_id").applyInPandas(fold, "track_id long, seq long, team string, segment int")


def interpolate_positions(anchors: DataFrame, queries: DataFrame) -> DataFrame:
    """Position of every (key, at) on the piecewise line through the key's anchors (key, t, x, y).

    Before the first and after the last anchor the nearest two are extended; with one anchor
    its position holds. Anchors share their key's partition in time order: both sides
    are found by windows over the union, without a range join. Anchors that share a time count with their median.
    """
    a = anchors.groupBy("key", "t").agg(F.percentile("x", F.lit(0.5)).alias("x"), F.percentile("y", F.lit(0.5)).alias("y"))
    point = F.struct("t", "x", "y")
    order = Window.partitionBy("key").orderBy("t")
    a = a.withColumn("here", point).withColumn("prev", F.lag("here").over(order)).withColumn("next", F.lead("here").over(order))
    rows = a.select("key", F.col("t").alias("at"), "here", "prev", "next", F.lit(0).alias("q")).unionByName(
        queries.select("key", "at", F.lit(1).alias("q")), allowMissingColumns=True
    )
    back = Window.partitionBy("key").orderBy("at", "q").rowsBetween(Window.unboundedPreceding, 0)
    forth = Window.partitionBy("key").orderBy("at", "q").rowsBetween(0, Window.unboundedFollowing)
    side = lambda f, w: f(F.when(F.col("q") == 0, F.struct("here", "prev", "next")), True).over(w)
    found = rows.withColumn("lo", side(F.last, back)).withColumn("hi", side(F.first, forth)).where("q = 1")
    p = F.when(F.col("lo").isNull(), F.col("hi.here")).when(F.col("hi").isNull(), F.coalesce("lo.prev", "lo.here")).otherwise(F.col("lo.here"))
    n = F.when(F.col("lo").isNull(), F.coalesce("hi.next", "hi.here")).when(F.col("hi").isNull(), F.col("lo.here")).otherwise(F.col("hi.here"))
    return (
        found.withColumn("p", p)
        .withColumn("n", n)
        .select(
            "key",
            "at",
            G.interpolate(F.col("at"), F.col("p.t"), F.col("p.x"), F.col("n.t"), F.col("n.x")).alias("x"),
            G.interpolate(F.col("at"), F.col("p.t"), F.col("p.y"), F.col("n.t"), F.col("n.y")).alias("y"),
        )
    )


def confidence_ema(obs: DataFrame, keep: float = 0.8) -> DataFrame:
    """Exponential moving average of a track's probabilities in order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "prob"))), lambda x: x["prob"])
    return obs.groupBy("track_id").agg(ordered.alias("v")).select("track_id", V.ema(F.col("v"), keep).alias("confidence"))

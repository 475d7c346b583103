"""Fusion of team, label, position and tracking evidence into a posterior over the roster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.functions.probability import position_prior, safe_log, softmax, track_confidence

WEIGHTS = {"team": 2.0, "label": 3.2, "head": 1.0, "body": 0.6, "position": 0.35, "track": 0.25}


def team_posterior(distances: DataFrame, *, temperature: float = 0.16, cap: float = 0.62, unknown: float = 0.48) -> DataFrame:
    """track_id, team, prob from (track_id, team, distance).

    If no team is within ``unknown`` all get 0.02, which is no distribution; else a softmax of
    the negative distances, each at most ``cap``.
    """
    track = Window.partitionBy("track_id")
    near = F.min("distance").over(track) <= unknown
    p = F.least(F.lit(cap), softmax(-F.col("distance"), track, temperature))
    return distances.select("track_id", "team", F.when(near, p).otherwise(F.lit(0.02)).alias("prob"))


def fusion_score(
    team: Column, label_prob: Column, quality: Column, has_label: Column, head: Column, body: Column, position: Column, confidence: Column, w: dict[str, float]
) -> Column:
    """Weighted logarithms of the evidence; a missing head or body similarity adds nothing, a missing team is neutral."""
    label = F.when(has_label, F.greatest(F.lit(0.15), quality) * safe_log(F.coalesce(label_prob, F.lit(1e-4)))).otherwise(0.05 * safe_log(F.lit(0.72)))
    zero = F.lit(0.0)
    return (
        w["team"] * safe_log(F.coalesce(team, F.lit(0.5)))
        + w["label"] * label
        + F.coalesce(w["head"] * (2 * head - 1), zero)
        + F.when(body > 0, w["body"] * (2 * body - 1)).otherwise(zero)
        + w["position"] * safe_log(position)
        + w["track"] * safe_log(confidence)
    )


def fuse(
    tracks: DataFrame,
    roster: DataFrame,
    team_probs: DataFrame,
    label_probs: DataFrame,
    heads: DataFrame,
    bodies: DataFrame,
    *,
    on: str = "clip",
    weights: dict[str, float] = WEIGHTS,
    temperature: float = 1.0,
    most: int = 100_000,
) -> DataFrame:
    """track_id, player, score and posterior for every track and every player of its clip's roster.

    tracks: the clip, track_id, n, mean_quality, mean_y, span_y; roster: the clip, player, team, jersey, position;
    team_probs: track_id, team, prob; label_probs: track_id, candidate, prob; heads, bodies: track_id,
    player, sim. The roster is broadcast up to ``most`` rows, else joined by its clip.
    """
    players = roster.select(on, "player", "team", "jersey", "position")
    players = F.broadcast(players) if players.count() <= most else players
    labels = label_probs.select("track_id", F.col("candidate").alias("jersey"), F.col("prob").alias("label_prob"))
    known = label_probs.select("track_id").distinct().withColumn("has_label", F.lit(True))
    confidence = track_confidence(F.col("n"), F.col("mean_quality"))
    prior = position_prior(F.col("position"), F.col("mean_y"), F.col("span_y"))
    score = fusion_score(
        F.col("team_prob"), F.col("label_prob"), F.col("mean_quality"), F.coalesce("has_label", F.lit(False)), F.col("head"), F.col("body"), prior, confidence, weights
    )
    rows = (
        tracks.join(known, "track_id", "left")
        .join(players, on)
        .join(team_probs.select("track_id", "team", F.col("prob").alias("team_prob")), ["track_id", "team"], "left")
        .join(labels, ["track_id", "jersey"], "left")
        .join(heads.select("track_id", "player", F.col("sim").alias("head")), ["track_id", "player"], "left")
        .join(bodies.select("track_id", "player", F.col("sim").alias("body")), ["track_id", "player"], "left")
        .withColumn("score", score)
    )
    return rows.select("track_id", "player", "score", softmax(F.col("score"), Window.partitionBy("track_id"), temperature).alias("posterior"))


def render_label(name: Column, jersey: Column, role: Column, confidence: Column, top_score: Column, *, sure: float = 0.6, likely: float = 0.4) -> Column:
    """The display label: the first rule that applies."""
    return (
        F.when(role == "referee", "Referee")
        .when(role == "goalkeeper", F.concat(F.lit("Goalkeeper "), F.coalesce(name, F.lit(""))))
        .when(name.isNotNull() & jersey.isNotNull() & (confidence >= sure), name)
        .when(name.isNotNull() & jersey.isNotNull() & (confidence >= likely), F.concat(F.lit("Likely "), name))
        .when(jersey.isNotNull(), F.concat(F.lit("Low conf ID #"), jersey))
        .when(name.isNotNull() & (confidence >= max(0.55, sure)), name)
        .when(name.isNotNull() & (top_score >= 5.0), name)
        .otherwise("Low conf ID")
    )

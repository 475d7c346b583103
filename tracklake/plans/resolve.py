"""Clips resolved end to end: detections in, identities and their evaluation out, as a resumable run of stages.

The stages are the engine's operators, driven by the sections of a configuration (``hooks.Options``): tracker, observations,
tracklets, teams, labels, fusion, windowed one-to-one assignment, cascading candidates, conflicts until stable, stitching, refreshed
evidence, and the four metrics against ground truth. All clips go through together; whatever meets by a frame, a window or a bucket meets by
the clip as well, and track ids carry the clip.

detections: clip, frame, det_id, x1, y1, x2, y2, confidence, detector_id (optional). reads: clip, det_id, ts_s, quality, candidate, prob.
kits: clip, det_id, team, distance (of the box's colour to the team's). roster: clip, player, team, jersey, position; players and teams are named apart
in different clips. truth: clip, frame, gt_id, name (the player), visible, x1, y1, x2, y2.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.functions import geometry as G
from tracklake.functions import probability as P
from tracklake.operators import evidence, fusion, linking, matching, spatial, tracks, votes
from tracklake.operators.hooks import Options, build_tracker
from tracklake.operators.identity import window_votes
from tracklake.plans.stages import Run

#: Track ids hold the clip above and the clip's own id below this bit.
CLIP_BIT = 32


def _tracked(detections: DataFrame, config: dict) -> DataFrame:
    got = build_tracker(config)(detections)
    return got.withColumn("track_id", F.shiftleft("clip", CLIP_BIT) + F.col("track_id"))


def _observations(tracked: DataFrame, reads: DataFrame) -> DataFrame:
    return tracked.join(reads, ["clip", "det_id"]).withColumn("seq", F.col("det_id"))


def _tracklets(obs: DataFrame, size: tuple[float, float], options: Options, margin: float = 20.0) -> DataFrame:
    """One row a track: extent, ends, place, likelihood."""
    view = options.visualization
    at = F.struct(*G.center(G.box()))
    ends = obs.groupBy("clip", "track_id").agg(F.min_by(at, "ts_s").alias("p"), F.max_by(at, "ts_s").alias("q"))
    likely = tracks.player_likelihood(tracks.extents(obs), tracks.edge_touches(obs, *size, margin), threshold=view.min_player_likelihood, min_duration=view.min_track_duration_sec)
    named = {"x0": "p.col1", "y0": "p.col2", "x1": "q.col1", "y1": "q.col2"}
    return (
        ends.join(tracks.extents(obs), "track_id").join(evidence.vertical_extent(obs), "track_id").join(likely, "track_id")
        .select("clip", "track_id", "n", "start_s", "end_s", "duration", "mean_quality", "mean_prob", "mean_y", "span_y", "likelihood", "is_player", *[F.col(c).alias(n) for n, c in named.items()])
    )


def _teams(tracked: DataFrame, kits: DataFrame, options: Options) -> DataFrame:
    o = options.team_classifier
    mean = tracked.join(kits, ["clip", "det_id"]).groupBy("track_id", "team").agg(F.avg("distance").alias("distance"))
    return fusion.team_posterior(mean, temperature=o.temperature, cap=o.unfit_confidence_cap, unknown=o.unknown_color_distance)


def _posterior(tracklets: DataFrame, roster: DataFrame, teams: DataFrame, labels: DataFrame, heads: DataFrame, bodies: DataFrame, options: Options) -> DataFrame:
    return fusion.fuse(tracklets, roster, teams, labels, heads, bodies, on="clip", weights=options.fusion.named(), temperature=options.fusion.temperature)


def _assigned(tracklets: DataFrame, posterior: DataFrame, options: Options) -> DataFrame:
    """track_id, resolved and confidence: the player with the most votes of the windows, if it is likely enough."""
    o = options.assignment
    spans = tracklets.where("is_player").select("clip", "track_id", "start_s", "end_s")
    windows = linking.active_windows(spans, o.window_sec, o.step_sec, clip="clip").join(spans, ["clip", "track_id"])
    shared = G.overlap_seconds(F.col("start_s"), F.col("end_s"), F.col("window_start"), F.col("window_start") + o.window_sec)
    windows = windows.select("clip", "window", "track_id", F.greatest(F.lit(0.0), shared).alias("overlap"))
    claims = windows.join(posterior.select("track_id", F.col("player").alias("label"), F.col("posterior").alias("prob")), "track_id")
    won = matching.assign(claims.where("prob >= 0.12"), ["clip", "window"]).join(windows, ["clip", "window", "track_id"])
    named = window_votes(won).select("track_id", F.col("label").alias("player"))
    sure = named.join(posterior, ["track_id", "player"]).where(F.col("posterior") >= o.identity_confidence_threshold)
    return sure.select("track_id", F.col("player").alias("resolved"), F.col("posterior").alias("confidence"))


def _candidates(obs: DataFrame, tracklets: DataFrame, teams: DataFrame, roster: DataFrame, options: Options) -> DataFrame:
    """track_id, team, jersey (after the cascade) and votes."""
    view = options.visualization
    counted = votes.top_k_votes(obs, peak=view.peak_lock_threshold)
    weights = votes.rarity(obs, peak=view.peak_lock_threshold, clip="clip")
    clip = tracklets.select("clip", "track_id")
    weighted = votes.weighted_votes(counted.join(clip, "track_id"), weights, clip="clip")
    ranked = votes.ranked_candidates(weighted, lock=view.peak_lock_min_count)
    team = evidence.argmax(teams, ["track_id"], "prob", "team").select("track_id", "team")
    rows = ranked.join(counted.select("track_id", "candidate", "peaks"), ["track_id", "candidate"]).join(team, "track_id").join(clip, "track_id")
    kept = matching.cascade_dedup(rows.withColumnRenamed("candidate", "label"), roster=roster.select("team", F.col("jersey").alias("label")), clip="clip")
    total = counted.groupBy("track_id").agg(F.sum("votes").alias("votes"))
    return team.join(kept.select("track_id", F.col("label").alias("jersey")), "track_id", "left").join(total, "track_id", "left")


def _settled(tracklets: DataFrame, assigned: DataFrame, candidates: DataFrame, obs: DataFrame, roster: DataFrame, options: Options) -> DataFrame:
    rows = tracklets.select("track_id", "duration", "is_player").join(candidates, "track_id", "left").join(assigned, "track_id", "left")
    players = roster.select("player", "team", "jersey", F.col("player").alias("nr"))
    frames = obs.groupBy("track_id").agg(F.collect_set("frame").alias("frames"))
    return evidence.resolve_until_stable(rows, players, frames, likely=options.visualization.likely_threshold)


def _stitched(tracklets: DataFrame, settled: DataFrame, gap: tuple[float, float]) -> DataFrame:
    """track_id, resolved and confidence, where chains of tracks share the identity of their surest member."""
    team = settled.select("track_id", "team", "resolved", "confidence", "votes")
    spans = tracklets.where("is_player").drop("mean_y", "span_y").join(team, "track_id")
    pairs = linking.gap_candidates(spans, *gap, clip="clip")
    chains = linking.gap_stitch(pairs, spans.select("track_id", F.coalesce("votes", F.lit(0.0)).alias("score")))
    chain = linking.components(chains.select(F.col("source").alias("a"), F.col("sink").alias("b")))
    members = team.join(chain, team["track_id"] == chain["node"], "left").select(
        F.coalesce("root", "track_id").alias("root"), "track_id", F.col("resolved").alias("identity"), F.coalesce("confidence", F.lit(0.0)).alias("confidence")
    )
    return linking.propagate(members).select("track_id", F.col("identity").alias("resolved"), "confidence")


def _evidence(tracklets: DataFrame, stitched: DataFrame, roster: DataFrame, teams: DataFrame, labels: DataFrame, heads: DataFrame) -> DataFrame:
    sure = P.track_confidence(F.col("n"), F.col("mean_quality"))
    facts = tracklets.select("track_id", F.lit(0.0).alias("body_confidence"), sure.alias("tracking_confidence"), "likelihood", "mean_y", "span_y")
    held = stitched.sparkSession.createDataFrame([], "track_id long, " + ", ".join(f"{f} double" for f in evidence.FIELDS))
    return evidence.refresh_evidence(stitched, held, roster.drop("clip"), teams, labels, heads, facts)


def _evaluated(truth: DataFrame, tracked: DataFrame, stitched: DataFrame, settled: DataFrame, roster: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row a clip: detection recall, jersey accuracy (of visible matched boxes), identity accuracy (of all boxes) and switches."""
    boxes = tracked.withColumn("pred_id", F.col("det_id"))
    who = settled.select("track_id", "jersey").join(stitched.select("track_id", "resolved"), "track_id", "full")
    number = roster.select(F.col("player").alias("name"), F.col("jersey").alias("_true"))
    rows = spatial.best_iou_match(truth, boxes, threshold, clip="clip").join(who, "track_id", "left").join(number, "name", "left")
    matched = F.col("track_id").isNotNull()
    seen = matched & F.col("visible")
    share = lambda a, b: F.round(F.count_if(F.coalesce(a, F.lit(False))) / F.greatest(F.lit(1), F.count_if(b)), 6)
    switches = spatial.id_switches(rows, clip="clip").groupBy("clip").agg(F.sum("switches").alias("id_switches"))
    out = rows.groupBy("clip").agg(
        F.count(F.lit(1)).alias("n_gt"),
        share(matched, F.lit(True)).alias("recall"),
        share(seen & (F.col("jersey") == F.col("_true")), seen).alias("jersey_accuracy"),
        share(F.col("resolved") == F.col("name"), F.lit(True)).alias("identity_accuracy"),
    )
    return out.join(switches, "clip", "left").withColumn("id_switches", F.coalesce("id_switches", F.lit(0).cast("long")))


def resolve_clips(
    run: Run, detections: DataFrame, reads: DataFrame, kits: DataFrame, roster: DataFrame, truth: DataFrame, config: dict | None = None,
    *, size: tuple[float, float] = (1920.0, 1080.0), gap: tuple[float, float] = (3.0, 250.0), heads: DataFrame | None = None, bodies: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """The tables of all stages by name; ``evaluation`` has the metrics of each clip. size: of the frame; gap: seconds and distance that stitching bridges."""
    config = config or {}
    options = Options.of(config)
    none = run.spark.createDataFrame([], f"track_id long, player {roster.schema['player'].dataType.simpleString()}, sim double")
    heads, bodies = heads or none, bodies or none
    t: dict[str, DataFrame] = {}

    def stage(name: str, make, *after: str, options: object = None) -> None:
        t[name] = run.stage(name, make, after=("", *after), options=options)

    stage("tracks", lambda: _tracked(detections, config), options=(options.tracker, config.get("detector")))
    stage("observations", lambda: _observations(t["tracks"], reads), "tracks")
    stage("tracklets", lambda: _tracklets(t["observations"], size, options), "observations", options=(size, options.visualization))
    stage("teams", lambda: _teams(t["tracks"], kits, options), "tracks", options=options.team_classifier)
    stage("labels", lambda: votes.weighted_distribution(t["observations"]), "observations")
    stage("posterior", lambda: _posterior(t["tracklets"], roster, t["teams"], t["labels"], heads, bodies, options), "tracklets", "teams", "labels", options=options.fusion)
    stage("assigned", lambda: _assigned(t["tracklets"], t["posterior"], options), "tracklets", "posterior", options=options.assignment)
    stage("candidates", lambda: _candidates(t["observations"], t["tracklets"], t["teams"], roster, options), "observations", "tracklets", "teams", options=options.visualization)
    stage("settled", lambda: _settled(t["tracklets"], t["assigned"], t["candidates"], t["observations"], roster, options), "assigned", "candidates", options=options.visualization)
    stage("stitched", lambda: _stitched(t["tracklets"], t["settled"], gap), "settled", options=gap)
    stage("evidence", lambda: _evidence(t["tracklets"], t["stitched"], roster, t["teams"], t["labels"], heads), "stitched")
    stage("evaluation", lambda: _evaluated(truth, t["tracks"], t["stitched"], t["settled"], roster), "stitched")
    return t


def views(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The inputs over the given tables: clips of 22 users, two teams of eleven; a quarter of the reads and a ninth of the colours are wrong."""
    from tracklake.sources import views as S

    name, det = F.col("name"), F.col("pred_id")
    clip = F.expr("name div 22")
    team = lambda n: F.concat(F.expr("name div 22").cast("string"), F.lit("-"), n.cast("string"))
    side, jersey = F.expr("pmod(name, 22) div 11"), F.pmod(name, F.lit(11)) + 1
    gt = S.gt_boxes(spark, sf_dir)
    owner = gt.select(F.col("gt_id").alias("pred_id"), "name")
    boxes = S.pred_boxes(spark, sf_dir).join(owner, "pred_id")
    detections = boxes.select(clip.alias("clip"), "frame", det.alias("det_id"), "x1", "y1", "x2", "y2", F.lit(0.9).alias("confidence"), F.col("track_id").alias("detector_id"))
    seen = S.observations(spark, sf_dir).select(F.col("seq").alias("det_id"), F.col("track_id").alias("name"), "ts_s", "quality", "prob")
    wrong = F.pmod(name + 4, F.lit(11)) + 1
    reads = seen.select(clip.alias("clip"), "det_id", "ts_s", "quality", F.when(F.pmod("det_id", F.lit(4)) == 0, wrong).otherwise(jersey).cast("string").alias("candidate"), "prob")
    near = F.when((F.pmod("det_id", F.lit(9)) == 0) == (F.col("s") == F.expr("pmod(name, 22) div 11")), 0.4).otherwise(0.1)
    kits = seen.withColumn("s", F.explode(F.array(F.lit(0), F.lit(1)))).select(clip.alias("clip"), "det_id", team(F.col("s")).alias("team"), near.alias("distance"))
    position = F.element_at(F.array(*[F.lit(p) for p in ("GK", "DF", "MF", "FW")]), (F.pmod(name, F.lit(4)) + 1).cast("int"))
    roster = gt.select("name").distinct().select(clip.alias("clip"), name.alias("player"), team(side).alias("team"), jersey.cast("string").alias("jersey"), position.alias("position"))
    return {"detections": detections, "reads": reads, "kits": kits, "roster": roster, "truth": gt.withColumn("clip", clip)}


#: The run over the given tables: their frames are hours, and the detector brings track ids.
CONFIG = {
    "tracker": {"backend": "bytetrack"}, "detector": {"use_tracking": True}, "assignment": {"window_sec": 7 * 86400.0, "step_sec": 3.5 * 86400.0, "identity_confidence_threshold": 0.3},
    "visualization": {"min_player_likelihood": 0.2},
}


def resolved_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four metrics of every clip of the given tables after a whole run."""
    import uuid

    linking._ensure_checkpoint_dir(spark.range(0))
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/run-{uuid.uuid4().hex}"
    got = resolve_clips(Run(spark, folder, sf_dir), **views(spark, sf_dir), config=CONFIG, size=(1000.0, 1200.0), gap=(6 * 3600.0, 250.0))
    return got["evaluation"]

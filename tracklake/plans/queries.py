"""The registered queries over the engine's views, each a composition of operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklake.functions import color as C
from tracklake.functions import geometry as G
from tracklake.functions import probability as P
from tracklake.functions import text as T
from tracklake.operators import evaluate, fusion, linking, matching, retrieval, spatial, tracks, votes
from tracklake.sources import views as S
from tracklake.streaming import tracker

Query = Callable[[SparkSession, str], DataFrame]
HOUR = 3600.0
DIM = 64


def _r(*names: str, digits: int = 6):
    return {n: F.round(n, digits) for n in names}


def _spans(spark, d):
    """Fragments as tracks: extent, end points, team and identity."""
    f = S.fragments(spark, d)
    at = F.struct("x", "y")
    g = f.groupBy("track_id", "user_id").agg(
        F.min("ts_s").alias("start_s"), F.max("ts_s").alias("end_s"), F.min_by(at, "seq").alias("p"), F.max_by(at, "seq").alias("q"),
        F.count(F.lit(1)).alias("n"), F.sum(votes.contribution()).alias("score"),
    )
    return g.select(
        "track_id", "user_id", F.pmod("user_id", F.lit(5)).alias("team"), F.pmod("user_id", F.lit(25)).alias("identity"), "start_s", "end_s",
        F.col("p.x").alias("x0"), F.col("p.y").alias("y0"), F.col("q.x").alias("x1"), F.col("q.y").alias("y1"), "n", "score",
    )


def track_eval_summary(spark, d):
    return spatial.evaluation_summary(S.gt_boxes(spark, d), S.pred_boxes(spark, d))


def track_eval_by_player(spark, d):
    return spatial.rates(spatial.judged(S.gt_boxes(spark, d), S.pred_boxes(spark, d)), ["name"])


def id_switches(spark, d):
    return spatial.id_switches(spatial.best_iou_match(S.gt_boxes(spark, d), S.pred_boxes(spark, d)))


def best_box_match(spark, d):
    return spatial.best_iou_match(S.gt_boxes(spark, d), S.pred_boxes(spark, d)).select("gt_id", "track_id", "pred_id", F.round("iou", 6).alias("iou"))


def confusion_topn(spark, d):
    return spatial.confusions(spatial.judged(S.gt_boxes(spark, d), S.pred_boxes(spark, d)))


def track_extents(spark, d):
    return tracks.extents(S.observations(spark, d)).withColumns(_r("start_s", "end_s", "duration", digits=3) | _r("mean_quality", "mean_prob"))


def min_observation_tracks(spark, d):
    kept = tracks.with_min_observations(S.fragments(spark, d), 5)
    return kept.groupBy("track_id", "track_seq").agg(F.count(F.lit(1)).alias("n"))


def candidate_votes_topk(spark, d):
    return votes.top_k_votes(S.observations(spark, d), k=8).withColumns(_r("votes"))


def candidate_idf(spark, d):
    return votes.rarity(S.observations(spark, d)).withColumns(_r("weight"))


def _weighted(spark, d):
    obs = S.observations(spark, d)
    return votes.weighted_votes(votes.top_k_votes(obs, k=8), votes.rarity(obs))


def candidate_best(spark, d):
    return votes.best_candidate(_weighted(spark, d)).withColumns(_r("score"))


def candidate_ranked(spark, d):
    return votes.ranked_candidates(_weighted(spark, d)).withColumns(_r("score"))


def candidate_longer_lock(spark, d):
    o = S.observations(spark, d)
    k = F.round(F.col("prob") * 99).cast("int")
    short = F.when(F.pmod("seq", F.lit(2)) == 0, k.cast("string")).otherwise(F.substring(k.cast("string"), 1, 1))
    return votes.longer_lock(votes.top_k_votes(o.withColumn("candidate", short), peak=0.3), lock=1)


def weighted_distribution(spark, d):
    return votes.weighted_distribution(S.observations(spark, d)).withColumns(_r("prob", "quality"))


def distribution_merge_max(spark, d):
    return votes.merge_max(S.observations(spark, d), ["track_id"]).withColumns(_r("prob"))


def distribution_merge_weighted(spark, d):
    o = votes.weighted_distribution(S.observations(spark, d))
    m = votes.merge_max(S.observations(spark, d), ["track_id"])
    return votes.weighted_merge(o, m, ["track_id"]).withColumns(_r("prob"))


def confusable_smoothing(spark, d):
    o = S.observations(spark, d)
    label = F.round(F.col("prob") * 99).cast("int").cast("string")
    dist = votes.weighted_distribution(o.withColumn("candidate", label))
    return votes.smooth_confusable(dist, ["track_id"]).withColumns(_r("prob"))


def top_hit_rates(spark, d):
    o = S.observations(spark, d)
    truth = o.groupBy("track_id").agg(F.max_by("candidate", "seq").alias("truth"))
    got = votes.top_hits(votes.ranked_candidates(_weighted(spark, d)), truth, ["track_id"])
    return got.withColumns(_r("top1", "top3"))


def _team_distances(spark, d):
    teams = spark.range(5).select(F.col("id").alias("t"), F.concat(F.lit("team"), "id").alias("team"))
    e = tracks.extents(S.observations(spark, d)).withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))))
    return e.join(teams, "t").select("track_id", "team", (F.abs(F.col("mean_quality") - F.col("t") / 5.0) + F.pmod(F.col("track_id") + F.col("t"), F.lit(7)) / 20.0).alias("distance"))


def team_posterior_softmax(spark, d):
    return fusion.team_posterior(_team_distances(spark, d)).withColumns(_r("prob"))


def edge_touch_upper_median(spark, d):
    got = tracks.edge_touches(S.gt_boxes(spark, d).withColumnRenamed("name", "track_id"), 1000.0, 1200.0, 20.0)
    return got.withColumns(_r(*[c for c in got.columns if c != "track_id"]))


def player_likelihood(spark, d):
    edges = tracks.edge_touches(S.gt_boxes(spark, d).withColumnRenamed("name", "track_id"), 1000.0, 160.0, 20.0)
    return tracks.player_likelihood(tracks.extents(S.observations(spark, d)), edges).withColumns(_r("likelihood"))


def roster_validity(spark, d):
    regions = S.roster(spark, d).select("team").distinct().withColumn("t", F.row_number().over(Window.orderBy("team")) - 1)
    o = S.observations(spark, d).groupBy("track_id").agg(F.min("seq").alias("s"))
    labelled = o.withColumn("t", F.pmod("track_id", F.lit(6))).join(regions, "t", "left").select("track_id", "team", F.pmod("s", F.lit(25)).cast("string").alias("label"))
    return linking.gate_by_roster(labelled, S.roster(spark, d).withColumnRenamed("jersey", "label"))


def gap_candidates(spark, d):
    return linking.gap_candidates(_spans(spark, d), 6 * HOUR, 250.0).withColumns(_r("gap", digits=3) | _r("distance"))


def gap_nearest(spark, d):
    return linking.gap_nearest(_spans(spark, d), 6 * HOUR, 250.0).select("a", "b", F.round("distance", 6).alias("distance"))


def gap_stitch(spark, d):
    return linking.stitch_tracks(_spans(spark, d), 6 * HOUR, 250.0)


def fragment_inherit(spark, d):
    s = _spans(spark, d)
    f = S.fragments(spark, d).groupBy("track_id", "candidate").agg(F.sum(votes.contribution()).alias("score"))
    top = f.groupBy("track_id").agg(F.max("score").alias("best_score"), F.max_by("candidate", F.struct("score", "candidate")).alias("label"))
    w = s.join(top, "track_id")
    losers = w.where(F.pmod("track_id", F.lit(3)) == 0).select("track_id", "team", "start_s", "end_s", "best_score")
    winners = w.where(F.pmod("track_id", F.lit(3)) != 0).select("track_id", "team", "label", "start_s", "end_s", F.col("best_score").alias("score"))
    return linking.inherit_labels(losers, winners, f, max_overlap=0.5, min_ratio=0.2)


def window_active_tracks(spark, d):
    w = linking.active_windows(_spans(spark, d), 24 * HOUR, 12 * HOUR)
    return w.groupBy("window").agg(F.count(F.lit(1)).alias("n_tracks"), F.sum("track_id").alias("id_sum"))


def overlap_ratio(spark, d):
    return linking.overlap_pairs(_spans(spark, d), 24 * HOUR).select("identity", "a", "b", F.round("seconds", 3).alias("seconds"), F.round("ratio", 6).alias("ratio"))


def frame_overlap_ratio(spark, d):
    o = S.observations(spark, d).withColumn("identity", F.pmod("track_id", F.lit(25)))
    return linking.shared_frames(o, ["identity"]).withColumns(_r("ratio_a", "ratio_b"))


def track_pair_edges(spark, d):
    return linking.gap_candidates(_spans(spark, d), 2 * HOUR, 150.0).select("a", "b")


def identity_components(spark, d):
    return linking.components(linking.gap_forest(_spans(spark, d), 2 * HOUR, 150.0))


def group_propagation(spark, d):
    s = _spans(spark, d)
    c = identity_components(spark, d)
    members = c.join(s, c.node == s.track_id).select(
        "root", "track_id", F.when(F.pmod("track_id", F.lit(3)) == 0, F.col("identity")).alias("identity"), (F.pmod("track_id", F.lit(11)) / 10.0).alias("confidence")
    )
    return linking.propagate(members).withColumns(_r("confidence"))


def simple_dedup(spark, d):
    s = _spans(spark, d)
    return linking.simple_dedup(s.select("track_id", "team", F.col("identity").alias("label"), F.round("score", 6).alias("score")))


def frame_label_dedup(spark, d):
    g = S.gt_boxes(spark, d).select("gt_id", "frame", F.pmod("name", F.lit(5)).alias("identity"), F.round(F.col("y1"), 6).alias("strength"))
    return linking.strongest_per_frame(g)


def conflict_resolution(spark, d):
    o = S.observations(spark, d)
    claims = o.groupBy("track_id").agg(F.collect_set("frame_index").alias("frames"), F.sum(votes.contribution()).alias("score")).withColumn("identity", F.pmod("track_id", F.lit(25)))
    return linking.demote_conflicts(claims.select("identity", "track_id", "score", "frames"), 0.2)


def interp_positions(spark, d):
    f = S.fragments(spark, d)
    a = f.where(F.pmod("seq", F.lit(3)) == 0).select(F.col("user_id").alias("key"), F.col("ts_s").alias("t"), "x", "y")
    q = f.where(F.pmod("seq", F.lit(3)) != 0).select(F.col("user_id").alias("key"), F.col("ts_s").alias("at"))
    return tracks.interpolate_positions(a, q).select("key", F.round("at", 3).alias("at"), F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


def jump_segments(spark, d):
    s = tracks.jump_segments(S.fragments(spark, d), 0.02)
    return tracks.segment_extents(s).select("track_id", "segment", "n", F.round("start_s", 3).alias("start_s"), F.round("end_s", 3).alias("end_s"), "new_id")


def team_flip_segments(spark, d):
    o = S.observations(spark, d)
    team = F.when(F.pmod("seq", F.lit(4)) == 0, F.lit(None).cast("string")).otherwise(F.when(F.col("prob") > 0.5, "home").otherwise("away"))
    return tracks.team_flip_segments(o.withColumn("team", team))


def label_cascade(spark, d):
    o = S.observations(spark, d)
    m = lambda n: F.pmod("seq", F.lit(n))
    name = F.when(m(4) != 0, F.concat(F.lit("P"), "track_id"))
    jersey = F.when(m(3) != 0, m(25).cast("string"))
    role = F.when(m(17) == 0, "referee").when(m(19) == 0, "goalkeeper")
    return o.select("seq", fusion.render_label(name, jersey, role, F.col("prob"), F.col("quality") * 10).alias("label"))


def _embedded(spark, d):
    a = S.appearance(spark, d)
    return a.where(F.pmod("vec_id", F.lit(20)) == 0), a


def retrieval_map(spark, d):
    return retrieval.retrieval_metrics(*_embedded(spark, d))


def retrieval_rank_k(spark, d):
    r = retrieval.top_k(*_embedded(spark, d), 5)
    return r.select("q_id", "rank", "vec_id", F.round("similarity", 6).alias("similarity"))


def temporal_split(spark, d):
    return retrieval.temporal_split(S.appearance(spark, d), DIM)


def centroid_median(spark, d):
    return retrieval.centroid_medians(S.appearance(spark, d), DIM).withColumns(_r("value"))


def registry_nn_margin(spark, d):
    q, a = _embedded(spark, d)
    team = F.when(F.pmod("vec_id", F.lit(9)) != 0, F.pmod("vec_id", F.lit(2)))
    return retrieval.nearest_with_margin(q.withColumn("team", team), a.withColumn("team", team), 0.25, 0.01, team="team").withColumns(_r("similarity"))


def fusion_sweep(spark, d):
    q, a = _embedded(spark, d)
    other = lambda df: df.withColumn("other", F.slice("embedding", 1, 32))
    return retrieval.fusion_sweep(other(q), other(a), [0.0, 0.25, 0.5, 0.75, 1.0])


def best_weight(spark, d):
    return retrieval.best_weight(fusion_sweep(spark, d))


def adjacent_frames(spark, d):
    return retrieval.adjacent_frames(S.appearance(spark, d))


def set_precision_recall(spark, d):
    """Names shown per day against names expected: precision, recall, missed and extra counts."""
    o = S.observations(spark, d).withColumn("day", F.floor(F.col("ts_s") / 86400))
    return evaluate.set_scores(o.where("prob >= 0.5"), o.where("quality >= 0.3"), "day", "track_id").withColumns(_r("precision", "recall"))


def coverage_hours(spark, d):
    s = _spans(spark, d).withColumn("hour", F.explode(F.sequence(F.floor(F.col("start_s") / HOUR), F.floor(F.col("end_s") / HOUR))))
    return s.groupBy("user_id").agg(F.countDistinct("hour").alias("hours"), F.countDistinct("track_id").alias("fragments"))


def mot_summary(spark, d):
    return evaluate.sequence_summary(S.mot_boxes(spark, d))


def interval_scores(spark, d):
    """Best interval overlap of one label's tracks with those of the next track number."""
    o = S.observations(spark, d).groupBy(F.col("candidate").alias("label"), "track_id").agg(F.min("ts_s").alias("s"), F.max("ts_s").alias("e"))
    a, b = o.alias("a"), o.alias("b")
    c = lambda x: F.col(x)
    j = a.join(b, (c("a.label") == c("b.label")) & (c("b.track_id") == c("a.track_id") + 1))
    return j.select(F.col("a.label").alias("label"), F.col("a.track_id").alias("track_id"), F.round(G.interval_iou(c("a.s"), c("a.e"), c("b.s"), c("b.e")), 6).alias("iou"))


def ascii_names(spark, d):
    t = S.table(spark, d, "documents")
    return t.select("doc_id", F.md5(T.strip_accents(F.coalesce("text", F.lit(""))).cast("binary")).alias("plain_md5"))


def category_parse(spark, d):
    o = S.gt_boxes(spark, d)
    m = F.pmod("gt_id", F.lit(5))
    who = F.concat(F.pmod("gt_id", F.lit(23)).cast("string"), F.lit(" Álvarez "), "name")
    cat = F.when(m == 0, "referee").when(m == 1, F.concat(F.lit("Goalkeeper "), who)).when(m == 2, F.concat(F.lit("for tracker "), who)).when(m == 3, "Player-Detection").otherwise(who)
    return o.select("gt_id", T.parse_category(cat).alias("c")).select("gt_id", "c.*")


def digit_runs(spark, d):
    t = S.table(spark, d, "conversations").withColumn("runs", T.digit_runs(F.coalesce("text", F.lit(""))))
    return t.select("conv_id", "turn", F.size("runs").alias("n_runs"), F.array_join("runs", ",").alias("runs"))


def file_frames(spark, d):
    o = S.gt_boxes(spark, d)
    name = F.when(F.pmod("gt_id", F.lit(9)) == 0, "none.jpg").otherwise(F.concat(F.lit("clip_mp4-"), F.lpad(F.pmod("gt_id", F.lit(50)).cast("string"), 4, "0"), F.lit("_jpg")))
    return o.select("gt_id", T.frame_of_file(name).alias("frame_of"))


def player_keys(spark, d):
    r = S.roster(spark, d)
    return r.select("player", T.player_key(F.col("team"), F.col("player"), F.when(F.col("jersey") != "7", F.col("jersey"))).alias("player_id"), T.slug(F.col("player")).alias("slug"))


def kit_distances(spark, d):
    p = S.table(spark, d, "part")
    ch = lambda n: F.pmod(F.col("p_partkey") * n, F.lit(256)).cast("int")
    a, b = (ch(1), ch(7), ch(13)), (ch(3), ch(5), ch(11))
    h, s, v = C.hsv(a)
    return p.select("p_partkey", h.alias("hue"), s.alias("saturation"), v.alias("brightness"), F.round(C.kit_distance(a, b), 4).alias("distance"))


def tail_drop(spark, d):
    """Rounded at fourteen digits first, so that the ninth does not hang on the order in which a sum was made."""
    m = S.observations(spark, d).groupBy("track_id", "candidate").agg(F.sum("prob").alias("p")).groupBy("track_id").agg(F.map_from_entries(F.collect_list(F.struct("candidate", "p"))).alias("m"))
    kept = m.select("track_id", F.explode(P.drop_tail(P.normalize_map(F.col("m")), 0.15)).alias("candidate", "prob"))
    return kept.withColumns(_r("prob", digits=14)).withColumns(_r("prob", digits=9))


def confidence_ema(spark, d):
    return tracks.confidence_ema(S.observations(spark, d)).withColumns(_r("confidence"))


def greedy_match(spark, d):
    return spatial.greedy_one_to_one(S.gt_boxes(spark, d), S.pred_boxes(spark, d)).withColumns(_r("iou"))


def _window_claims(spark, d):
    s = _spans(spark, d)
    w = linking.active_windows(s, 24 * HOUR, 12 * HOUR).join(s, "track_id")
    f = S.fragments(spark, d).groupBy("track_id", "candidate").agg(F.avg("prob").alias("prob"))
    return w.join(f, "track_id").select("window", "team", "track_id", F.col("candidate").alias("label"), "prob", ((F.col("end_s") - F.col("start_s")) / HOUR).alias("duration"))


def optimal_assignment(spark, d):
    return matching.assign(_window_claims(spark, d), ["window", "team"]).withColumns(_r("prob"))


def window_conflicts(spark, d):
    return matching.resolve_window_conflicts(_window_claims(spark, d))


def cascade_dedup(spark, d):
    """All gates: peaks as counted in the votes, roles by track, and each team's roster without one of the labels."""
    f = S.fragments(spark, d).groupBy("track_id", "user_id", "candidate").agg(F.sum(votes.contribution()).alias("score"), F.count_if(F.col("prob") >= votes.PEAK).alias("peaks"))
    order = Window.partitionBy("track_id").orderBy(F.desc("score"), "candidate")
    team, role = F.pmod("user_id", F.lit(5)), F.when(F.pmod("user_id", F.lit(17)) == 0, "referee").when(F.pmod("user_id", F.lit(19)) == 0, "goalkeeper")
    roster = f.select(team.alias("team"), F.col("candidate").alias("label")).distinct().where(F.pmod(F.xxhash64("label"), F.lit(5)) != F.col("team"))
    ranked = f.select(team.alias("team"), "track_id", F.row_number().over(order).alias("rank"), F.col("candidate").alias("label"), "score", "peaks", role.alias("role"))
    return matching.cascade_dedup(ranked, roster=roster)


def anchor_clusters(spark, d):
    at = F.pmod("vec_id", F.lit(50))
    a = S.appearance(spark, d).select(
        F.col("vec_id").alias("anchor_id"), F.expr("vec_id div 100").alias("clip"), F.pmod("vec_id", F.lit(7)).alias("team"), F.expr("vec_id div 3").alias("track_id"),
        F.sequence(at, at + 2).alias("frames"), (F.pmod("vec_id", F.lit(97)) / 97.0).alias("score"), "embedding",
    )
    return matching.cluster_anchors(a, 0.1, group=["clip", "team"])


def online_tracker(spark, d):
    g = S.gt_boxes(spark, d)
    det = g.select(F.pmod("name", F.lit(8)).alias("clip"), "frame", F.col("gt_id").alias("det_id"), "x1", "y1", "x2", "y2", F.lit(0.9).alias("confidence"))
    return tracker.track_batch(det).withColumns(_r("confidence"))


def track_summary(spark, d):
    """Summaries with the candidates as text: rank, label and score in ten thousandths."""
    from tracklake.sources.files import summary_rows

    w = _weighted(spark, d)
    got = summary_rows(votes.best_candidate(w), votes.ranked_candidates(w), tracks.extents(S.observations(spark, d)))
    line = lambda c: F.concat_ws(":", c["rank"].cast("string"), c["candidate"], F.round(c["score"] * 10000).cast("long").cast("string"))
    return got.withColumn("candidates", F.array_join(F.transform("candidates", line), ","))


NAMES = (
    "track_eval_summary track_eval_by_player id_switches best_box_match confusion_topn track_extents min_observation_tracks candidate_votes_topk candidate_idf "
    "candidate_best candidate_ranked candidate_longer_lock weighted_distribution distribution_merge_max distribution_merge_weighted confusable_smoothing "
    "top_hit_rates team_posterior_softmax edge_touch_upper_median player_likelihood roster_validity gap_candidates gap_nearest gap_stitch "
    "fragment_inherit window_active_tracks overlap_ratio frame_overlap_ratio track_pair_edges identity_components group_propagation simple_dedup frame_label_dedup "
    "conflict_resolution interp_positions jump_segments team_flip_segments label_cascade retrieval_map retrieval_rank_k temporal_split centroid_median "
    "registry_nn_margin fusion_sweep best_weight adjacent_frames set_precision_recall coverage_hours mot_summary interval_scores ascii_names category_parse digit_runs file_frames player_keys "
    "kit_distances tail_drop confidence_ema greedy_match optimal_assignment window_conflicts cascade_dedup anchor_clusters online_tracker track_summary"
).split()
QUERIES: dict[str, Query] = {n: globals()[n] for n in NAMES}

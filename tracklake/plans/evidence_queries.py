"""Registered queries on evidence, filters, registries, evaluation and generated inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracklake.functions import color as C
from tracklake.functions import geometry as G
from tracklake.functions import probability as P
from tracklake.functions import text as T
from tracklake.functions import vector as V
from tracklake.operators import evaluate, evidence, filters, fusion, identity, linking, matching, ranking, registry, spatial, tracks, votes
from tracklake.plans.queries import DIM, HOUR, _r, _spans, _team_distances, _window_claims
from tracklake.sources import files, generate
from tracklake.sources import views as S


def _mod(column, n):
    return F.pmod(column, F.lit(n))


def _regions(spark, d):
    return S.table(spark, d, "region").select(F.col("r_regionkey").cast("string").alias("t"), F.col("r_name").alias("team"))


def _team_probs(spark, d):
    """Team probabilities by name; every seventh is missing."""
    p = fusion.team_posterior(_team_distances(spark, d)).withColumn("t", F.substring("team", 5, 1)).drop("team").join(_regions(spark, d), "t")
    return p.where(_mod(F.col("track_id") + F.col("t").cast("int"), 7) != 0).select("track_id", "team", "prob")


def _label_probs(spark, d):
    o = S.observations(spark, d).where(_mod(F.col("track_id"), 6) != 5)
    return votes.weighted_distribution(o.withColumn("candidate", _mod(F.col("seq"), 11).cast("string")))


def _sims(spark, d, a, b, n):
    """Similarities of tracks and players that are known for some pairs only."""
    t = S.summary(spark, d).select("track_id").withColumn("nr", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(24).cast("long"))))
    some = t.where(_mod(F.col("track_id") * a + F.col("nr") * b, n) == 0)
    return some.join(S.squad(spark, d).select("nr", "player"), "nr").select("track_id", "player", (_mod(F.col("track_id") * b + F.col("nr") * a, 101) / 100.0).alias("sim"))


def _track_facts(spark, d):
    y = evidence.vertical_extent(S.gt_boxes(spark, d).withColumnRenamed("name", "track_id"))
    return tracks.extents(S.observations(spark, d)).join(y, "track_id").withColumn("clip", F.lit(1))


def _fused(spark, d):
    roster = S.squad(spark, d).withColumn("clip", F.lit(1))
    return fusion.fuse(_track_facts(spark, d), roster, _team_probs(spark, d), _label_probs(spark, d), _sims(spark, d, 3, 5, 4), _sims(spark, d, 7, 2, 3))


def fusion_posterior(spark, d):
    return _fused(spark, d).withColumns(_r("score", "posterior"))


def resolved_players(spark, d):
    p = _fused(spark, d).withColumn("posterior", F.round("posterior", 9))
    return evidence.dominant_team(p, S.squad(spark, d)).withColumns(_r("confidence"))


def map_argmax(spark, d):
    """The likeliest team of every track; equal ones by the first in order."""
    return evidence.argmax(_team_probs(spark, d).withColumn("prob", F.round("prob", 9)), ["track_id"], "prob", "team").withColumns(_r("prob"))


def body_confidence(spark, d):
    o = S.observations(spark, d).withColumn("has_body", (_mod(F.col("seq"), 3) == 0) & (_mod(F.col("track_id"), 8) != 1))
    return evidence.body_confidence(o).withColumns(_r("body_confidence"))


def gallery_similarity(spark, d):
    """Track means against the first embedding of each identity: (cosine + 1) / 2."""
    a = S.appearance(spark, d)
    w = F.greatest(F.lit(0.01), _mod(F.col("vec_id"), 10) / 10.0)
    t = a.groupBy(_mod(F.col("vec_id"), 7).alias("track_id")).agg(V.weighted_mean_vector("embedding", w, DIM).alias("embedding")).withColumn("clip", F.lit(1))
    g = evidence.first_of(a, ["identity"], F.col("vec_id")).select(F.lit(1).alias("clip"), F.col("identity").alias("player"), F.when(_mod(F.col("identity"), 4) != 3, F.col("embedding")).alias("embedding"))
    return evidence.gallery_similarity(t, g, "clip").withColumns(_r("sim"))


def memory_similarity(spark, d):
    asked = S.summary(spark, d).select("track_id", F.col("resolved").alias("player")).where("player is not null")
    return evidence.memory_similarity(asked, _sims(spark, d, 7, 2, 3)).withColumns(_r("sim"))


def evidence_refresh(spark, d):
    facts = _track_facts(spark, d).where(_mod(F.col("track_id"), 12) != 3).join(body_confidence(spark, d), "track_id").withColumn("tracking_confidence", P.track_confidence(F.col("n"), F.col("mean_quality")))
    facts = facts.withColumn("likelihood", F.col("mean_prob"))
    held = S.summary(spark, d).where(_mod(F.col("track_id"), 4) != 2).select("track_id", *[(F.round("confidence", 4) * k).alias(f) for k, f in enumerate(evidence.FIELDS, 1)])
    got = evidence.refresh_evidence(S.summary(spark, d), held, S.squad(spark, d).drop("nr"), _team_probs(spark, d), _label_probs(spark, d), _sims(spark, d, 3, 5, 4), facts)
    return got.withColumns(_r(*evidence.FIELDS))


def player_of_jersey(spark, d):
    return evidence.player_of_jersey(S.summary(spark, d), S.squad(spark, d))


def first_and_last_match(spark, d):
    p = S.squad(spark, d).withColumn("jersey", _mod(F.col("nr"), 2).cast("string"))
    one, two = (evidence.by_team_and_jersey(p, k).select("team", "jersey", F.col("player").alias(k)) for k in ("first", "last"))
    return one.join(two, ["team", "jersey"])


def primary_identity(spark, d):
    return evidence.primary_identity(S.summary(spark, d), S.squad(spark, d), 0.45)


def claim_strength(spark, d):
    """Tracks by their claim: confidence with votes and duration as small weights."""
    s = S.summary(spark, d).withColumn("strength", F.round(evidence.claim_strength(), 9))
    ranked = ranking.global_rank(s, -F.floor(F.col("strength") * 50), [F.desc("strength"), F.col("track_id")], "place")
    return ranked.select("track_id", "place", F.round("strength", 6).alias("strength"))


def conflicts_until_stable(spark, d):
    frames = S.observations(spark, d).groupBy("track_id").agg(F.collect_set("frame_index").alias("frames"))
    got = evidence.resolve_until_stable(S.summary(spark, d).withColumn("is_player", F.lit(True)), S.squad(spark, d), frames, ratio=0.05)
    return got.select("track_id", "resolved", F.round("confidence", 6).alias("confidence"), "jersey", "demoted_from")


def _visible(spark, d):
    """The jerseys that are visible: some of each team, and none of one team."""
    return S.squad(spark, d).where((F.col("team") != "ASIA") & (_mod(F.col("nr"), 3) != 0)).select("team", "jersey")


def snapshot_retention(spark, d):
    return evidence.snapshots(S.summary(spark, d), S.squad(spark, d), _visible(spark, d))


def summary_mirror(spark, d):
    t = tracks.extents(S.observations(spark, d)).select("track_id", "n")
    return evidence.mirror(t, S.summary(spark, d).where(_mod(F.col("track_id"), 5) != 4), "jersey")


def relabelled_run(spark, d):
    s = S.summary(spark, d).withColumn("likelihood", F.col("votes") / 10)
    best = votes.best_candidate(votes.top_k_votes(S.observations(spark, d), k=8)).withColumn("score", F.round("score", 6))
    return evidence.relabel(s.select("track_id", "is_player", "likelihood", "duration"), best, s.select("track_id", "team"), least_likelihood=0.46)


def identity_documents(spark, d):
    e = evidence.body_confidence(S.observations(spark, d).withColumn("has_body", F.lit(True)))
    got = evidence.identity_documents(S.summary(spark, d).select("track_id", "resolved"), S.squad(spark, d), _fused(spark, d), e)
    sized = F.round(F.aggregate(F.map_values("posterior"), F.lit(0.0), lambda a, x: a + x), 6)
    return got.select("track_id", F.col("resolved_player.team").alias("team"), F.size("posterior").alias("n_players"), sized.alias("total"), F.round("evidence.body_confidence", 6).alias("body_confidence"))


def visible_numbers(spark, d):
    p = S.table(spark, d, "part").select(_mod(F.col("p_partkey"), 120).alias("number"))
    return filters.ordered_numbers(p, "number")


def roster_numbers(spark, d):
    """The distinct numbers of all teams together."""
    s = S.squad(spark, d)
    lists = s.groupBy("team").agg(F.collect_list("jersey").alias("numbers"))
    return filters.ordered_numbers(lists.select(F.explode("numbers").alias("jersey")), "jersey")


def eligible_tracks(spark, d):
    s = S.summary(spark, d).withColumn("is_player", F.when(_mod(F.col("track_id"), 3) != 0, F.col("is_player")))
    return filters.without(filters.eligible(s), s.where(_mod(F.col("track_id"), 10) == 4)).select("track_id")


def cleared_roles(spark, d):
    return filters.clear_special(S.summary(spark, d), ["jersey", "resolved"]).select("track_id", "jersey", "resolved")


def rendered_tracks(spark, d):
    s = S.summary(spark, d).withColumn("likelihood", F.col("votes") / 10)
    return filters.rendered(s, least_likelihood=0.47, least_duration=20).select("track_id")


def classes_and_categories(spark, d):
    g = S.gt_boxes(spark, d)
    m = _mod(F.col("gt_id"), 5)
    cat = F.when(m == 0, "referee").when(m == 1, F.concat(F.lit("Goalkeeper 7 Keeper "), "name")).when(m == 2, "Player-Detection").when(m == 3, "someone").otherwise(F.concat(F.lit("9 Player "), "name"))
    rows = g.select("gt_id", _mod(F.col("gt_id"), 2).alias("class_id"), T.parse_category(cat).alias("c")).select("gt_id", "class_id", "c.*")
    return filters.judged_categories(filters.of_class(rows, 1)).select("gt_id", "jersey", "name")


def gated_evidence(spark, d):
    g = S.gt_boxes(spark, d)
    probs = F.create_map(F.lit("a"), F.lit(0.5), F.lit("b"), F.lit(0.25))
    rows = g.select("gt_id", "x1", "y1", "x2", "y2", probs.alias("probs"), F.lit(0.9).alias("quality"), F.when(_mod(F.col("gt_id"), 4) != 0, _mod(F.col("gt_id"), 10) / 10.0).alias("legible"))
    got = filters.gate_evidence(rows, least_width=26, least_height=20, least_legible=0.4)
    return got.select("gt_id", F.size("probs").alias("n"), "quality")


def plausible_boxes(spark, d):
    g = S.gt_boxes(spark, d).withColumn("fill", _mod(F.col("gt_id"), 100) / 100.0)
    got = filters.plausible_boxes(g, 900, 280, least_area=1000, aspect=(0.45, 0.7))
    return got.select("gt_id", *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2", "confidence")])


def crop_scores(spark, d):
    g = S.gt_boxes(spark, d)
    return g.select("gt_id", F.round(filters.crop_quality(F.least(F.lit(1.0), G.area(G.box()) / 1500), _mod(F.col("gt_id"), 13) / 12.0), 6).alias("quality"))


def digit_places(spark, d):
    t = S.table(spark, d, "conversations").withColumn("p", T.digit_run_places(F.coalesce("text", F.lit(""))))
    runs = F.array_join(F.transform("p", lambda x: F.concat(x["start"].cast("string"), F.lit(":"), x["run"])), ",")
    return t.select("conv_id", "turn", runs.alias("runs"))


def identity_edges(spark, d):
    """Fragments joined with embeddings; the guards in hours."""
    s = _spans(spark, d)
    e = S.appearance(spark, d).select(F.col("vec_id"), F.transform("embedding", lambda x: x / V.norm(F.col("embedding"))).alias("embedding"))
    first = s.withColumn("vec_id", F.expr("((user_id % 25) * 20 + track_id % 3)")).join(e, "vec_id", "left")
    nr = ranking.global_rank(first, F.floor(F.col("start_s") / HOUR), ["start_s", "track_id"], "seq")
    region = _regions(spark, d).withColumn("k", F.col("t").cast("long")).select("k", F.col("team").alias("name"))
    named = nr.withColumn("k", F.col("team")).drop("team").join(region, "k").withColumn("team", F.when(_mod(F.col("track_id"), 7) != 0, F.col("name")))
    rows = named.withColumn("jersey", F.when(_mod(F.col("track_id"), 4) != 0, _mod(F.col("user_id"), 8).cast("string")))
    return linking.identity_edges(rows, _visible(spark, d), least=0.2, max_gap=9 * HOUR, max_overlap=HOUR, max_distance=400.0)


def switch_segments(spark, d):
    f = S.fragments(spark, d).withColumn("frame", F.col("seq"))
    e = S.appearance(spark, d).select(F.col("vec_id"), "embedding")
    rows = f.withColumn("vec_id", F.when(_mod(F.col("seq"), 5) != 0, _mod(F.col("user_id") * 7 + F.expr("seq div 40"), 500))).join(e, "vec_id", "left")
    return tracks.switch_segments(rows, max_step=60.0, drop=0.45).select("track_id", "seq", "segment")


def team_hues(spark, d):
    rows = S.gt_boxes(spark, d).select("gt_id", _mod(F.col("x1").cast("long"), 256).cast("int").alias("r"), _mod(F.floor("y1"), 256).cast("int").alias("g"), _mod(F.col("gt_id"), 256).cast("int").alias("b"))
    return tracks.team_by_hue(rows, {"home": 20, "away": 110, "third": 150}).select("gt_id", "team")


def mean_colors(spark, d):
    o = S.observations(spark, d)
    c = lambda k: F.when(_mod(F.col("seq"), 4) != 0, _mod(F.col("seq") * k, 256).cast("double"))
    m = tracks.mean_colors(o.withColumns({"r": c(3), "g": c(5), "b": c(7)}))
    return m.select("track_id", *[F.round(x, 6).alias(x) for x in "rgb"])


def special_roles(spark, d):
    o = S.gt_boxes(spark, d)
    med = lambda c: F.percentile(c, F.lit(0.5))
    ch = lambda k, m: _mod(F.col("name") * k + _mod(F.col("gt_id"), 4), m)
    shorts = lambda k, m: F.when(_mod(F.col("name"), 6) != 0, ch(k, m))
    kit = o.groupBy(F.col("name").alias("track_id")).agg(
        F.count(F.lit(1)).alias("n"), med(ch(13, 256)).alias("r"), med(ch(29, 256)).alias("g"), med(ch(47, 256)).alias("b"), med(shorts(13, 200)).alias("sr"), med(shorts(29, 200)).alias("sg"), med(shorts(47, 200)).alias("sb")
    )
    return identity.special_roles(kit, [30, 100]).select("track_id", "hue", "saturation", "role")


def registry_build(spark, d):
    s = S.summary(spark, d)
    own = S.squad(spark, d).select(F.col("player").alias("resolved"), F.col("jersey").alias("own"))
    t = s.join(own, "resolved", "left").withColumn("jersey", F.when(_mod(F.col("track_id"), 3) != 0, F.col("own")).otherwise(F.col("jersey")))
    anchored = registry.anchored_tracks(t, S.squad(spark, d), _visible(spark, d), least=0.45)
    o = S.observations(spark, d).withColumn("vec_id", F.when(_mod(F.col("seq"), 4) != 0, _mod(F.col("seq"), 500))).join(S.appearance(spark, d).select("vec_id", "embedding"), "vec_id", "left")
    rows = o.select("track_id", "embedding", votes.contribution().alias("peak"))
    got = registry.build_registry(anchored, rows, DIM, peak=0.5)
    return got.select("player", "team", "n", F.posexplode("embedding").alias("place", "value")).withColumns(_r("value"))


def _reads(spark, d):
    o = S.observations(spark, d)
    return o.join(S.summary(spark, d).select("track_id", "team"), "track_id").select(F.col("seq").alias("obs_id"), "team", _mod(F.col("seq"), 10).cast("string").alias("candidate"), F.col("frame_index").alias("frame"), votes.contribution().alias("contribution"))


def forced_players(spark, d):
    return registry.forced_players(_reads(spark, d), S.squad(spark, d), 0.5)


def _gallery(spark, d):
    """One embedding for each player of the squad."""
    a = S.appearance(spark, d).select(F.col("vec_id").alias("nr"), "embedding")
    return S.squad(spark, d).join(a, "nr").select("player", "team", "embedding")


def registry_reassign(spark, d):
    r = _reads(spark, d)
    obs = r.withColumn("vec_id", F.when(_mod(F.col("obs_id"), 6) != 0, _mod(F.col("obs_id") * 3, 500))).join(S.appearance(spark, d).select("vec_id", "embedding"), "vec_id", "left")
    forced = registry.forced_players(r, S.squad(spark, d), 0.5)
    return registry.reassign(obs.select("obs_id", "frame", "team", "embedding"), forced, _gallery(spark, d), least=0.1, margin=0.02)


def reassigned_tracks(spark, d):
    """New ids of the players that got an observation, and tracks that keep one of their own."""
    got = linking.checkpointed(registry_reassign(spark, d))  # read twice
    rows = S.observations(spark, d).select(F.col("seq").alias("obs_id"), "track_id")
    new = registry.new_track_ids(got)
    old = registry.carried_over(rows, got).select(F.lit(None).cast("string").alias("player"), F.col("track_id").cast("string").alias("track_id"))
    return new.union(old)


def split_parents(spark, d):
    f = tracks.jump_segments(S.fragments(spark, d), 0.02)
    children = f.select(F.concat_ws("-", "track_id", "segment").alias("child"), "seq", F.col("ts_s").alias("t"), "x", "y")
    rows = S.fragments(spark, d).select("track_id", F.col("ts_s").alias("t"), "x", "y")
    return registry.split_parents(children, rows, ["t", "x", "y"])


def location_scores(spark, d):
    obs, expected, vectors = _location(spark, d)
    return registry.location_scores(obs, expected, reach=300.0, least_similarity=-0.2, least=0.4, vectors=vectors).withColumns(_r("score"))


def _location(spark, d):
    """Observations, where each user is expected in the frames of its own and the next user's, and the vectors that both name."""
    f = S.fragments(spark, d)
    a = f.where(_mod(F.col("seq"), 3) == 0).select(F.col("user_id").alias("key"), F.col("ts_s").alias("t"), "x", "y")
    vectors = S.appearance(spark, d).where("vec_id BETWEEN 0 AND 499").select("vec_id", "embedding")  # those that are named below
    o = f.where(_mod(F.col("seq"), 3) != 0).select(F.col("seq").alias("obs_id"), "track_id", "user_id", F.floor(F.col("ts_s") / HOUR).alias("frame"), "x", "y", _mod(F.col("seq"), 500).alias("vec_id"))
    obs = o.withColumn("team", F.when(_mod(F.col("user_id"), 8) != 0, _mod(F.col("user_id"), 5)))
    near = o.select("frame", F.explode(F.array(F.col("user_id"), F.col("user_id") + 1)).alias("key")).distinct().withColumn("at", F.col("frame") * HOUR)
    at = tracks.interpolate_positions(registry.trajectory(a), near.select("key", "at").distinct())
    expected = near.join(at, ["key", "at"]).withColumn("vec_id", _mod(F.col("key") * 11, 500))
    return obs, expected.select("frame", F.col("key").alias("player"), _mod(F.col("key"), 5).alias("team"), "x", "y", "vec_id"), vectors


def location_assignment(spark, d):
    obs, expected, vectors = _location(spark, d)
    obs = obs.join(vectors.select("vec_id"), "vec_id")  # locked ones too have a vector
    locked = obs.where(_mod(F.col("track_id"), 11) == 0).select("track_id", F.col("user_id").alias("player")).distinct()
    return registry.locate_observations(obs, expected, locked, reach=300.0, least_similarity=-0.2, least=0.4, vectors=vectors)


def _intervals(spark, d):
    s = _spans(spark, d).select("track_id", _mod(F.col("user_id"), 3).alias("label"), "start_s", (F.col("end_s") + 30000).alias("end_s"))
    odd = _mod(F.col("track_id"), 2) == 1
    return [s.where(c).select(F.col("track_id").alias("id"), "label", "start_s", "end_s") for c in (odd, ~odd)]


def interval_matches(spark, d):
    return evaluate.interval_matches(*_intervals(spark, d)).withColumns(_r("iou"))


def interval_f1(spark, d):
    p, t = _intervals(spark, d)
    return evaluate.f1_scores(p, t, evaluate.interval_matches(p, t)).withColumns(_r("precision", "recall", "f1"))


def _reader(spark, d, k):
    o = S.observations(spark, d)
    return o.select(F.expr("seq div 6").alias("item"), _mod(F.col("seq"), 3).alias("region"), _mod(F.col("seq") * k, 13).cast("string").alias("candidate"), F.round(F.col("prob"), 6).alias("prob"))


def _reader_truth(spark, d):
    return S.observations(spark, d).groupBy(F.expr("seq div 6").alias("item")).agg(_mod(F.max("seq"), 13).cast("string").alias("truth"))


def _known_numbers(spark):
    return spark.range(14).where("id % 5 <> 1").select(F.col("id").cast("string").alias("candidate"))


def _judged_reads(spark, d):
    dist = evaluate.read_distributions(_reader(spark, d, 5), _known_numbers(spark), smooth=True).withColumn("prob", F.round("prob", 9))
    return evaluate.judged_reads(dist, _reader_truth(spark, d))


def reader_summary(spark, d):
    return evaluate.reader_summary(_judged_reads(spark, d)).withColumns(_r("accuracy_pct", "top3_pct"))


def reader_confusions(spark, d):
    return evaluate.reader_confusions(_judged_reads(spark, d))


def reader_tallies(spark, d):
    return evaluate.label_tallies(_judged_reads(spark, d))


def ensemble_summary(spark, d):
    a, b = (votes.merge_max(_reader(spark, d, k), ["item"]) for k in (5, 7))
    dist = evaluate.ensemble(a, b, _known_numbers(spark)).withColumn("prob", F.round("prob", 9))
    return evaluate.reader_summary(evaluate.judged_reads(dist, _reader_truth(spark, d), substring=True)).withColumns(_r("accuracy_pct", "top3_pct"))


def silhouette_matches(spark, d):
    return evaluate.match_percentage(spatial.best_iou_match(S.gt_boxes(spark, d), S.pred_boxes(spark, d), 0.10), "pred_id").withColumns(_r("pct"))


def source_detections(spark, d):
    """Tracked boxes with the detection each came from, one to one at an overlap of 0.2."""
    return spatial.greedy_one_to_one(S.gt_boxes(spark, d), S.pred_boxes(spark, d), 0.2).withColumns(_r("iou"))


def adjacent_accuracy(spark, d):
    return evaluate.adjacent_assignment(S.appearance(spark, d)).withColumns(_r("accuracy_pct"))


def _display(spark, d):
    s = S.summary(spark, d)
    shown = s.select("track_id", F.when(F.col("confidence") >= 0.48, F.col("resolved")).alias("name"), (F.col("start_s") / 86400).alias("start_s"), (F.col("end_s") / 86400).alias("end_s"), "duration")
    return evaluate.display_report(shown, S.squad(spark, d).select(F.col("player").alias("name")), 20)


def display_report(spark, d):
    return _display(spark, d)


def display_scores(spark, d):
    return evaluate.display_scores(_display(spark, d)).withColumns(_r("recall", "precision"))


def best_run(spark, d):
    runs = S.observations(spark, d).groupBy(F.col("candidate").alias("run")).agg(F.round(F.avg("prob"), 4).alias("accuracy"))
    return evaluate.best_run(runs, "accuracy", "run")


def running_mean(spark, d):
    o = S.observations(spark, d).select(_mod(F.col("seq"), 5).alias("epoch"), F.col("prob").alias("loss"), (_mod(F.col("seq"), 32) + 1).alias("rows"))
    return evaluate.running_mean(o).withColumns(_r("loss"))


def top_anchors(spark, d):
    o = S.observations(spark, d).withColumn("vec_id", F.when(_mod(F.col("seq"), 4) != 0, _mod(F.col("seq"), 500))).join(S.appearance(spark, d).select("vec_id", "embedding"), "vec_id", "left")
    e = F.when(_mod(F.col("seq"), 9) == 0, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding"))
    reads = o.select(F.col("seq").alias("anchor_id"), "track_id", "candidate", F.round(votes.contribution(), 9).alias("score"), e.alias("embedding"))
    return matching.top_anchors(reads, 3, 0.3).select("anchor_id", "track_id", "candidate")


def detection_order(spark, d):
    """Detections of a frame from the top left."""
    g = S.gt_boxes(spark, d)
    return evidence_rank(g, ["frame"], ["y1", "x1", "gt_id"]).select("gt_id", "frame", "place")


def evidence_rank(df, key, order):
    from pyspark.sql import Window

    return df.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def detector_passthrough(spark, d):
    from tracklake.streaming import tracker

    g = S.gt_boxes(spark, d)
    det = g.select(_mod(F.col("name"), 8).alias("clip"), "frame", F.col("gt_id").alias("det_id"), F.when(_mod(F.col("frame"), 3) != 0, F.col("name")).alias("detector_id"))
    return tracker.with_detector_ids(det).groupBy("clip", "frame").agg(F.min("usable").alias("usable"))


def teams_of_files(spark, d):
    t = S.table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("/clips/"), F.when(F.col("n_nationkey") % 4 != 0, F.concat(F.substring("n_name", 1, 3), F.lit("_"), F.col("n_regionkey").cast("string"), F.lit("x_9.mp4"))).otherwise("single.mp4")).alias("path"))
    teams = generate.teams_of_file(F.col("path"), {"FRA": "France", "JAP": "Japan"})
    return t.select("n_nationkey", teams[0].alias("home"), teams[1].alias("away"))


def summary_provenance(spark, d):
    s = S.summary(spark, d).select("track_id", "jersey")
    change = s.where("jersey is not null").select("track_id", F.when(_mod(F.col("track_id"), 2) == 0, "label_inherited_from").otherwise("identity_stitched_from").alias("field"), F.col("jersey").alias("source"))
    got = files.provenance(s, change)
    return got.select("track_id", F.map_keys("provenance")[0].alias("field"), F.map_values("provenance")[0].alias("source"))


def greedy_assignment(spark, d):
    """Tracks and labels of every window and team matched by ascending cost, as the fallback of the optimal matching does."""
    return matching.assign(_window_claims(spark, d).withColumn("prob", F.round("prob", 9)), ["window", "team"], optimal=False).withColumns(_r("prob"))


def memory_vectors(spark, d):
    a = S.appearance(spark, d)
    return identity.memory_vectors(a.select(F.col("identity").alias("player"), F.col("vec_id").alias("seq"), "embedding")).select("player", F.posexplode("embedding").alias("place", "value")).withColumns(_r("value"))


def scalar_functions(spark, d):
    """Clamp, display name, normalised numbers, containment, palette and parsed colours over the parts."""
    p = S.table(spark, d, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("s"))
    k = F.col("p_partkey")
    number = F.when(_mod(k, 4) == 0, F.concat(F.lit(" "), _mod(k, 90).cast("string"), F.lit(".0 "))).when(_mod(k, 4) == 1, F.lit("")).otherwise(F.col("s"))
    rgb = C.parse_hex(F.concat(F.lit("#"), F.lpad(F.hex(_mod(k * 7919, 1 << 24)), 6, "0")))
    return p.select(
        "p_partkey", F.round(G.clamp(k / 100.0, 0.5, 1.5), 6).alias("clamped"), T.normalize_number(number).alias("number"),
        T.display_name(F.concat(F.lit("P"), "s"), T.normalize_number(number)).alias("display"), T.contains_either(F.col("s"), F.substring("s", 1, 1)).alias("a_in_b"),
        T.contains_either(F.lit("1"), F.col("s")).alias("one_in"), C.palette_color(F.col("s"), list("abcdef")).alias("color"), rgb[0].alias("r"), rgb[1].alias("g"), rgb[2].alias("b"),
    )


def roster_filtered(spark, d):
    """Distributions cut to known labels in both ways: empty if none is left, or as they were."""
    m = S.observations(spark, d).groupBy("track_id", "candidate").agg(F.sum("prob").alias("p")).groupBy("track_id").agg(F.map_from_entries(F.collect_list(F.struct("candidate", "p"))).alias("m"))
    known = F.when(_mod(F.col("track_id"), 5) == 0, F.array(F.lit("none"))).otherwise(F.array(F.lit("click"), F.lit("view")))
    cut = lambda empty: P.keep_known(P.normalize_map(F.col("m")), known, empty_if_none=empty)
    strict = m.select("track_id", F.lit("strict").alias("mode"), F.explode(cut(True)).alias("candidate", "prob"))
    loose = m.select("track_id", F.lit("loose").alias("mode"), F.explode(cut(False)).alias("candidate", "prob"))
    return strict.union(loose).withColumns(_r("prob", digits=9))


def vector_cosines(spark, d):
    """Cosine of neighbouring embeddings, one of them zero or cut at times, and the length after normalising."""
    a = S.appearance(spark, d)
    e = F.when(_mod(F.col("vec_id"), 7) == 0, F.transform("embedding", lambda x: x * 0)).when(_mod(F.col("vec_id"), 11) == 0, F.slice("embedding", 1, 8)).otherwise(F.col("embedding"))
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    rows = a.withColumn("e", e).join(b, "vec_id")
    return rows.select("vec_id", F.round(V.cosine(F.col("e"), F.col("other")), 6).alias("cosine"), F.round(V.norm(V.l2_normalize(F.col("e"))), 6).alias("length"))


NAMES = (
    "fusion_posterior resolved_players map_argmax body_confidence gallery_similarity memory_similarity evidence_refresh player_of_jersey first_and_last_match primary_identity claim_strength "
    "conflicts_until_stable snapshot_retention summary_mirror relabelled_run identity_documents visible_numbers roster_numbers eligible_tracks cleared_roles rendered_tracks classes_and_categories "
    "gated_evidence plausible_boxes crop_scores digit_places identity_edges switch_segments team_hues mean_colors special_roles registry_build forced_players registry_reassign reassigned_tracks "
    "split_parents location_scores location_assignment interval_matches interval_f1 reader_summary reader_confusions reader_tallies ensemble_summary silhouette_matches source_detections "
    "adjacent_accuracy display_report display_scores best_run running_mean top_anchors detection_order detector_passthrough teams_of_files summary_provenance "
    "greedy_assignment memory_vectors scalar_functions roster_filtered vector_cosines"
).split()
QUERIES = {n: globals()[n] for n in NAMES}

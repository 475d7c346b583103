"""Two clips whose ids, frames and times coincide: rows equal the union of two single runs. And the greedy matching by rounds."""

import random

import pytest
from pyspark.sql import functions as F
from tracklake.operators import evaluate, linking, matching, registry, spatial


def rows(df):
    return sorted((tuple(str(x) for x in r) for r in df.select(*sorted(df.columns)).collect()))


def check(make, *tables):
    """make(tables, clip): over both clips, and over each by itself."""
    both = rows(make([t for t in tables], "clip"))
    single = []
    for c in (1, 2):
        own = [t.where(F.col("clip") == c).drop("clip") for t in tables]
        single += rows(make(own, None).withColumn("clip", F.lit(c).cast("long")))
    assert both == sorted(single) and both
    return both


def boxes(spark, seed, ids, name):
    out = []
    for clip in (1, 2):
        rng = random.Random(10 * seed + clip)
        for k in range(60):
            x, y = rng.uniform(0, 400), rng.uniform(0, 300)
            out.append((clip, k % 6, k, rng.randrange(5), rng.random() < 0.5, x, y, x + 60, y + 80))
    return spark.createDataFrame(out, f"clip long, frame long, {ids} long, {name} long, visible boolean, x1 double, y1 double, x2 double, y2 double")


def spans(spark):
    out = []
    for clip in (1, 2):
        rng = random.Random(clip)
        for k in range(40):
            a = rng.uniform(0, 60)
            e = [rng.gauss(0, 1) for _ in range(3)]
            n = sum(x * x for x in e) ** 0.5
            out.append((clip, k, k, f"t{k % 2}", str(k % 4), a, a + rng.uniform(0, 8), *[rng.uniform(0, 200) for _ in range(4)], [x / n for x in e]))
    return spark.createDataFrame(out, "clip long, track_id long, seq long, team string, jersey string, start_s double, end_s double, x0 double, y0 double, x1 double, y1 double, embedding array<double>")


def test_boxes_stay_in_their_clip(spark):
    gt, pred = boxes(spark, 1, "gt_id", "name").cache(), boxes(spark, 2, "pred_id", "track_id").drop("visible").cache()
    check(lambda t, c: spatial.best_iou_match(*t, 0.2, clip=c), gt, pred)
    check(lambda t, c: spatial.judged(*t, 0.2, clip=c), gt, pred)
    check(lambda t, c: spatial.id_switches(spatial.judged(*t, 0.2, clip=c), clip=c), gt, pred)
    check(lambda t, c: spatial.evaluation_summary(*t, clip=c), gt, pred)
    check(lambda t, c: spatial.greedy_one_to_one(*t, 0.05, clip=c), gt, pred)


def test_spans_stay_in_their_clip(spark):
    s = spans(spark).cache()
    visible = s.select("clip", "team", "jersey").distinct().where("jersey <> '3' or clip = 1")
    check(lambda t, c: linking.gap_candidates(t[0], 6.0, 150.0, clip=c), s)
    check(lambda t, c: linking.nearest_successor(linking.gap_candidates(t[0], 6.0, 150.0, clip=c), clip=c), s)
    check(lambda t, c: linking.active_windows(t[0], 4.0, 2.0, clip=c), s)
    check(lambda t, c: linking.identity_edges(*t, least=0.1, clip=c), s, visible)
    frames = s.select("clip", F.floor("start_s").alias("frame"), F.col("team").alias("identity"), F.col("x0").alias("strength"))
    check(lambda t, c: linking.strongest_per_frame(t[0], clip=c), frames)
    a = s.where("track_id % 2 = 0").select("clip", F.col("track_id").alias("id"), F.col("team").alias("label"), "start_s", "end_s")
    b = s.where("track_id % 2 = 1").select("clip", F.col("track_id").alias("id"), F.lit("t0").alias("label"), "start_s", "end_s")
    check(lambda t, c: evaluate.interval_matches(*t, least=0.1, clip=c), a, b)


def test_registries_stay_in_their_clip(spark):
    s = spans(spark).cache()
    obs = s.select("clip", F.col("track_id").alias("obs_id"), (F.col("track_id") % 5).alias("frame"), F.when(F.col("track_id") % 3 != 0, F.col("team")).alias("team"), F.col("x0").alias("x"), F.col("y0").alias("y"), "embedding", "track_id")
    known = s.where("track_id < 12").select("clip", F.col("track_id").alias("player"), "team", "embedding")
    forced = obs.where("obs_id % 7 = 0").select("clip", "obs_id", (F.col("obs_id") % 12).alias("player"))
    check(lambda t, c: registry.reassign(*t, least=0.1, margin=0.0, clip=c), obs, forced, known)
    expected = s.where("track_id < 12").select("clip", (F.col("track_id") % 5).alias("frame"), F.col("track_id").alias("player"), "team", F.col("x1").alias("x"), F.col("y1").alias("y"), "embedding")
    score = lambda t, c: registry.location_scores(*t, reach=120.0, least_similarity=-0.5, least=0.2, clip=c)
    check(score, obs, expected)
    locked = s.where("track_id % 9 = 0").select("clip", "track_id", F.col("track_id").alias("player"))
    check(lambda t, c: registry.assign_locations(t[0], t[2], score(t[:2], c), clip=c), obs, expected, locked)


@pytest.mark.parametrize("seed", range(4))
def test_rounds_take_the_edges_of_the_pass(spark, seed):
    rng = random.Random(seed)
    edges = list({(rng.randrange(3), rng.randrange(25), rng.randrange(25), round(rng.random(), 1)) for _ in range(400)})
    edges = list({e[:3]: e for e in edges}.values())
    df = spark.createDataFrame(edges, "g long, a long, b long, w double")
    order = [-F.col("w"), F.col("a"), F.col("b")]
    want, used = [], set()
    for e in sorted(edges, key=lambda e: (-e[3], e[1], e[2])):
        if not {(e[0], "a", e[1]), (e[0], "b", e[2])} & used:
            used |= {(e[0], "a", e[1]), (e[0], "b", e[2])}
            want.append(e)
    for most in (10**9, 0, 130):
        assert sorted(map(tuple, matching.greedy_matching(df, ["g"], "a", "b", order, most=most).collect())) == sorted(want)


def test_one_group_of_a_million_edges(spark):
    n = 1_000_000
    df = spark.range(n).select(F.lit(1).alias("g"), F.pmod(F.xxhash64("id"), F.lit(400_000)).alias("a"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(400_000)).alias("b"), F.rand(3).alias("w"), "id")
    got = matching.greedy_matching(df, ["g"], "a", "b", [-F.col("w"), F.col("id")]).cache()
    assert got.select("a").distinct().count() == got.select("b").distinct().count() == got.count() > 200_000

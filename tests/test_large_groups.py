"""Operators whose pairs grow with the square of a group: the same rows as over all pairs, with none of them exchanged."""

import math
import random

from pyspark.sql import functions as F

from tracklake.operators import evaluate, linking, registry, retrieval, spatial


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_inherited_labels_equal_all_pairs_without_a_join_of_them(spark):
    rng = random.Random(3)
    span = lambda: (lambda s: (s, s + rng.choice([0.0, 5.0, 80.0])))(float(rng.randrange(100)))
    losers = [(t, t % 2, *span(), 1.0) for t in range(300)]
    winners = [(1000 + t, t % 2, "ab"[t % 4 // 2], *span(), float(rng.randrange(6))) for t in range(500)]
    marks = [(t, c, rng.random()) for t in range(300) for c in "ab"]
    want = {}
    for t, team, s, e, best in losers:
        own = {c for u, c, p in marks if u == t and p >= 0.3 * best}
        fits = [(-x, w, label) for w, tm, label, a, b, x in winners if tm == team and label in own and min(e, b) - max(s, a) <= 0.5]
        if fits:
            want[t] = min(fits)[1:]
    got = linking.inherit_labels(
        spark.createDataFrame(losers, "track_id long, team long, start_s double, end_s double, best_score double"),
        spark.createDataFrame(winners, "track_id long, team long, label string, start_s double, end_s double, score double"),
        spark.createDataFrame(marks, "track_id long, candidate string, score double"), max_overlap=0.5, min_ratio=0.3,
    )
    assert {r["loser"]: (r["winner"], r["label"]) for r in got.collect()} == want
    assert plan(got).count("Join") == 1  # losers with their candidates; winners meet them in groups


def _tracks(spark, n=400):
    rng = random.Random(9)
    rows = []
    for t in range(n):
        s = float(rng.randrange(300))
        rows.append((t, t % 3, s, s + rng.randrange(6), *(float(10 * rng.randrange(30)) for _ in range(4)), float(rng.randrange(20))))
    return spark.createDataFrame(rows, "track_id long, team long, start_s double, end_s double, x0 double, y0 double, x1 double, y1 double, score double")


def test_stitching_of_tracks_equals_that_of_all_pairs(spark):
    t = _tracks(spark)
    want = linking.gap_stitch(linking.gap_candidates(t, 5.0, 90.0), t.select("track_id", "score"))
    got = linking.stitch_tracks(t, 5.0, 90.0)
    assert want.count() > 100 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "Join" not in plan(got)


def test_nearest_of_blocks_equals_that_of_all_pairs(spark):
    t = _tracks(spark)
    want = linking.nearest_successor(linking.gap_candidates(t, 5.0, 90.0))
    got = linking.gap_nearest(t, 5.0, 90.0)
    assert want.count() > 100 and sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert "Join" not in plan(got)


def test_forest_has_the_components_of_all_pairs_in_few_edges(spark):
    t = _tracks(spark)
    pairs = linking.gap_candidates(t, 5.0, 90.0).select("a", "b")
    forest = linking.gap_forest(t, 5.0, 90.0).cache()
    assert forest.count() < pairs.count() and forest.exceptAll(pairs).count() == 0
    assert sorted(map(tuple, linking.components(forest).collect())) == sorted(map(tuple, linking.components(pairs).collect()))


def _iou(a, b):
    w, h = (max(0.0, min(a[k + 2], b[k + 2]) - max(a[k], b[k])) for k in (0, 1))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / union


def test_boxes_of_a_crowded_frame_pair_as_all_pairs_do(spark):
    """Whole-number boxes give equal overlaps, and a heap of equal boxes more partners than a list keeps."""
    rng = random.Random(4)
    box = lambda: (lambda x, y: (x, y, x + rng.choice([20.0, 30.0]), y + 40.0))(float(rng.choice([0, 4, 8, 300, 640])), float(rng.choice([0, 3, 200])))
    gt = [(i, i % 2, *box()) for i in range(240)]
    pred = [(i, i % 2, i * 7, *box()) for i in range(240)]
    free, greedy, best = {p[0] for p in pred}, [], []
    for i, f, *b in gt:
        fits = sorted((-_iou(b, p[3:]), p[0]) for p in pred if p[1] == f and _iou(b, p[3:]) >= 0.3)
        best.append((i, fits[0][1] if fits else None, fits[0][1] * 7 if fits else None))
        took = next((p for _, p in fits if p in free), None)
        if took is not None:
            free.discard(took)
            greedy.append((i, took))
    g = spark.createDataFrame(gt, "gt_id long, frame long, x1 double, y1 double, x2 double, y2 double")
    p = spark.createDataFrame(pred, "pred_id long, frame long, track_id long, x1 double, y1 double, x2 double, y2 double")
    got = spatial.greedy_one_to_one(g, p, 0.3)
    assert sorted(map(tuple, got.select("gt_id", "pred_id").collect())) == greedy
    assert "Join" not in plan(got)
    assert sorted(map(tuple, spatial.best_iou_match(g, p, 0.3).select("gt_id", "pred_id", "track_id").collect())) == best


def test_intervals_of_one_label_pair_without_a_join(spark):
    rng = random.Random(6)
    row = lambda i: (lambda s: (i, "a", s, s + rng.choice([5.0, 9.0, 40.0])))(float(rng.randrange(120)))
    p, t = [row(i) for i in range(150)], [row(i) for i in range(150)]
    iou = lambda a, b: max(0.0, min(a[3], b[3]) - max(a[2], b[2])) / (max(a[3], b[3]) - min(a[2], b[2]))
    free, want = list(t), []
    for a in p:
        fits = sorted((-iou(a, b), b[0]) for b in free if iou(a, b) >= 0.3)
        if fits:
            want.append((a[0], fits[0][1]))
            free = [b for b in free if b[0] != fits[0][1]]
    kind = "id long, label string, start_s double, end_s double"
    got = evaluate.interval_matches(spark.createDataFrame(p, kind), spark.createDataFrame(t, kind))
    assert sorted(map(tuple, got.select("pred_id", "true_id").collect())) == want
    assert "Join" not in plan(got)


def located(spark, n=120):
    rng = random.Random(11)
    vector = lambda: [float(rng.randrange(-2, 3)) for _ in range(4)]
    obs = [(i, i % 40, i % 3, [None, 0, 1][i % 3], float(rng.randrange(60)), float(rng.randrange(60)), vector() if i % 7 else None) for i in range(n)]
    places = [(i % 3, i, [None, 0, 1][i % 3 - 1], float(rng.randrange(60)), float(rng.randrange(60)), vector()) for i in range(n // 2)]
    locked = [(t, t) for t in range(0, 40, 11)]
    return (
        spark.createDataFrame(obs, "obs_id long, track_id long, frame long, team long, x double, y double, embedding array<double>"),
        spark.createDataFrame(places, "frame long, player long, team long, x double, y double, embedding array<double>"),
        spark.createDataFrame(locked, "track_id long, player long"), obs, places,
    )


def test_location_scores_equal_all_pairs_without_a_join_of_them(spark):
    o, e, _, obs, places = located(spark)
    want = {}
    for i, _, frame, team, x, y, v in obs:
        for at, p, other, px, py, w in places:
            gone = math.hypot(x - px, y - py)
            if frame != at or v is None or gone > 25 or (team is not None and other is not None and team != other):
                continue
            size = math.hypot(*v) * math.hypot(*w)
            sim = sum(a * b for a, b in zip(v, w)) / size if size > 1e-8 else 0.0
            score = 0.5 * (1 - gone / 25) + 0.5 * (sim + 1) / 2
            if sim >= -0.3 and score >= 0.35:
                want[i, p] = round(score, 9)
    got = registry.location_scores(o, e, reach=25.0, least_similarity=-0.3, least=0.35)
    assert {(r["obs_id"], r["player"]): round(r["score"], 9) for r in got.collect()} == want and len(want) > 30
    assert plan(got).count("Join") == 0


def test_locations_assigned_in_bands_equal_the_pass_over_all_scores(spark):
    o, e, locked, *_ = located(spark, 300)
    given = {"reach": 40.0, "least_similarity": -0.9, "least": 0.1}
    scored = registry.location_scores(o, e, **given).withColumn("score", F.round("score", 9))
    want = sorted(map(tuple, registry.assign_locations(o, locked, scored).collect()))
    for most in (10**9, 500):
        assert sorted(map(tuple, registry.locate_observations(o, e, locked, **given, most=most).collect())) == want
    assert sum(not x[2] for x in want) > 50


def test_average_precision_makes_no_pairs(spark):
    rows = [(i, i // 2, None if i % 9 == 0 else i % 3, [float(i % 4), 1.0, float(i % 5)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, frame long, identity long, embedding array<double>")
    one, many = (retrieval.retrieval_metrics(df.where("vec_id % 4 = 0"), df, chunk=n) for n in (1000, 4))
    assert one.first() == many.first() and one.first()["queries"] == sum(i % 9 != 0 for i in range(0, 60, 4))
    assert "Window [row_number" not in plan(many) and "collect_list" not in plan(many)


def test_identity_edges_equal_all_pairs_without_a_join_of_them(spark):
    rng = random.Random(5)
    span = lambda: (lambda s: (s, s + rng.choice([0.0, 2.0, 9.0])))(float(rng.randrange(60)))
    rows = [(i, 199 - i, rng.choice([None, "A", "B"]), rng.choice([None, "1", "2", "3"]), *span(), *[float(rng.randrange(9)) for _ in range(4)], [float(rng.randrange(-1, 2)) for _ in range(3)]) for i in range(200)]
    visible = [("A", "1"), ("A", "2")]
    want = set()
    for a in rows:
        for b in rows:
            gap, team = b[4] - a[5], a[2] if a[2] is not None else b[2]
            if a[0] == b[0] or not -1 <= gap <= 4 or (a[2] and b[2] and a[2] != b[2]) or (gap > 0 and math.hypot(a[8] - b[6], a[9] - b[7]) > 6):
                continue
            differ = a[3] and b[3] and a[3] != b[3]
            if differ and (team != "A" or ((team, a[3]) in visible and (team, b[3]) in visible)):
                continue
            if sum(x * y for x, y in zip(a[10], b[10])) >= 1:
                want.add((a[0], b[0]) if a[1] < b[1] else (b[0], a[0]))
    schema = "track_id long, seq int, team string, jersey string, start_s double, end_s double, x0 double, y0 double, x1 double, y1 double, embedding array<double>"
    got = linking.identity_edges(spark.createDataFrame(rows, schema), spark.createDataFrame(visible, "team string, jersey string"), least=1.0, max_gap=4.0, max_overlap=1.0, max_distance=6.0)
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 100
    assert plan(got).count("Join") == 4  # both sides with the visible jerseys and teams


def test_reassignment_equals_the_plain_order_without_rows_of_pairs(spark):
    rng = random.Random(12)
    kinds = [[rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)] for _ in range(12)]
    obs = [(i, i % 7, rng.choice(["a", "b", None, "z"]), rng.choice([None, *kinds])) for i in range(600)]
    known = [(f"p{i}", "ab"[i % 2], kinds[i % len(kinds)]) for i in range(30)]
    forced = [(i, f"p{rng.randrange(30)}") for i in range(0, 600, 17)]
    sure, taken = dict(forced), {(obs[i][1], p) for i, p in forced}
    norm = lambda v: math.sqrt(sum(x * x for x in v))
    like = lambda a, b: sum(x * y for x, y in zip(a, b)) / (norm(a) * norm(b)) if norm(a) * norm(b) > 1e-8 else 0.0
    want = {i: (p, True) for i, p in forced}
    for i, frame, team, e in obs:
        if e is not None and i not in sure:
            sims = sorted((-like(e, v), p) for p, t, v in known if (team is None or t == team) and (frame, p) not in taken)
            if sims and -sims[0][0] >= 0.1 and -sims[0][0] + (sims[1][0] if len(sims) > 1 else 2.0) >= 0.02:
                taken.add((frame, sims[0][1]))
                want[i] = (sims[0][1], False)
    got = registry.reassign(
        spark.createDataFrame(obs, "obs_id long, frame long, team string, embedding array<double>"), spark.createDataFrame(forced, "obs_id long, player string"),
        spark.createDataFrame(known, "player string, team string, embedding array<double>"), least=0.1, margin=0.02,
    )
    assert {r["obs_id"]: (r["player"], r["forced"]) for r in got.collect()} == want
    assert sum(not f for _, f in want.values()) > 10
    assert "FlatMapCoGroupsInPandas" in plan(got)


def test_shared_frames_equal_all_pairs_without_a_row_for_each_frame(spark, monkeypatch):
    monkeypatch.setattr(linking, "SIDE", 7)
    rng = random.Random(21)
    rows = [(rng.randrange(2), rng.randrange(40), rng.randrange(30)) for _ in range(900)] + [(None, 1, 1), (0, None, 1), (0, 1, None), (1, 99, 500)]
    frames = {}
    for k, t, f in rows:
        if None not in (k, t, f):
            frames.setdefault((k, t), set()).add(f)
    want = {(k, a, b): (len(x & y), len(x & y) / len(x), len(x & y) / len(y)) for (k, a), x in frames.items() for (m, b), y in frames.items() if k == m and a < b and x & y}
    got = linking.shared_frames(spark.createDataFrame(rows, "k long, track_id long, frame_index long"), ["k"])
    assert got.columns == ["k", "a", "b", "shared", "ratio_a", "ratio_b"]
    back = [((r["k"], r["a"], r["b"]), (r["shared"], r["ratio_a"], r["ratio_b"])) for r in got.collect()]
    assert len(back) == len(want) and dict(back) == want
    assert plan(got).count("Join") == 1  # tracks with their key's number of blocks

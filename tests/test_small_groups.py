"""Many small groups: a frame or an identity is no Python call of its own, and the results are those of the groups taken singly."""

import numpy as np

from tracklake.operators import linking, matching, spatial
from tracklake.streaming import tracker


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _iou(a, b):
    w, h = (max(0.0, min(a[k + 2], b[k + 2]) - max(a[k], b[k])) for k in (0, 1))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / union if union > 0 else 0.0


def test_boxes_of_many_small_frames_meet_in_one_pass(spark):
    rng = np.random.default_rng(5)
    sides = {}
    for n in ("gt", "pred"):
        at = rng.integers(0, 30, (1500, 2)).astype(float)
        at[:400] = rng.integers(0, 300, (400, 2))  # one frame is large
        frame = np.where(np.arange(1500) < 400, -1, rng.integers(0, 700, 1500))
        sides[n] = [(f"c{i % 2 if f >= 0 else 0}", int(f), int(i), float(x), float(y), float(x + 20), float(y + 12)) for i, (f, (x, y)) in enumerate(zip(frame, at))]
    gt = spark.createDataFrame(sides["gt"], "clip string, frame long, gt_id long, x1 double, y1 double, x2 double, y2 double")
    pred = spark.createDataFrame(sides["pred"], "clip string, frame long, pred_id long, x1 double, y1 double, x2 double, y2 double").selectExpr("*", "pred_id * 2 AS track_id")
    near = {}
    for p in sides["pred"]:
        near.setdefault(p[:2], []).append(p)
    best, taken, greedy = {}, set(), []
    for g in sides["gt"]:
        met = sorted((-v, p[2]) for p in near.get(g[:2], []) if (v := _iou(g[3:], p[3:])) >= 0.2)
        best[g[2]] = met[0][1] if met else None
        free = [p for _, p in met if p not in taken]
        if free:
            taken.add(free[0])
            greedy.append((g[2], free[0]))
    got = spatial.best_iou_match(gt, pred, 0.2, clip="clip")
    assert {r["gt_id"]: r["pred_id"] for r in got.collect()} == best and "CoGroup" not in _plan(got)
    one = spatial.greedy_one_to_one(gt, pred.withColumn("pred_id", pred["pred_id"].cast("string")), 0.2, clip="clip")
    assert one.schema["pred_id"].dataType.simpleString() == "string" and "CoGroup" not in _plan(one)
    assert sorted(map(tuple, spatial.greedy_one_to_one(gt, pred, 0.2, clip="clip").select("gt_id", "pred_id").collect())) == greedy
    assert len(greedy) > 200 and one.count() == len(greedy)


def test_claims_of_many_identities_are_judged_in_one_pass(spark):
    rng = np.random.default_rng(6)
    rows = [(int(i), t, float(rng.integers(0, 4)), rng.integers(0, 12, int(rng.integers(0, 6))).tolist()) for t, i in enumerate(rng.integers(0, 200, 1200))]
    want = {}
    for i in range(200):
        kept: set = set()
        for _, t, _, frames in sorted((r for r in rows if r[0] == i), key=lambda r: (-r[2], r[1])):
            own = set(frames)
            want[t] = bool(kept and own and len(own & kept) / len(own) > 0.6)
            kept |= set() if want[t] else own
    got = linking.demote_conflicts(spark.createDataFrame(rows, "identity long, track_id long, score double, frames array<long>"))
    assert {r["track_id"]: r["demoted"] for r in got.collect()} == want and 0 < sum(want.values()) < 1200
    assert "FlatMapGroupsInPandas" not in _plan(got)


def test_small_assignments_are_dealt_to_all_tasks(spark):
    rows = spark.createDataFrame([(w, t, f"p{(t + k) % 5}", 0.9 - 0.2 * k) for w in range(64) for t in range(5) for k in range(3)], "w long, track_id long, label string, prob double")
    got = matching.assign(rows, ["w"])
    assert sorted({(r["track_id"], r["label"]) for r in got.collect()}) == [(t, f"p{t}") for t in range(5)] and got.count() == 320
    assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_frames_with_the_detectors_own_ids_are_taken_together(spark, monkeypatch):
    import pandas as pd

    rows = [(f, 10 * f + k, 40.0 * k, 0.0, 40.0 * k + 30, 30.0, 0.5 + k / 10, None if f in (4, 5, 9) or (f, k) == (7, 1) else 3 - k) for f in range(12) for k in range(3)]
    part = pd.DataFrame(rows, columns=["frame", "det_id", "x1", "y1", "x2", "y2", "confidence", "detector_id"]).sort_values(tracker._ORDER)
    want, state = [], tracker.TrackerState()
    for f in range(12):
        own = part[part["frame"] == f]
        if own["detector_id"].isna().any():
            want += [(f, d[0], d[1]) for d in tracker.step(state, f, list(own[["det_id", *tracker._BOX]].itertuples(index=False, name=None)))]
        else:
            want += sorted(((f, int(d), int(i)) for d, i in zip(own["det_id"], own["detector_id"])), key=lambda r: r[2])
    calls = []
    real = np.argsort
    monkeypatch.setattr(tracker.np, "argsort", lambda *a, **k: calls.append(1) or real(*a, **k))
    got, late = tracker.Rows(part).follow(state := tracker.TrackerState(), 1, {})
    assert list(zip(got["frame"], got["det_id"], got["track_id"])) == want and late == 0 and state.last_frame == 11
    assert len(calls) == 4  # those of frames 4, 5, 7 and 9


def test_locations_with_shared_vectors_exchange_only_their_numbers(spark, monkeypatch):
    from tracklake.operators import registry

    rng = np.random.default_rng(7)
    place = lambda n: [(int(f), i, int(t) if t < 3 else None, float(x), float(y), int(v)) for i, (f, t, x, y, v) in enumerate(rng.integers(0, [9, 4, 120, 90, 14], (n, 5)))]
    o = spark.createDataFrame(place(700), "frame long, obs_id long, team long, x double, y double, vec_id long")
    e = spark.createDataFrame([(f, f"p{i % 90}", *rest) for f, i, *rest in place(500)], "frame long, player string, team long, x double, y double, vec_id long")
    vectors = spark.createDataFrame([(v, rng.integers(-2, 3, 4).astype(float).tolist() if v < 12 else None) for v in range(13)], "vec_id long, embedding array<double>")
    o = o.withColumn("track_id", o["obs_id"] % 50)
    locked = spark.createDataFrame([(3, "p3")], "track_id long, player string")
    inline = [df.join(vectors, "vec_id").drop("vec_id") for df in (o, e)]
    given = {"reach": 30.0, "least_similarity": -0.5, "least": 0.3}
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(registry.location_scores(*inline, **given)), rows(registry.locate_observations(*inline, locked, **given))
    assert len(want[0]) > 500 and {len(x) for x in want[0]} == {4}
    for limit in (100, 3):  # the vectors go to the tasks, or to the rows
        monkeypatch.setattr(registry, "VECTORS", limit)
        got = registry.location_scores(o, e, vectors=vectors, **given)
        assert rows(got) == want[0] and ("embedding" in _plan(got)) == (limit == 3) and "CoGroup" not in _plan(got)
        for most in (40, 10**7):
            assert rows(registry.locate_observations(o.join(vectors.select("vec_id"), "vec_id"), e, locked, vectors=vectors, most=most, **given)) == want[1]


def test_pairs_leave_a_frame_a_few_at_a_time(spark, monkeypatch):
    import pandas as pd

    from tracklake.operators import registry

    monkeypatch.setattr(registry, "PAIRS", 50)
    rng = np.random.default_rng(8)
    o, e = (pd.DataFrame({"id": range(n), "team": [None] * n, "x": rng.integers(0, 40, n), "y": rng.integers(0, 40, n), "code": 0}) for n in (60, 300))
    f = registry._Frame(o, e, np.ones((1, 1)), 20.0, -1.0, 0.0)
    got = list(f.scores(np.arange(60), np.arange(300), 20.0))
    near = {(i, j) for i in range(60) for j in range(300) if np.hypot(o["x"][i] - e["x"][j], o["y"][i] - e["y"][j]) <= 20.0}
    assert max(len(i) for i, _, _ in got) <= 50
    assert sorted((int(a), int(b)) for i, j, _ in got for a, b in zip(i, j)) == sorted(near)


def test_a_block_holds_a_bounded_number_of_positives(spark):
    import pandas as pd

    from tracklake.operators import retrieval

    rng = np.random.default_rng(9)
    rows = [(i, i // 3, None if i % 11 == 0 else i % 2, (rng.integers(-3, 4, 4) / (3 if i % 5 == 0 else 1)).tolist()) for i in range(240)]
    df = spark.createDataFrame(rows, "vec_id long, frame long, identity long, embedding array<double>")
    m = np.array([r[3] for r in rows])
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    want = {}
    for i, f, label, _ in rows[::4]:
        if label is not None:
            order = sorted((-round(float(m[i] @ m[j]), 9), j) for j, (_, g, _, _) in enumerate(rows) if g != f)
            want |= {(i, j): k + 1 for k, (_, j) in enumerate(order) if rows[j][2] == label}
    asked = df.where("vec_id % 4 = 0")
    for most in (10**6, 1500):
        got = retrieval.positive_ranks(asked, df, most=most)
        assert {(r["q_id"], r["vec_id"]): r["rank"] for r in got.collect()} == want
    assert got.rdd.getNumPartitions() >= len(want) // 1500 and retrieval.retrieval_metrics(asked, df).first() == retrieval.retrieval_metrics(asked, df, most=1500).first()
    table = pd.DataFrame({"vec_id": range(900), "frame": range(900), "identity": 1, "e32": [np.float32([k, 1]) for k in range(900)], "e64": None})
    block = retrieval._Ranks(table.iloc[:50])
    block.meet(table)
    block.count(table)
    assert sum(k.nbytes + s.nbytes for k, s in zip(block.keys, block.steps)) <= 12 * 50 * 900 and not any(block.found)


def test_large_frames_are_tracked_without_a_matrix_of_all_pairs(monkeypatch):
    rng = np.random.default_rng(10)
    frames = []
    for n in (60, 90, 40, 70, 90, 20, 80):  # more tracks than boxes, and fewer
        at = rng.random((n, 2)) * 500
        frames.append(np.hstack((at, at + [24, 48], rng.random((n, 1)))))
    follow = lambda: (lambda s: [[x.tolist() for x in tracker.advance(s, f, b)] for f, b in enumerate(frames)])(tracker.TrackerState())
    want, made, real = follow(), [], tracker.costs
    monkeypatch.setattr(tracker, "DENSE", 0)
    monkeypatch.setattr(tracker, "costs", lambda a, b, *how: made.append(min(len(a), len(b))) or real(a, b, *how))
    assert follow() == want and max(made) == 1
    for _ in range(20):
        cost = np.where(rng.random((9, 12)) < 0.4, rng.random((9, 12)), 10.0)
        for c in (cost, cost.T):
            got = matching.sparse_pairs(*c.shape, lambda r, c=c: (np.flatnonzero(c[r] < 10), c[r][c[r] < 10]), 10.0)
            assert got == matching.gated_pairs(c, 10.0)


def test_bands_meet_by_vector_or_by_place_and_pick_the_same(spark, monkeypatch):
    from tracklake.operators import registry

    rng = np.random.default_rng(11)
    place = lambda n, code: [(0, i, float(x), float(y), int(c)) for i, (x, y, c) in enumerate(zip(*rng.integers(0, 60, (2, n)), rng.integers(0, code, n)))]
    o = spark.createDataFrame(place(500, 70), "frame long, obs_id long, x double, y double, vec_id long").selectExpr("*", "obs_id AS track_id", "CAST(NULL AS long) AS team")
    e = spark.createDataFrame(place(450, 70), "frame long, player long, x double, y double, vec_id long").selectExpr("*", "CAST(NULL AS long) AS team")
    vectors = spark.createDataFrame([(v, rng.normal(size=8).tolist()) for v in range(70)], "vec_id long, embedding array<double>")
    none, given = spark.createDataFrame([], "track_id long, player long"), {"reach": 40.0, "least_similarity": -0.9, "least": 0.1, "vectors": vectors}
    scored = {(r["obs_id"], r["player"]): round(r["score"], 9) for r in registry.location_scores(o, e, **given).collect()}
    want, used, taken = set(), set(), set()
    for (i, p), _ in sorted(scored.items(), key=lambda x: (-x[1], x[0])):
        if i not in used and p not in taken:
            used.add(i), taken.add(p), want.add((i, p))
    got = registry.locate_observations(o, e, none, most=2000, **given)
    assert {(r["obs_id"], r["player"]) for r in got.collect()} == want and len(want) > 400
    table = np.full((70, 70), -0.5) + 1.5 * np.eye(70)
    side = lambda df, i: df.selectExpr(f"{i} AS id", "team", "x", "y", "vec_id AS code").toPandas()
    f, tested = registry._Frame(side(o, "obs_id"), side(e, "player"), table, 40.0, -0.9, 0.1), []
    real = f._counted
    f._counted = lambda i, j, gone: tested.append(len(i)) or real(i, j, gone)
    near = [list(f.scores(np.arange(500), np.arange(450), f.within(0.8), *more)) for more in ((), (0.8,))]
    best = [{(int(a), int(b)) for i, j, s in got for a, b in zip(i[s >= 0.8], j[s >= 0.8])} for got in near]
    assert best[0] == best[1] and best[0] and sum(tested[len(near[0]) :]) < sum(tested[: len(near[0])]) / 10

"""Order-dependent operators, blocked searches, generated inputs and letters against plain versions."""

import itertools
import json
import random
import unicodedata
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklake.functions import text as T
from tracklake.operators import evaluate, evidence, linking, matching, retrieval
from tracklake.sources import files, generate
from tracklake.streaming import tracker


def test_gated_pairs_have_least_cost():
    rng = np.random.default_rng(3)
    for _ in range(400):
        rows, cols = rng.integers(1, 5, 2).tolist()
        cost = np.where(rng.random((rows, cols)) < 0.5, 100.0, rng.integers(0, 9, (rows, cols)).astype(float))
        got = matching.gated_pairs(cost, 100.0)
        assert len({r for r, _ in got}) == len(got) == len({c for _, c in got}) and all(cost[p] < 100 for p in got)
        n = min(rows, cols)
        best = min(sum(cost[r, c] for r, c in zip(rs, cs)) for rs in itertools.combinations(range(rows), n) for cs in itertools.permutations(range(cols), n))
        assert sum(cost[p] for p in got) + 100.0 * (n - len(got)) == best


def test_assignment_in_groups_has_least_cost(spark):
    rng = random.Random(2)
    rows = [(g, t, f"l{k}", round(rng.random(), 3)) for g in range(6) for t in range(rng.randrange(1, 4)) for k in range(rng.randrange(1, 4))]
    df = spark.createDataFrame(rows, "g long, track_id long, label string, prob double")
    got = defaultdict(float)
    for r in matching.assign(df, ["g"], least=0.0).collect():
        got[r["g"]] += r["prob"]
    for g in range(6):
        p = {(t, k): v for x, t, k, v in rows if x == g}
        ts, ks = sorted({t for t, _ in p}), sorted({k for _, k in p})
        n = min(len(ts), len(ks))
        best = max(sum(p.get(x, 0.0) for x in zip(a, b)) for a in itertools.combinations(ts, n) for b in itertools.permutations(ks, n))
        assert got[g] == pytest.approx(best)


def test_gap_stitch_equals_one_greedy_pass(spark):
    rng = random.Random(7)
    pairs = sorted({(a, b) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(70)) if a != b})
    rows = [(a, b, float(rng.randrange(1, 50)), float(rng.randrange(9))) for a, b in pairs]
    score = {t: float(rng.randrange(100)) for t in range(40)}
    want, used = [], set()
    by = defaultdict(list)
    for a, b, dist, gap in rows:
        by[a].append((dist, gap, b))
    sources = sorted(by, key=lambda a: (-score[a], a))
    for nr in range(5):
        reached = []
        for a in sources:
            free = [x for x in sorted(by[a]) if x[2] not in used]
            if free:
                used.add(free[0][2])
                reached.append(free[0][2])
                want.append((a, free[0][2], nr))
        sources = sorted((b for b in reached if b in by), key=lambda a: (-score[a], a))
    got = linking.gap_stitch(spark.createDataFrame(rows, "a long, b long, distance double, gap double"), spark.createDataFrame(list(score.items()), "track_id long, score double"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_clusters_refuse_tracks_in_one_frame(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i % 2, int(rng.integers(0, 12)), sorted({int(x) for x in rng.integers(0, 60, 6)}), float(rng.integers(1, 1000)), rng.normal(size=4).tolist()) for i in range(60)]
    frames = {t: f for _, _, t, f, _, _ in rows}
    rows = [(i, g, t, frames[t], s, e) for i, g, t, _, s, e in rows]
    want = {}
    for team in (0, 1):
        clusters = []
        for i, _, t, f, s, e in sorted((r for r in rows if r[1] == team), key=lambda r: (-r[4], r[0])):
            e = np.array(e) / np.linalg.norm(e)
            fits = [(float(e @ c["mean"]), -k) for k, c in enumerate(clusters) if not any(o != t and set(f) & set(frames[o]) for o in c["tracks"])]
            best = max(fits, default=(-2, 0))
            if best[0] >= 0.3:
                c = clusters[-best[1]]
            else:
                clusters.append(c := {"sum": np.zeros(4), "tracks": set(), "nr": len(clusters)})
            c["sum"] = c["sum"] + s * e
            c["mean"] = c["sum"] / np.linalg.norm(c["sum"])
            c["tracks"].add(t)
            want[i] = c["nr"]
    df = spark.createDataFrame(rows, "anchor_id long, team long, track_id long, frames array<long>, score double, embedding array<double>")
    assert {r["anchor_id"]: r["cluster_id"] for r in matching.cluster_anchors(df, 0.3).collect()} == want


def test_window_conflicts_by_strength(spark):
    rng = random.Random(5)
    rows = [(w, 0, t, f"l{k}", round(rng.random(), 3), dur) for w in range(8) for t, dur in ((t, float(rng.randrange(6))) for t in range(4)) for k in range(3)]
    want = {}
    for w in range(8):
        own = defaultdict(list)
        for _, _, t, label, p, dur in (r for r in rows if r[0] == w):
            own[t].append((-p, label, dur))
        used = set()
        for t in sorted(own, key=lambda t: (min(own[t])[0] * min(4, max(1, own[t][0][2] + 1)), t)):
            pick = next((label for nr, (p, label, _) in enumerate(sorted(own[t])) if label not in used and (nr == 0 or -p >= 0.15)), None)
            used |= {pick}
            want[w, t] = pick
    df = spark.createDataFrame(rows, "window long, team long, track_id long, label string, prob double, duration double")
    assert {(r["window"], r["track_id"]): r["label"] for r in matching.resolve_window_conflicts(df).collect()} == want


def test_conflicts_until_stable(spark):
    rng = random.Random(6)
    players = [(f"p{k}", "AB"[k % 2], str(k // 2), k) for k in range(8)]
    tracks = [
        {"track_id": i, "team": rng.choice(["A", "B", None]), "jersey": rng.choice(["0", "1", "2", "3", None]), "resolved": rng.choice([*[p[0] for p in players], None]),
         "confidence": round(rng.random(), 3), "votes": float(rng.randrange(9)), "duration": float(rng.randrange(30)), "is_player": rng.random() < 0.9}
        for i in range(60)
    ]
    frames = {t["track_id"]: sorted(rng.sample(range(40), 8)) for t in tracks}
    schema = "track_id long, team string, jersey string, resolved string, confidence double, votes double, duration double, is_player boolean"
    df = spark.createDataFrame([tuple(t.values()) for t in tracks], schema)
    p = spark.createDataFrame(players, "player string, team string, jersey string, nr long")
    f = spark.createDataFrame(list(frames.items()), "track_id long, frames array<long>")
    got = {r["track_id"]: (r["resolved"], r["confidence"], r["jersey"], r["demoted_from"]) for r in evidence.resolve_until_stable(df, p, f, ratio=0.2).collect()}

    by_id, by_key = {x[0]: x for x in players}, {}
    for x in players:
        by_key.setdefault((x[1], x[2]), x[0])
    rows = [dict(t, demoted_from=None) for t in tracks]
    before = 0
    for _ in range(6):
        claims = defaultdict(list)
        for t in rows:
            who = t["resolved"] if t["resolved"] and t["confidence"] >= 0.25 and by_id[t["resolved"]][2] == t["jersey"] else by_key.get((t["team"], t["jersey"]))
            if t["is_player"] and who:
                claims[who].append(t)
        for who, own in claims.items():
            kept = set()
            for t in sorted(own, key=lambda t: (-(t["confidence"] + 0.05 * t["votes"] + 0.01 * t["duration"]), t["track_id"])):
                mine = set(frames[t["track_id"]])
                if kept and len(mine & kept) / len(mine) > 0.2:
                    if (t["team"], t["jersey"]) == by_id[who][1:3]:
                        t["jersey"] = None
                    t.update(resolved=None, confidence=0.0, demoted_from=who)
                else:
                    kept |= mine
        now = sum(t["demoted_from"] is not None for t in rows)
        if now == before:
            break
        before = now
    assert got == {t["track_id"]: (t["resolved"], t["confidence"], t["jersey"], t["demoted_from"]) for t in rows} and before > 3


def test_ranks_of_positives_in_small_blocks(spark):
    rng = np.random.default_rng(9)
    v = rng.integers(-2, 3, (80, 4)).astype(float)  # with many equal ones
    rows = [(i, i // 4, i % 5, x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, frame long, identity long, embedding array<double>")
    blocks = retrieval.in_blocks
    try:
        retrieval.in_blocks = lambda q, g, w, s: blocks(q, g, w, s, q_block=7, g_block=11)
        got = {(r["q_id"], r["vec_id"]): r["rank"] for r in retrieval.positive_ranks(df.where("vec_id % 4 = 0"), df, chunk=5).collect()}
        metrics = retrieval.retrieval_metrics(df.where("vec_id % 4 = 0"), df).first()
    finally:
        retrieval.in_blocks = blocks
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    want, aps = {}, []
    for q in range(0, 80, 4):
        order = sorted((-round(float(u[q] @ u[j]), 9), j) for j in range(80) if rows[j][1] != rows[q][1])
        own = [(k + 1, j) for k, (_, j) in enumerate(order) if rows[j][2] == rows[q][2]]
        want |= {(q, j): k for k, j in own}
        aps.append(np.mean([(n + 1) / k for n, (k, _) in enumerate(own)]))
    assert got == want
    assert metrics["queries"] == 20 and abs(metrics["map"] - np.mean(aps)) < 1e-6


def test_top_k_in_small_blocks(spark):
    rng = np.random.default_rng(8)
    v = rng.integers(-3, 4, (90, 5)).astype(float)  # with equal ones
    rows = [(i, i // 4, i % 7, [None, "a", "b"][i % 3], x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, frame long, identity long, team string, embedding array<double>")
    blocks = retrieval.in_blocks
    try:
        retrieval.in_blocks = lambda q, g, w, s: blocks(q, g, w, s, q_block=7, g_block=11)
        got = defaultdict(list)
        for r in retrieval.top_k(df.where("vec_id % 5 = 0"), df, 4, team="team").orderBy("rank").collect():
            got[r["q_id"]].append((r["vec_id"], round(r["similarity"], 6)))
    finally:
        retrieval.in_blocks = blocks
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    for q in range(0, 90, 5):
        fits = [j for j in range(90) if rows[j][1] != rows[q][1] and (rows[j][3] is None or rows[q][3] is None or rows[j][3] == rows[q][3])]
        want = sorted((-round(float(u[q] @ u[j]), 9), j) for j in fits)[:4]
        assert got[q] == [(j, round(-s, 6)) for s, j in want]


def test_adjacent_frames_are_matched_best(spark):
    rng = np.random.default_rng(9)
    rows = [(i, i // 3 * 10, int(rng.integers(0, 4)), rng.normal(size=3).tolist()) for i in range(24)]
    got = evaluate.adjacent_assignment(spark.createDataFrame(rows, "vec_id long, frame long, identity long, embedding array<double>")).first()
    right = n = 0
    for f in range(7):
        a, b = rows[3 * f : 3 * f + 3], rows[3 * f + 3 : 3 * f + 6]
        like = lambda x, y: np.dot(x[3], y[3]) / np.linalg.norm(x[3]) / np.linalg.norm(y[3])
        best = max(itertools.permutations(b), key=lambda p: sum(like(x, y) for x, y in zip(a, p)))
        right, n = right + sum(x[2] == y[2] for x, y in zip(a, best)), n + 3
    assert (got["assignments"], got["correct"]) == (n, right) and got["accuracy_pct"] == pytest.approx(100 * right / n)


def test_accents_of_every_code_point(spark):
    every = [c for c in map(chr, [*range(1, 0xD800), *range(0xE000, 0x110000)]) if unicodedata.decomposition(c) or unicodedata.category(c) == "Mn" or ord(c) % 997 == 0]
    texts = ["".join(every[k : k + 50]) for k in range(0, len(every), 50)] + ["Łukasz Ćwik Őze Dvořák 한글 é", ""]
    plain = lambda t: "".join(x for x in unicodedata.normalize("NFD", t) if unicodedata.category(x) != "Mn")
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", T.strip_accents(F.col("t")).alias("p")).collect()
    wrong = [(texts[r["i"]], r["p"]) for r in rows if r["p"] != plain(texts[r["i"]])]
    assert not wrong, wrong[:2]


def test_detector_ids_pass_or_fall_back(spark):
    box = lambda x: (float(x), 0.0, float(x) + 10, 20.0, 0.9)
    rows = [(1, 0, 1, *box(0), 77), (1, 0, 2, *box(50), 78), (1, 1, 3, *box(1), None), (1, 1, 4, *box(51), 78), (1, 2, 5, *box(2), None)]
    df = spark.createDataFrame(rows, "clip long, frame long, det_id long, x1 double, y1 double, x2 double, y2 double, confidence double, detector_id long")
    got = {r["det_id"]: r["track_id"] for r in tracker.track_batch(df).collect()}
    assert (got[1], got[2]) == (77, 78) and got[3] == got[5] != got[4]


def test_tracker_over_many_batches(spark):
    rng = np.random.default_rng(1)
    rows = [(c, f, 100 * f + k, 40.0 * k + f, 10.0, 40.0 * k + f + 20, 60.0, float(rng.random())) for c in (1, 2, 3) for f in range(40) for k in range(3)]
    df = spark.createDataFrame(rows, "clip long, frame long, det_id long, x1 double, y1 double, x2 double, y2 double, confidence double")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    want = sorted(map(tuple, tracker.track_batch(df).collect()))
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "7")
        assert sorted(map(tuple, tracker.track_batch(df).collect())) == want
    finally:
        spark.conf.set(name, before)
    assert len({(r[0], r[3]) for r in want}) == 9


def test_generated_inputs(spark, tmp_path):
    assert generate.team_kits({"A": "#ff0000", "B": {"primary": "00ff00", "secondary": "#0000FF"}, "C": "red", "D": {"shirt": "#111111", "shorts": "x"}, "E": {}}) == [
        ("A", "shirt", [255, 0, 0]), ("B", "shirt", [0, 255, 0]), ("B", "shorts", [0, 0, 255])
    ]
    assert generate.team_kits(None) == []
    for file in ("dataset/train/s2/img1/1.jpg", "dataset/train/s2/img1/2.jpg", "dataset/train/s1/img1/1.jpg", "dataset/val/v/img1/1.jpg", "dataset/test/none/x.txt", "dataset/other/o/img1/1.jpg"):
        (tmp_path / file).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / file).write_bytes(b"x")
    for root in (tmp_path, tmp_path / "dataset"):
        found = generate.discover_sequences(spark, str(root)).select("split", "sequence", "frames").collect()
        assert sorted(tuple(r) for r in found) == [("train", "s1", 1), ("train", "s2", 2), ("val", "v", 1)]
    manifest = generate.dataset_manifest(spark, {"a": str(tmp_path), "b": None, "c": "/nowhere"})["datasets"]
    assert [(v["configured"], v["exists"]) for v in manifest.values()] == [(True, True), (False, False), (True, False)]
    entries = spark.createDataFrame([("H", "full", None, None), ("A", None, None, None), ("X", "none", [3, 4], None), ("Y", None, None, "Anon")], "team string, squad string, numbers array<int>, prefix string")
    squads = spark.createDataFrame([("full", 9, "Nine", "FW")], "squad string, number int, player string, position string")
    every = generate.rosters(entries, squads).cache()
    assert [tuple(r) for r in every.where("team = 'X'").orderBy("jersey").collect()] == [("X #3", "X", "3", "?"), ("X #4", "X", "4", "?")]
    assert {r["player"] for r in every.where("team = 'Y'").collect()} == {f"Anon roster slot {k}" for k in range(1, 12)}
    rosters = {t: every.where(F.col("team") == t) for t in "HA"}
    meta = generate.clip_metadata("H", "A", rosters, visible={"H": [9]}, colors={"H": {"shirt": "#123456"}}, source={"source_clip": "a.mp4", "start_sec": 3}, named=True)
    assert [p["player_name"] for p in meta["rosters"]["H"]] == ["Nine"] and len(meta["rosters"]["A"]) == 11
    assert meta["team_colors"]["A"] == {"shirt": "#000000"} and meta["public_source"]["start_sec"] == 3 and set(meta["public_source"]) == {*generate.SOURCE, "roster_source"}
    doc = generate.runtime_document({"tracker": {"backend": "simple"}}, 1, "x", [], ["dry run"])
    assert (doc["detector_class"], doc["jersey_ocr_class"], doc["configured_tracker_backend"], doc["configured_detector_weights"], doc["notes"]) == ("int", "str", "simple", None, ["dry run"])


def test_documents(spark, tmp_path):
    (tmp_path / "gt.json").write_text(json.dumps({"expected_visible": {"A": {"players": [{"name": "x"}, {"name": "y"}]}, "Referees": 2}}))
    assert sorted(map(tuple, files.read_expected(spark, str(tmp_path / "gt.json")).collect()), key=str) == [("A", "x", None), ("A", "y", None), ("Referees", None, 2)]
    run = [{"track_id": "1", "resolved_player_id": "p", "resolved_confidence": 0.5, "observations": [{"frame_index": 3, "timestamp": 0.1, "bbox": [0, 1, 2, 3], "detection_confidence": 0.9}]}]
    (tmp_path / "run.json").write_text(json.dumps(run))
    r = files.read_run(spark, str(tmp_path / "run.json")).first()
    assert (r["track_id"], r["frame_index"], r["bbox"]) == ("1", 3, [0, 1, 2, 3])
    df = spark.createDataFrame([(2, "b"), (1, "a")], "n long, name string")
    files.write_json(df, str(tmp_path / "out/deep"))
    assert spark.read.json(str(tmp_path / "out/deep")).count() == 2 and json.loads(files.to_document(df.orderBy("n")))[0] == {"n": 1, "name": "a"}
    with pytest.raises(ValueError):
        files.to_document(df, limit=1)
    assert evaluate.report_text(df, ["n"]) == "n  name\n1  a\n2  b"
    obs = spark.createDataFrame([(1, [0.1], [0.2], [0.3])], "seq long, head_embedding array<double>, body_embedding array<double>, appearance_embedding array<double>")
    assert files.observation_documents(obs).columns == ["seq", "appearance_embedding"]


def test_components_that_do_not_settle_are_an_error(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(64)], "a long, b long")
    with pytest.raises(RuntimeError):
        linking.components(chain, max_rounds=2)


def test_options_and_trackers(spark):
    from tracklake.operators import hooks

    o = hooks.Options.of({"tracker": {"max_age_frames": 3, "other": 1}, "fusion": {"weights": {"jersey": 1.5}}, "visualization": None})
    assert (o.tracker.max_age_frames, o.tracker.min_iou, o.visualization.likely_threshold) == (3, 0.05, 0.25)
    assert o.fusion.named() == {"team": 2.0, "label": 1.5, "head": 1.0, "body": 0.6, "position": 0.35, "track": 0.25}
    with pytest.raises(ValueError):
        hooks.build_tracker({"tracker": {"backend": "none"}})
    rows = [(1, f, f, 10.0, 0.0, 20.0, 20.0, 0.9, 5) for f in (0, 1, 9)]
    df = spark.createDataFrame(rows, "clip long, frame long, det_id long, x1 double, y1 double, x2 double, y2 double, confidence double, detector_id long")
    ids = lambda config: [r["track_id"] for r in hooks.build_tracker(config)(df).orderBy("frame").collect()]
    assert ids({"tracker": {"backend": "botsort"}, "detector": {"use_tracking": True}}) == [5, 5, 5]
    assert ids({"tracker": {"backend": "botsort"}}) == ids({}) == [1, 1, 1]


def test_command_line(spark, small, tmp_path, capsys):
    from tracklake import run

    assert run.main(["--list"]) == 0 and "track_extents" in capsys.readouterr().out
    assert run.main(["track_extents", small, str(tmp_path / "o"), "--json"]) == 0
    assert spark.read.json(str(tmp_path / "o")).count() == 15
    files.write_document({"a": 1}, str(tmp_path / "x/y/doc.json"))
    assert json.loads((tmp_path / "x/y/doc.json").read_text()) == {"a": 1}
    with pytest.raises(SystemExit):
        run.main(["nothing"])


def test_key_points_of_a_crop(spark):
    from tracklake.operators import hooks

    row = spark.createDataFrame([([(2.0, 3.0, 0.5), (0.0, 0.0, 0.1)], 100.0, 50.0, 2.0, 0.5)], "p array<struct<x:double,y:double,confidence:double>>, x1 double, y1 double, sx double, sy double")
    got = row.select(hooks.points_in_frame(F.col("p"), (F.col("x1"), F.col("y1")), (F.col("sx"), F.col("sy"))).alias("p")).first()["p"]
    assert [tuple(x) for x in got] == [(104.0, 51.5, 0.5), (100.0, 50.0, 0.1)]

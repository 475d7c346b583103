"""Order-dependent operators against short brute-force versions, and files and streams."""

import itertools
import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracklake.operators import linking, matching, spatial, tracks, votes
from tracklake.sources import files
from tracklake.streaming import tracker


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10**6))
def test_optimal_pairs_have_least_cost(rows, cols, seed):
    cost = np.random.default_rng(seed).integers(0, 9, (rows, cols)).astype(float)
    got = matching.optimal_pairs(cost)
    n = min(rows, cols)
    assert len(got) == n == len({r for r, _ in got}) == len({c for _, c in got})
    best = min(
        sum(cost[r, c] for r, c in zip(rs, cs)) for rs in itertools.combinations(range(rows), n) for cs in itertools.permutations(range(cols), n)
    )
    assert sum(cost[r, c] for r, c in got) == best


def test_components_of_a_chain_and_a_cycle(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100)]
    got = {r["node"]: r["root"] for r in linking.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_components_without_links(spark):
    assert linking.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_demotion_at_the_ratio(spark):
    claims = [(1, 1, 9.0, list(range(10))), (1, 2, 5.0, [*range(6), *range(20, 24)]), (1, 3, 4.0, [*range(7), *range(30, 33)])]
    got = linking.demote_conflicts(spark.createDataFrame(claims, "identity long, track_id long, score double, frames array<long>"), 0.6)
    assert {r["track_id"]: r["demoted"] for r in got.collect()} == {1: False, 2: False, 3: True}


def test_cascade_moves_losers_down(spark):
    rows = [(0, 1, 1, "a", 9.0), (0, 2, 1, "a", 8.0), (0, 2, 2, "b", 7.0), (0, 3, 1, "b", 6.0), (0, 3, 2, "c", 5.0)]
    got = matching.cascade_dedup(spark.createDataFrame(rows, "team long, track_id long, rank int, label string, score double"))
    assert {r["track_id"]: r["label"] for r in got.collect()} == {1: "a", 2: "b", 3: "c"}


def test_team_flip_needs_confirmation(spark):
    teams = ["a", "a", "b", "a", "a", "b", None, "b", "b"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(teams)], "track_id long, seq long, team string")
    got = [r["segment"] for r in tracks.team_flip_segments(df).orderBy("seq").collect()]
    assert got == [0, 0, 0, 0, 0, 1, 1, 1, 1]


def test_longer_lock(spark):
    v = spark.createDataFrame([(1, "1", 10.0, 0), (1, "14", 3.0, 3)], "track_id long, candidate string, votes double, peaks long")
    assert votes.longer_lock(v).first()["candidate"] == "14"


def test_peak_boundary(spark):
    obs = spark.createDataFrame([(1, 1, "a", 0.85, 1.0), (1, 2, "a", 0.8499, 1.0)], "track_id long, seq long, candidate string, prob double, quality double")
    assert votes.top_k_votes(obs).first()["peaks"] == 1


def test_interpolation_edges(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (1, 10.0, 10.0, 20.0), (2, 5.0, 3.0, 4.0)], "key long, t double, x double, y double")
    q = spark.createDataFrame([(1, -5.0), (1, 5.0), (1, 15.0), (2, 100.0)], "key long, at double")
    got = {(r["key"], r["at"]): (r["x"], r["y"]) for r in tracks.interpolate_positions(a, q).collect()}
    assert got == {(1, -5.0): (-5, -10), (1, 5.0): (5, 10), (1, 15.0): (15, 30), (2, 100.0): (3, 4)}


def test_greedy_is_one_to_one(spark):
    box = "x1 double, y1 double, x2 double, y2 double"
    gt = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 10.0), (2, 0, 1.0, 0.0, 11.0, 10.0)], f"gt_id long, frame long, {box}")
    pred = spark.createDataFrame([(7, 0, 1.0, 0.0, 11.0, 10.0)], f"pred_id long, frame long, {box}")
    assert [(r["gt_id"], r["pred_id"]) for r in spatial.greedy_one_to_one(gt, pred).collect()] == [(1, 7)]


def _detections(spark, n=60):
    rng = np.random.default_rng(1)
    rows, nr = [], 0
    for clip in (1, 2):
        for frame in range(n):
            if frame % 7 == 6:
                rows.append((clip, frame, -1, None, None, None, None, None))
                continue
            for k in range(3):
                x = 100.0 * k + frame * 2 + float(rng.normal())
                rows.append((clip, frame, nr, x, 50.0, x + 30, 110.0, 0.9))
                nr += 1
    return spark.createDataFrame(rows, "clip long, frame long, det_id long, x1 double, y1 double, x2 double, y2 double, confidence double")


def test_tracker_keeps_ids_and_ages(spark):
    got = tracker.track_batch(_detections(spark)).toPandas()
    assert got.groupby("clip")["track_id"].nunique().tolist() == [3, 3]
    state = tracker.TrackerState()
    tracker.step(state, 0, [(0, 0.0, 0.0, 10.0, 10.0, 0.5)])
    for f in range(1, 14):
        tracker.step(state, f, [])
    assert state.tracks == {}



def test_files(spark, tmp_path):
    meta = {"rosters": {"A": [{"player_name": "Zoë", "jersey_number": "9.0"}, {"player_id": "x", "player_name": "Y", "position": "GK"}]}}
    (tmp_path / "m.json").write_text(json.dumps(meta))
    got = [tuple(r) for r in files.read_roster(spark, str(tmp_path / "m.json")).collect()]
    assert got == [("A|Zoë|9", "Zoë", "A", "9", "?"), ("x", "Y", "A", None, "GK")]

    (tmp_path / "gt.txt").write_text("1,2,3,4,5,6,0.5\n1,2,3\n2.0,3,1,1,1,1,1,7,0.25\n")
    assert [(r["frame"], r["track_id"], r["class_id"], r["visibility"]) for r in files.read_mot(spark, str(tmp_path / "gt.txt")).collect()] == [
        (1, 2, None, None),
        (2, 3, 7, 0.25),
    ]
    (tmp_path / "s.ini").write_text("[Sequence]\nframeRate=25\nseqLength=0\nimWidth = 1280\nimHeight=720\n")
    assert tuple(files.read_sequence_info(spark, str(tmp_path / "s.ini")).first()) == (25, None, 1280, 720)

    coco = {
        "images": [{"id": 1, "file_name": "a_mp4-0002.jpg"}],
        "categories": [{"id": 3, "name": "10 José"}],
        "annotations": [{"id": 9, "image_id": 1, "category_id": 3, "bbox": [1, 2, 3, 4]}],
    }
    (tmp_path / "c.json").write_text(json.dumps(coco))
    r = files.read_coco(spark, str(tmp_path / "c.json")).first()
    assert (r["gt_id"], r["frame"], r["jersey"], r["name"], r["x2"], r["y2"]) == (9, 60, "10", "Jose", 4, 6)

    (tmp_path / "t.jsonl").write_text('{"features": [1, 2], "label": 1}\n\n')
    assert files.read_training_rows(spark, str(tmp_path / "t.jsonl")).count() == 1
    (tmp_path / "e.jsonl").write_text("\n")
    with pytest.raises(ValueError):
        files.read_training_rows(spark, str(tmp_path / "e.jsonl"))
    assert files.deep_merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    with pytest.raises(ValueError):
        files.load_config("- 1")


def test_roster_gate(spark):
    rows = spark.createDataFrame([(1, "A", "9"), (2, "A", "8"), (3, None, "8"), (4, "A", None)], "track_id long, team string, label string")
    valid = spark.createDataFrame([("A", "9"), ("A", "9")], "team string, label string")
    got = {r["track_id"]: (r["label"], r["off_roster"]) for r in linking.gate_by_roster(rows, valid).collect()}
    assert got == {1: ("9", None), 2: (None, "8"), 3: ("8", None), 4: (None, None)}

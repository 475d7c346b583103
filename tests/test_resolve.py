"""A clip resolved end to end: planted identities, two clips with the same ids, and a run that is killed and started again."""

import random

import pytest
from tracklake.plans import resolve
from tracklake.plans.stages import Run

PLAYERS = 4


def planted(spark):
    """Two clips with the same ids and times; players walk in lanes, one leaves for a while; a fifth of the reads is wrong."""
    det, reads, kits, truth, roster = [], [], [], [], []
    for clip in (1, 2):
        rng = random.Random(clip)
        for p in range(PLAYERS):
            player = 10 * clip + p
            roster.append((clip, player, f"{clip}-{p % 2}", str(p + 1), "MF"))
            for frame in range(80):
                if p == 1 and 30 <= frame < 44:
                    continue
                d, x, y = frame * 10 + p, 100 + 4 * frame + rng.uniform(-1, 1), 100 + 200 * p + rng.uniform(-1, 1)
                box = (x, y, x + 40, y + 90)
                truth.append((clip, frame, d, player, frame % 3 == 0, *box))
                if rng.random() < 0.03:
                    continue
                det.append((clip, frame, d, *box, 0.9))
                wrong = rng.random() < 0.2
                reads.append((clip, d, frame / 25, 0.95, str((p + 1 + wrong) % PLAYERS + 1 if wrong else p + 1), 0.97))
                kits += [(clip, d, f"{clip}-{s}", 0.08 if s == p % 2 else 0.5) for s in (0, 1)]
    box = "x1 double, y1 double, x2 double, y2 double"
    return {
        "detections": spark.createDataFrame(det, f"clip long, frame long, det_id long, {box}, confidence double"),
        "reads": spark.createDataFrame(reads, "clip long, det_id long, ts_s double, quality double, candidate string, prob double"),
        "kits": spark.createDataFrame(kits, "clip long, det_id long, team string, distance double"),
        "roster": spark.createDataFrame(roster, "clip long, player long, team string, jersey string, position string"),
        "truth": spark.createDataFrame(truth, f"clip long, frame long, gt_id long, name long, visible boolean, {box}"),
    }


def plain(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


def test_planted_identities(spark, tmp_path):
    t = planted(spark)
    got = resolve.resolve_clips(Run(spark, str(tmp_path), "v1"), **t)
    for r in got["evaluation"].collect():
        assert r["recall"] > 0.95 and r["identity_accuracy"] > 0.9 and r["jersey_accuracy"] > 0.8 and r["id_switches"] <= 1
    # the player that left and came back has two tracks with one identity
    held = got["stitched"].where("resolved = 11").select("track_id").distinct().count()
    assert held == 2
    one = {n: df.where("clip = 2") for n, df in t.items()}
    alone = resolve.resolve_clips(Run(spark, str(tmp_path / "one"), "v1"), **one)
    assert plain(alone["evaluation"]) == plain(got["evaluation"].where("clip = 2"))


def test_killed_run_goes_on(spark, tmp_path, monkeypatch):
    t = planted(spark)
    whole = Run(spark, str(tmp_path / "whole"), "v1")
    want = resolve.resolve_clips(whole, **t)
    broken = Run(spark, str(tmp_path / "run"), "v1")
    with monkeypatch.context() as m:
        m.setattr(resolve, "_stitched", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            resolve.resolve_clips(broken, **t)
    # the rest of a table without its manifest is written anew
    again = Run(spark, str(tmp_path / "run"), "v1")
    spark.range(3).write.parquet(f"{tmp_path}/run/stitched-{whole.marks['stitched'][:16]}")
    got = resolve.resolve_clips(again, **t)
    assert again.made == ["stitched", "evidence", "evaluation"]
    for name in want:
        assert plain(got[name]) == plain(want[name])
    assert {r["stage"] for r in again.manifests().collect()} == set(want)
    # other options keep what they do not touch
    other = Run(spark, str(tmp_path / "run"), "v1")
    resolve.resolve_clips(other, **t, config={"assignment": {"window_sec": 2.0}})
    assert other.made == ["assigned", "settled", "stitched", "evidence", "evaluation"]
    newer = Run(spark, str(tmp_path / "run"), "v2")
    resolve.resolve_clips(newer, **t)
    assert len(newer.made) == 12


def test_over_the_given_tables(spark, small):
    got = resolve.resolved_clip(spark, small).collect()
    assert sum(r["n_gt"] for r in got) == spark.read.parquet(f"{small}/events.parquet").count()
    assert all(0 <= r[c] <= 1 for r in got for c in ("recall", "identity_accuracy", "jersey_accuracy"))

"""Streams against their batch twins: the tracker in event time, sliding windows, the append sink; and the tracker's step against a plain loop."""

import datetime
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tracklake.streaming import sinks, tracker, windows

at = lambda seconds: datetime.datetime.fromtimestamp(seconds, datetime.timezone.utc)
SCHEMA = "clip long, frame long, det_id long, x1 double, y1 double, x2 double, y2 double, confidence double, at timestamp"


def frames(clips, n, seed=5):
    """Rows by frame: three walkers a clip, gaps, heartbeats."""
    rng = np.random.default_rng(seed)
    out = []
    for clip, frame in itertools.product(clips, range(n)):
        rows = []
        for k in range(3):
            if frame % 7 != 6 and rng.random() < 0.9:
                x = 100.0 * k + frame * 2 + float(rng.normal())
                rows.append((clip, frame, frame * 10 + k, x, 50.0, x + 30, 110.0, 0.9, at(frame + 1000)))
        out += rows or [(clip, frame, None, None, None, None, None, None, at(frame + 1000))]
    return out


def feed(spark, parts, tmp_path, start):
    """Each part is one micro-batch of the same query."""
    for nr, part in enumerate(parts):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/{nr}"))
        stream = spark.readStream.schema(part.schema).parquet(str(tmp_path / "in/*"))
        start(stream).awaitTermination(180)


def write(df, tmp_path):
    return df.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()


def test_tracker_in_event_time(spark, tmp_path):
    """Micro-batches bring frames in any order within the delay; clip 2 ends early and leaves no state; late rows are counted."""
    rows = frames((1,), 30) + frames((2,), 8, 6)
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted(map(tuple, tracker.track_batch(df).collect()))
    rng = random.Random(1)
    parts = [[], [], []]
    for r in rows:  # a frame may come up to three frames late, its rows in different batches
        parts[min(2, max(0, (r[1] + rng.randrange(0, 4)) // 10))].append(r)
    for p in parts:
        rng.shuffle(p)
    end = [(1, 40, None, None, None, None, None, None, at(1040)), (1, 55, None, None, None, None, None, None, at(1055))]
    late = [(1, 41, 999, 0.0, 0.0, 9.0, 9.0, 0.5, at(1003))]
    frames_of = [spark.createDataFrame(p, SCHEMA) for p in (*parts, end, late)]
    feed(spark, frames_of, tmp_path, lambda s: write(tracker.track_stream(s, delay="4 seconds", idle_ms=20_000), tmp_path))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == want
    clocks = {r["clip"]: r["last_frame"] for r in tracker.clip_clocks(spark, str(tmp_path / "cp")).collect()}
    assert clocks == {1: 40}  # clip 2 is gone, frame 55 waits
    for name in ("tracks", "waiting"):
        held = spark.read.format("statestore").option("path", str(tmp_path / "cp")).option("stateVarName", name).option("flattenCollectionTypes", False).load()
        assert {r["clip"] for r in held.select("key.clip").collect()} <= {1}


def plain_step(tracks, next_id, boxes, max_age=12, min_iou=0.05, reach=120.0):
    """tracks: id -> [box, confidence, misses]. Tries every assignment."""
    def cost(a, b):
        w = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
        union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w
        iou = w / union if union > 0 else 0.0
        d = math.hypot((a[0] + a[2] - b[0] - b[2]) / 2, (a[1] + a[3] - b[1] - b[3]) / 2)
        return 1e3 if iou < min_iou and d > reach else 0.65 * (1 - iou) + 0.35 * min(1.0, d / reach)

    ids = list(tracks)
    best, pairs = math.inf, []
    small, large = sorted((range(len(ids)), range(len(boxes))), key=len)
    for chosen in itertools.permutations(large, len(small)):
        got = [(a, b) if len(ids) <= len(boxes) else (b, a) for a, b in zip(small, chosen)]
        total = sum(cost(tracks[ids[i]][0], boxes[j]) for i, j in got)
        if total < best - 1e-12:
            best, pairs = total, got
    out = {}
    hit = {j: ids[i] for i, j in pairs if cost(tracks[ids[i]][0], boxes[j]) < 0.95}
    for t in ids:
        tracks[t][2] += 1
    for j, t in hit.items():
        tracks[t] = [boxes[j][:4], 0.8 * tracks[t][1] + 0.2 * boxes[j][4], 0]
        out[j] = t
    for t in [t for t in ids if tracks[t][2] > max_age]:
        del tracks[t]
    for j, b in enumerate(boxes):
        if j not in hit:
            tracks[next_id] = [b[:4], b[4], 0]
            out[j], next_id = next_id, next_id + 1
    return next_id, out


@pytest.mark.parametrize("seed", range(12))
def test_step_equals_a_plain_loop(seed):
    rng = random.Random(seed)
    state, tracks, next_id = tracker.TrackerState(), {}, 1
    for frame in range(40):
        boxes = []
        for _ in range(rng.randrange(4)):
            x, y = rng.uniform(0, 250), rng.uniform(0, 150)
            boxes.append((x, y, x + rng.uniform(10, 80), y + rng.uniform(10, 80), rng.random()))
        if len(tracks) > 6:  # the plain loop tries all assignments
            break
        next_id, want = plain_step(tracks, next_id, boxes)
        got = tracker.step(state, frame, [(j, *b) for j, b in enumerate(boxes)])
        assert {d: t for d, t, *_ in got} == want
        assert set(state.tracks) == set(tracks) and all(math.isclose(state.tracks[t][4], tracks[t][1]) for t in tracks)
    assert frame > 3


def test_batches_cut_anywhere(spark):
    df = spark.createDataFrame(frames((1, 2, 3), 40), SCHEMA)
    want = sorted(map(tuple, tracker.track_batch(df).collect()))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n in (1, 7):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(n))
            assert sorted(map(tuple, tracker.track_batch(df).collect())) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_windows_over_a_replayed_table(spark, small, tmp_path):
    obs = spark.read.parquet(f"{small}/events.parquet").select(F.col("user_id").alias("track_id"), F.col("ts").cast("timestamp").alias("at"))
    want = windows.seen_in_windows(obs, "24 hours", "12 hours").collect()
    day = F.floor(F.unix_timestamp("at") / 86400 / 10)
    low, high = obs.agg(F.min(day), F.max(day)).first()
    parts = [obs.where(day == k).orderBy(F.rand(k)) for k in range(low, high + 1)]
    last = obs.agg(F.max("at")).first()[0]
    parts.append(spark.createDataFrame([(-1, last + datetime.timedelta(days=40))], "track_id long, at timestamp"))
    feed(spark, parts, tmp_path, lambda s: write(windows.seen_in_windows(s, "24 hours", "12 hours", delay="1 hour"), tmp_path))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).where("id_sum > 0 or n_tracks > 1").collect())) == sorted(map(tuple, want))


def test_a_batch_delivered_twice_changes_nothing(spark, tmp_path):
    parts = [spark.range(k * 10, k * 10 + 10).toDF("track_id") for k in range(3)]
    feed(spark, parts, tmp_path, lambda s: sinks.accumulate(s, str(tmp_path / "acc"), str(tmp_path / "cp")))
    read = lambda: sorted((r["track_id"], r["batch"]) for r in spark.read.parquet(str(tmp_path / "acc")).collect())
    want = read()
    assert [t for t, _ in want] == list(range(30))
    sinks.batch_writer(str(tmp_path / "acc"))(parts[1], 1)
    assert read() == want

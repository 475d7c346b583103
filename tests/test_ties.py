"""Shares that lie on a limit or half-way between two digits: rows must not hang on the order of a sum."""

import random

from tracklake.plans.more_queries import QUERIES


def test_tail_drop_decides_ties_as_exact_sums_do(spark, tmp_path):
    click = {0: [10, 10, 19], 1: [97, 46, 64]}  # 0.15 of all; 207 of 1024, half-way in the ninth digit
    view = {0: [64, 65, 51, 41], 1: [61, 20, 13, 65, 42, 10, 66, 86, 23, 23, 20, 19, 41, 40, 14, 91, 66, 78, 38, 1]}
    rows, rng = [], random.Random(4)
    for user in range(40):
        own = [(c, k) for c, of in (("click", click), ("view", view)) for k in of[user % 2]]
        if user > 1:
            rng.shuffle(own)
        rows += [(len(rows) + i, "2024-01-01 00:00:00", user, c, 1.0, f'{{"k": {k}}}') for i, (c, k) in enumerate(own)]
    t = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    t.withColumn("ts", t["ts"].cast("timestamp_ntz")).coalesce(1).sortWithinPartitions("event_id").write.parquet(f"{tmp_path}/events.parquet")
    got = {(r["track_id"], r["candidate"]): r["prob"] for r in QUERIES["tail_drop"](spark, str(tmp_path)).collect()}
    shares = {0: (0.15, 0.85), 1: (0.202148438, 0.797851563)}
    assert got == {(u, c): p for u in range(40) for c, p in zip(("click", "view"), shares[u % 2])}


def test_smoothing_deals_the_rows_once_before_they_grow(spark):
    from tracklake.operators import votes

    rows = [(1, "4", 0.5), (1, "71", 0.25), (1, "1", 0.25), (2, "", 0.5), (2, "x9", 0.5), (3, None, 1.0)]
    got = votes.smooth_confusable(spark.createDataFrame(rows, "t long, candidate string, prob double"), ["t"])
    want = {}
    for t, c, p in rows:
        for x, w in [(c, p)] + [(c[:i] + o + c[i + 1 :], 0.6 * p) for i, d in enumerate(c or "") for o in votes.CONFUSABLE.get(d, "")] + [(d + c, 0.6 * p) for d in "12" if c and len(c) == 1]:
            want[t, x] = want.get((t, x), 0.0) + w
    total = {t: sum(w for (u, _), w in want.items() if u == t) for t in (1, 2, 3)}
    assert {(r["t"], r["candidate"]): round(r["prob"], 12) for r in got.collect()} == {k: round(w / total[k[0]], 12) for k, w in want.items()}
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in text and "RepartitionByExpression" in text

"""Missing follow-ups: the wheels by themselves, and the query against a plain replay and against SQL."""

import datetime
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from tracklake.llm import followups
from tracklake.llm.oracles import SQL
from tracklake.llm.queries import QUERIES

HOUR = followups.HOUR
START = datetime.datetime(2024, 1, 1)


class Map(dict):
    """A MapState's calls on a dict."""

    getValue, containsKey, removeKey = dict.__getitem__, dict.__contains__, dict.__delitem__

    def updateValue(self, key, value):
        self[key] = value


@pytest.mark.parametrize("seed", range(5))
def test_wheel_gives_what_is_due(seed):
    rng = random.Random(seed)
    held, wheel, now = [], followups.Wheel(Map(), 2), None
    for _ in range(12):
        low = now or 0
        new = [(low + rng.choice([0, 1, rng.randrange(1 << 33), rng.randrange(1 << 38), rng.randrange(1 << 45), rng.randrange(1 << 58)]), k) for k in range(rng.randrange(30))]
        wheel.add(np.array(new, np.int64).reshape(-1, 2), now)
        held += new
        now = low + rng.choice([0, 1, 1 << 31, 1 << 36, 1 << 46]) if held and rng.random() < 0.7 else rng.choice([t for t, _ in held] or [low])
        now = max(now, low)
        got = sorted(map(tuple, wheel.advance(now).tolist()))
        assert got == sorted(x for x in held if x[0] < now)
        held = [x for x in held if x[0] >= now]
    assert sum(len(v[0]) for v in wheel.state.values()) == 16 * len(held)


def replay(clicks, sales, batches):
    """The alerts and late counts, one event after the other."""
    us = lambda t: int((t - datetime.datetime(1970, 1, 1)) / datetime.timedelta(microseconds=1))

    def batch(arrived, key):
        crc = zlib.crc32(b"" if key is None else str(key).encode())
        hours = 0 if arrived is None else (us(arrived) - followups.START_US) // HOUR + 80 * (crc % 4)
        return min(batches - 1, max(0, hours * batches // 3648))

    events = [(batch(r["arrived_at"], r["click_id"]), r["client_id"], us(r["ts"]), 0) for r in {tuple(c.items()): c for c in clicks}.values() if r["kind"] == "error" and r["client_id"] is not None and r["ts"]]
    events += [(batch(r["arrived_at"], r["sale_id"]), r["client_id"], us(r["sold_at"]), 1) for r in sales if r["client_id"] is not None and r["sold_at"]]
    w = followups.watermarks({b: max(e[2] for e in events if e[0] == b) for b in {e[0] for e in events}}, batches)
    late = [e for e in events if w[e[0]] is not None and e[2] < w[e[0]]]
    out = [(b, c, -1, -1, n) for (b, c), n in Counter(e[:2] for e in late).items()]
    fired = lambda due: next((b for b in range(batches) if w[b] is not None and w[b] > due), batches)
    for client in {e[1] for e in events}:
        now = None
        for _, _, t, sale in sorted((e for e in events if e[1] == client and e not in late), key=lambda e: e[2:]):
            if now and t > now[1]:
                out.append((fired(now[1]), client, *now))
                now = None
            if sale:
                now = None
            else:
                now = (now[0] if now else t, t + followups.DUE_US, (now[2] if now else 0) + 1)
        if now:
            out.append((fired(now[1]), client, *now))
    return sorted(out)


def hard_rows(seed):
    rng = random.Random(seed)
    at = lambda h: START + datetime.timedelta(hours=h)
    clicks, sales = [], []
    for k in range(700):
        client = rng.choice([None, 1, 1, 1, 1, *range(2, 40)])
        h = rng.choice([rng.randrange(0, 2900, 24), rng.uniform(0, 2900)])  # ties of clicks and sales on whole days
        t = at(h)
        arrived = rng.choice([None if t < at(800) else t, t, t, t, t + datetime.timedelta(hours=rng.randrange(300))]) if k % 50 and t < at(800) or t >= at(800) else None
        clicks.append({"click_id": rng.choice([None, k]), "ts": None if k % 90 == 0 else t, "arrived_at": arrived, "client_id": client, "kind": rng.choice(["error", "error", "view", None]), "t": 1, "sale": "x", "n": 2, "bucket": 3, "batch": 4})
        if k % 3 == 0:
            sales.append({"sale_id": k, "client_id": client, "sold_at": None if k % 70 == 0 else at(h + rng.choice([0, 0, 12 - h % 12, 20, -5])), "arrived_at": arrived or t, "t": 5})
    base = [c for c in clicks if c["ts"]][0]
    exact = [{**base, "click_id": 900 + k, "client_id": 77, "ts": at(100) + datetime.timedelta(hours=24 * k, microseconds=k // 3), "arrived_at": at(100), "kind": "error"} for k in range(6)]
    return clicks + clicks[:60] + exact, sales + sales[:40]


CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, t int, sale string, n int, bucket int, batch int"
SALES = "sale_id long, client_id long, sold_at timestamp_ntz, arrived_at timestamp_ntz, t int"


def test_equals_replay(spark):
    clicks, sales = hard_rows(3)
    got = followups.missing_followups(spark.createDataFrame(clicks, CLICKS), spark.createDataFrame(sales, SALES), batches=3, bucket_rows=100, least_buckets=5)
    want = replay(clicks, sales, 3)
    assert sorted(map(tuple, got.collect())) == want
    assert {x[0] for x in want if x[3] > 0} >= {1, 2, 3} and any(x[3] < 0 for x in want) and any(x[4] > 2 for x in want if x[3] > 0)


def test_empty(spark):
    empty = followups.missing_followups(spark.createDataFrame([], CLICKS), spark.createDataFrame([], SALES), batches=2)
    assert empty.columns == ["batch", "client_id", "opened_us", "due_us", "n_rows"] and empty.count() == 0


def test_equals_sql(spark, small):
    con = duckdb.connect()
    for name in ("clicks", "sales"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    want = con.sql(SQL["op12_followups"])
    df = QUERIES["op12_followups"](spark, small).select(*want.columns)
    assert sorted(map(tuple, df.collect())) == sorted(want.fetchall())

"""Alerts for errors that no sale follows, on a bucketed hierarchical timing wheel in streaming state.

Two stateful operators of one Structured Streaming query (``transformWithStateInPandas``) share the work:

* The *event wheel* keeps events that are not final yet. Its keys are buckets of (client, slot of 2^32
  microseconds), so a client with a third of all rows is spread by time. The slots of level k span
  2^(32 + 4k) microseconds; an event goes to the lowest level of which its slot is fewer than ``FAN`` slots ahead. When the tick
  moves to W, slots before W are drained, the others that W has entered cascade to lower levels, and the slot that holds W is sorted
  to the microsecond and cut there. What is drained is final, as every later event is at W or after it, and is
  summed up per client and slot: clicks before the first sale, the first sale, clicks after the last sale. A slot is shorter than
  an obligation, so clicks between two of its sales open and close without a trace.
* The *deadline wheel* has buckets of clients. It joins a client's summaries in order of time with the open obligation; every change
  gives the obligation a new generation and one entry in the wheel of deadlines. A drained entry whose generation is not
  the obligation's is void; the others alert.

A micro-batch is one start of the query on the same checkpoint. Its tick is a row for each bucket, so buckets without events move too.
W comes from a table of one row a batch. Events of one client, time and kind in a batch are one row with a count before anything is dealt out.

Defined cases: rows without client or time are no events; a row without arrival belongs to batch 0, as does one that
arrives before the first hour; a null id has the crc32 of the empty text; equal click rows count once, equal sale rows each; other
columns only tell click rows apart; empty tables give an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tracklake.llm.common import remove, settings, shared_dir

HOUR = 3_600_000_000
START_US = 1_704_067_200_000_000  # 2024-01-01
DUE_US, DELAY_US = 24 * HOUR, 96 * HOUR
SHIFT, STEP, FAN, LEVELS = 32, 4, 16, 7
NEVER = np.iinfo(np.int64).max
TICK, SUMMARY, LATE = 0, 1, 2
_STORE = "spark.sql.streaming.stateStore"
#: Each start makes its stores anew, so a store is closed when its task has committed, takes no disk in advance, and writes its changes, not a snapshot.
SETTINGS = {
    f"{_STORE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STORE}.rocksdb.allowFAllocate": "false",
    f"{_STORE}.rocksdb.changelogCheckpointing.enabled": "true",
    f"{_STORE}.unloadOnCommit": "true",
}
EVENTS = "bucket long, client_id long, t long, sale int, n long"
DRAINED = "kind int, key long, client_id long, lo long, hi long, n long, sold int, sold_at long, lo2 long, hi2 long, n2 long"
ALERTS = "batch int, client_id long, opened_us long, due_us long, n_rows long"


def utc_micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a time; one without a zone is taken as UTC, whatever the session's zone."""
    c = df[name]
    if df.schema[name].dataType.typeName() != "timestamp_ntz":
        return F.unix_micros(c)
    seconds = F.extract(F.lit("SECOND"), c)
    return F.unix_date(c.cast("date")).cast("long") * (24 * HOUR) + F.hour(c).cast("long") * F.lit(HOUR) + F.minute(c).cast("long") * F.lit(60_000_000) + (seconds * 1_000_000).cast("long")


def events_of(clicks: DataFrame, sales: DataFrame, batches: int = 8) -> DataFrame:
    """batch, client_id, t, sale (0 or 1) and n: the events of a batch, client, time and kind."""

    def rows(df: DataFrame, at: str, id_col: str, sale: int) -> DataFrame:
        crc = F.crc32(F.coalesce(df[id_col].cast("string"), F.lit("")).cast("binary"))
        hours = F.floor((utc_micros(df, "arrived_at") - F.lit(START_US)) / F.lit(HOUR)) + 80 * F.pmod(crc, F.lit(4))
        batch = F.least(F.lit(batches - 1), F.greatest(F.lit(0), F.coalesce(F.floor(hours * batches / 3648), F.lit(0))))
        out = df.select(batch.cast("int").alias("batch"), "client_id", utc_micros(df, at).alias("t"), F.lit(sale).alias("sale"))
        return out.where("client_id is not null and t is not null")

    errors = clicks.where("kind = 'error' and client_id is not null and ts is not null").distinct()
    both = rows(errors, "ts", "click_id", 0).union(rows(sales, "sold_at", "sale_id", 1))
    return both.groupBy("batch", "client_id", "t", "sale").agg(F.count(F.lit(1)).alias("n"))


def deal(t: np.ndarray, now: int) -> tuple[np.ndarray, np.ndarray]:
    """Level and slot of every time, seen from ``now``."""
    level = np.full(len(t), LEVELS - 1)
    for k in range(LEVELS - 2, -1, -1):
        level[(t >> (SHIFT + STEP * k)) - (now >> (SHIFT + STEP * k)) < FAN] = k
    return level, t >> (SHIFT + STEP * level)


class Wheel:
    """Rows of whole numbers, the first of which is a time, in a MapState by level and slot."""

    def __init__(self, state, width: int):
        self.state, self.width = state, width

    def _take(self, key: tuple) -> np.ndarray:
        got = np.frombuffer(self.state.getValue(key)[0], np.int64).reshape(-1, self.width)
        self.state.removeKey(key)
        return got

    def advance(self, w: int) -> np.ndarray:
        """The rows before w. Slots that w has entered cascade; the one of level 0 is cut."""
        out = []
        for level, slot in sorted((int(a), int(b)) for a, b in self.state.keys()):
            if slot << (SHIFT + STEP * level) < w:
                rows = self._take((level, slot))
                rows = rows[np.argsort(rows[:, 0], kind="stable")]
                cut = int(np.searchsorted(rows[:, 0], w))
                out.append(rows[:cut])
                self.add(rows[cut:], w)
        return np.concatenate(out) if out else np.zeros((0, self.width), np.int64)

    def add(self, rows: np.ndarray, now: int | None) -> None:
        if not len(rows):
            return
        level, slot = deal(rows[:, 0], int(rows[:, 0].min()) if now is None else now)
        order = np.lexsort((slot, level))
        level, slot = level[order], slot[order]
        cuts = np.flatnonzero((level[1:] != level[:-1]) | (slot[1:] != slot[:-1])) + 1
        for at in np.split(np.arange(len(order)), cuts):
            key, part = (int(level[at[0]]), int(slot[at[0]])), rows[order[at]]
            if self.state.containsKey(key):
                part = np.concatenate((np.frombuffer(self.state.getValue(key)[0], np.int64).reshape(-1, self.width), part))
            self.state.updateValue(key, (part.tobytes(),))


def summed_up(rows: np.ndarray) -> dict[str, np.ndarray]:
    """t, client, sale, n of final events: one summary for each client and slot of level 0."""
    t, client, sale, n = rows.T
    slot = t >> SHIFT
    order = np.lexsort((slot, client))
    t, client, sale, n, slot = t[order], client[order], sale[order] == 1, n[order], slot[order]
    at = np.flatnonzero(np.concatenate(([True], (client[1:] != client[:-1]) | (slot[1:] != slot[:-1])))) if len(t) else np.zeros(0, np.int64)
    size = np.diff(np.append(at, len(t)))
    low = lambda keep: np.minimum.reduceat(np.where(keep, t, NEVER), at) if len(at) else t
    high = lambda keep: np.maximum.reduceat(np.where(keep, t, -NEVER), at) if len(at) else t
    count = lambda keep: np.add.reduceat(np.where(keep, n, 0), at) if len(at) else t
    first, last = low(sale), high(sale)
    # of equal times the click is first
    pre = ~sale & (t <= np.repeat(first, size))
    post = ~sale & (np.repeat(first, size) < NEVER) & (t > np.repeat(last, size))
    return {
        "client_id": client[at], "lo": low(pre), "hi": high(pre), "n": count(pre), "sold": (first < NEVER).astype(np.int32), "sold_at": first,
        "lo2": low(post), "hi2": high(post), "n2": count(post),
    }


class EventWheel(StatefulProcessor):
    """steps: the batch and its W; in the last start also what comes after all batches, with no event left before ``NEVER``."""

    def __init__(self, steps: list[tuple[int, int | None]]):
        self.steps = steps

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.events = Wheel(handle.getMapState("events", "level int, slot long", "rows binary"), 4)

    def handleInputRows(self, key, rows: Iterable[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = [{"kind": [TICK], "key": [int(key[0])]}]
        parts = [p.loc[p["t"].notna(), ["t", "client_id", "sale", "n"]].astype("int64").to_numpy() for p in rows]
        new = np.concatenate(parts)
        for batch, w in self.steps:
            if w is not None:
                out.append({"kind": SUMMARY, "key": batch, **summed_up(self.events.advance(w))})
                late = new[:, 0] < w
                if late.any():
                    clients, which = np.unique(new[late, 1], return_inverse=True)
                    out.append({"kind": LATE, "key": batch, "client_id": clients, "n": np.bincount(which, new[late, 3]).astype(np.int64)})
            self.events.add(new if w is None else new[~late], w)
            new = new[:0]
        names = [x.split()[0] for x in DRAINED.split(", ")]
        yield pd.concat([pd.DataFrame(x).reindex(columns=names, fill_value=0) for x in out if len(x.get("client_id", "x"))], ignore_index=True).astype("int64")

    def close(self) -> None:
        pass


class DeadlineWheel(StatefulProcessor):
    def __init__(self, steps: list[tuple[int, int | None]]):
        self.steps = steps

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.deadlines = Wheel(handle.getMapState("deadlines", "level int, slot long", "rows binary"), 3)
        self.open = handle.getMapState("open", "part int", "rows binary")

    def _joined(self, live: dict, sums: pd.DataFrame, batch: int) -> tuple[list[tuple], dict]:
        """Alerts of obligations that expired before a later event, and the obligations that changed; ``live`` follows."""
        alerts, touched, generation = [], {}, (batch + 1) << 40
        at = lambda has, c: np.where(sums[has] > 0, sums[c], NEVER)
        begins = np.minimum(np.minimum(at("n", "lo"), at("sold", "sold_at")), at("n2", "lo2"))
        sums = sums.iloc[np.argsort(begins, kind="stable")]
        columns = (sums[c].tolist() for c in ("client_id", "lo", "hi", "n", "sold", "sold_at", "lo2", "hi2", "n2"))
        for client, lo, hi, n, sold, sold_at, lo2, hi2, n2 in zip(*columns):
            now = live.get(client)
            if now is None and not n and not n2:
                continue
            generation += 1
            if n:
                if now is not None and lo <= now[1]:
                    now = (now[0], hi + DUE_US, now[2] + n, generation)
                else:
                    if now is not None:
                        alerts.append((batch, client, *now[:3]))
                    now = (lo, hi + DUE_US, n, generation)
            if sold and now is not None:
                if sold_at > now[1]:
                    alerts.append((batch, client, *now[:3]))
                now = None
            if n2:
                now = (lo2, hi2 + DUE_US, n2, generation)
            if now is None:
                live.pop(client, None)
                touched.pop(client, None)
            else:
                live[client] = touched[client] = now
        return alerts, touched

    def handleInputRows(self, key, rows: Iterable[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        given = pd.concat(list(rows), ignore_index=True)
        held = np.frombuffer(self.open.getValue((0,))[0], np.int64).reshape(-1, 5) if self.open.containsKey((0,)) else np.zeros((0, 5), np.int64)
        live = {r[0]: tuple(r[1:]) for r in held.tolist()}
        out = []
        for batch, w in self.steps:
            alerts, touched = self._joined(live, given[(given["kind"] == SUMMARY) & (given["key"] == batch)], batch)
            out += alerts
            self.deadlines.add(np.array([(x[1], client, x[3]) for client, x in touched.items()], np.int64).reshape(-1, 3), w)
            for _, client, generation in self.deadlines.advance(w).tolist() if w is not None else ():
                now = live.get(client)
                if now is not None and now[3] == generation:
                    out.append((batch, client, *now[:3]))
                    del live[client]
        if live or len(held):
            self.open.updateValue((0,), (np.array([(c, *x) for c, x in live.items()], np.int64).tobytes(),))
        late = given[given["kind"] == LATE].groupby(["key", "client_id"])["n"].sum()
        out += [(*k, -1, -1, n) for k, n in late.items()]
        if out:
            yield pd.DataFrame(out, columns=["batch", "client_id", "opened_us", "due_us", "n_rows"], dtype="int64")

    def close(self) -> None:
        pass


def alert_stream(events: DataFrame, buckets: int, steps: list[tuple[int, int | None]]) -> DataFrame:
    """The streaming plan of one start: events (``EVENTS``) in, alerts and late counts (``ALERTS``) out."""
    drained = events.groupBy("bucket").transformWithStateInPandas(EventWheel(steps), DRAINED, "append", "none")
    owner = F.when(F.col("kind") == TICK, F.col("key")).otherwise(F.pmod(F.xxhash64("client_id"), F.lit(buckets)))
    return drained.withColumn("owner", owner).groupBy("owner").transformWithStateInPandas(DeadlineWheel(steps), ALERTS, "append", "none")


def watermarks(latest: dict[int, int], batches: int) -> list[int | None]:
    """W of every batch from the largest time of each."""
    out, top = [], None
    for b in range(batches):
        out.append(None if top is None else top - DELAY_US)
        if b in latest:
            top = latest[b] if top is None else max(top, latest[b])
    return out


def missing_followups(clicks: DataFrame, sales: DataFrame, *, batches: int = 8, bucket_rows: int = 100_000, least_buckets: int = 48) -> DataFrame:
    """batch, client_id, opened_us, due_us and n_rows of every alert, and of every batch and client with late events.

    The events are written once by batch under the shared folder; each batch is then copied into the source's folder and the
    query started on it. The last start also ends the wheels (batch ``batches``).
    """
    spark: SparkSession = clicks.sparkSession
    base = f"{shared_dir(spark)}/followups-{uuid.uuid4().hex}"
    events_of(clicks, sales, batches).write.partitionBy("batch").parquet(f"{base}/staged")
    staged = spark.read.schema("client_id long, t long, sale int, n long, batch int").parquet(f"{base}/staged")
    stats = staged.groupBy("batch").agg(F.max("t").alias("latest"), F.count(F.lit(1)).alias("rows")).collect()  # a row for each batch
    marks = watermarks({r["batch"]: r["latest"] for r in stats}, batches)
    buckets = max(least_buckets, sum(r["rows"] for r in stats) // bucket_rows)
    # a client's events of one slot of level 0 are in one bucket
    bucket = F.pmod(F.xxhash64("client_id", F.shiftright("t", SHIFT)), F.lit(buckets))
    none = lambda kind: F.lit(None).cast(kind)
    ticks = spark.range(0, buckets, 1, 1).select(F.col("id").alias("bucket"), none("long").alias("client_id"), none("long").alias("t"), none("int").alias("sale"), none("long").alias("n"))
    with settings(spark, SETTINGS):
        for b, w in enumerate(marks):
            steps = [(b, w)] + [(batches, NEVER)] * (b == batches - 1)
            own = staged.where(F.col("batch") == b).select(bucket.alias("bucket"), "client_id", "t", "sale", "n")
            own.union(ticks).write.parquet(f"{base}/in/{b}")
            source = spark.readStream.schema(EVENTS).parquet(f"{base}/in/*")
            sink = alert_stream(source, buckets, steps).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
            sink.trigger(availableNow=True).start().awaitTermination()
    for done in ("staged", "in", "checkpoint"):
        remove(spark, f"{base}/{done}")
    return spark.read.schema(ALERTS).parquet(f"{base}/out")

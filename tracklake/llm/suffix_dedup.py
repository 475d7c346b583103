"""Removal of long repeated passages by a sparse, distributed suffix merge sort.

A byte is removed if a string of ``length`` (400) bytes that covers it also starts
anywhere else, in the same document or another. Deciding this for every start takes a
sorted order of suffixes, but not of all of them:

* Every window of 400 bytes is assigned an anchor: the least of the hashed 16-byte
  strings that start in its first 200 bytes, leftmost if equal. The choice depends on
  content alone, so equal windows have their anchors at the same distance, and they share
  at least 200 bytes after it. Consecutive windows mostly share their anchor; an anchor
  with its range of window starts is one record.
* Distinguishing prefixes: hashes of the 200 bytes after the anchors are counted over the whole
  corpus. Anchors whose hash is unique cannot repeat and leave here; no suffix
  of them is exchanged.
* Ranges that are equal as a whole (same bytes, same distances) in two places are
  repeated without further work. Only one record of each different range goes on, and only if
  some range with the same hash is still undecided.
* These go through the merge sort: each task sorts its suffixes, starting at the anchor, and sends
  them as front-coded runs (length of the prefix shared with the one before, and the
  rest). The receiving task merges the runs with a loser tree that keeps each
  candidate's shared prefix with the last winner: different prefixes decide a match
  without looking at bytes, and equal ones are compared from there on. Suffixes
  whose shared prefix reaches 200 bytes form a family, whose windows are compared
  exactly by their bytes at equal distance.
* A family with more than ``hot`` members (a passage embedded in a large share of all
  documents) is not gathered: its windows' hashes are counted by a distributed
  aggregation instead.

Beside the bytes, ``n_passage_marks`` tells of passages by words: among every ``MARK`` windows of ``MARK`` (26) words that follow each
other the one with the least hash is a mark, so every passage of more than 50 words holds a mark, and
the count is that of a document's marks that another document has too. It removes nothing.

Hashes are 64-bit (two equal 64-bit hashes of different strings are not told apart in
the counting steps; the merge compares bytes). Short texts share a buffer, so that the arrays
are long whatever the texts are; no window reaches from one text into the next.

Defined cases: a null or empty text has no bytes; texts below 400 bytes keep all;
repeated rows are copies of each other like any two documents, and their ranges are held
once for all rows with the same id and text; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.llm.common import by_arrow, raw_texts, scratch, spool

LENGTH, REACH, GRAM = 400, 200, 16
MARK = 26
BLOCK, LONG = 1 << 17, 4096
SEGMENT = 1 << 18
_rng = np.random.default_rng(20240229)
_TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(x: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, x, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, SEGMENT + 2 * LENGTH + 1), _powers(_INVERSE, SEGMENT + 2 * LENGTH + 1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Rolling:
    """Hashes of any substrings of a piece of at most SEGMENT + 2 * LENGTH bytes."""

    def __init__(self, b: np.ndarray):
        self.sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_TABLE[b] * _UP[: len(b)], out=self.sums[1:])

    def of(self, start, stop) -> np.ndarray:
        return _mix((self.sums[stop] - self.sums[start]) * _DOWN[start])

    def every(self, n: int, count: int) -> np.ndarray:
        return _mix((self.sums[n : n + count] - self.sums[:count]) * _DOWN[:count])


def stretch_hashes(flat: bytes, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The hashes of the given stretches (starts ascending) of a text; a hash depends on the stretch's bytes alone.

    Stretches of up to 4,096 bytes are hashed together, as differences of one running sum; longer ones by XXH64.
    """
    out = np.zeros(len(starts), np.uint64)
    long = stops - starts > LONG
    for i in np.flatnonzero(long).tolist():
        out[i] = xxhash.xxh64_intdigest(flat[starts[i] : stops[i]], 42)
    short = np.flatnonzero(~long)
    b = np.frombuffer(flat, np.uint8)
    for part in np.split(short, np.flatnonzero(np.diff(starts[short] // BLOCK)) + 1):
        if len(part):
            lo, hi = int(starts[part[0]]), int(stops[part].max())
            out[part] = Rolling(b[lo:hi]).of(starts[part] - lo, stops[part] - lo)
    return out


def passage_marks(raw: bytes | None) -> np.ndarray:
    """The distinct hashes of a text's marks; none for a text of fewer than 51 words."""
    words = (raw or b"").split()
    if len(words) < 2 * MARK - 1:
        return np.zeros(0, np.uint64)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - MARK + 1
    h = stretch_hashes(flat, starts[:n], ends[MARK - 1 :])
    least = h
    width = 1
    while 2 * width <= MARK:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    rest = MARK - width
    return np.unique(np.minimum(least[: len(least) - rest], least[rest:]))


def _shared_marks(docs: DataFrame) -> DataFrame:
    """k, h and n_passage_marks of the rows with a mark that a row with another id or text has too."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            found = [passage_marks(raw) for raw in raw_texts(batch.column("text"))]
            row = np.repeat(np.arange(len(found)), [len(x) for x in found])
            k, h = (batch.column(c).to_numpy()[row] for c in ("k", "h"))
            return {"k": pa.array(k), "h": pa.array(h), "w": pa.array(np.concatenate(found).view(np.int64))}

        return work

    marks = spool(by_arrow(docs.select("k", "h", "text"), "k long, h long, w long", make, 256))
    row = F.struct("k", "h")
    shared = spool(marks.groupBy("w").agg(F.min(row).alias("lo"), F.max(row).alias("hi")).where("lo <> hi").select("w"))
    return marks.join(shared, "w", "left_semi").distinct().groupBy("k", "h").agg(F.count(F.lit(1)).alias("n_passage_marks"))


def _buffers(raws: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts of 400 bytes or more, gathered or cut: a buffer, and for each of its parts the text, the start there and the start here."""
    parts: list[tuple[int, int, bytes]] = []
    held = 0

    def done():
        lens = np.array([len(x) for _, _, x in parts])
        return (
            np.frombuffer(b"".join(x for _, _, x in parts), np.uint8),
            np.array([nr for nr, _, _ in parts]),
            np.array([base for _, base, _ in parts]),
            np.concatenate(([0], np.cumsum(lens))),
        )

    for nr, raw in enumerate(raws):
        for base in range(0, len(raw or b"") - LENGTH + 1, SEGMENT):
            part = raw[base : base + SEGMENT + LENGTH - 1]
            if parts and held + len(part) > SEGMENT + LENGTH:
                yield done()
                parts, held = [], 0
            parts.append((nr, base, part))
            held += len(part)
    if parts:
        yield done()


def anchors(raws: list[bytes | None]) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays nr (of the text), s0, s1 (first and last window start), x (anchor), whole and lead hashes."""
    for b, nr, base, starts in _buffers(raws):
        roll = Rolling(b)
        m = len(b) - GRAM + 1
        low = (roll.every(GRAM, m) >> np.uint64(20) << np.uint64(20)) | np.arange(m, dtype=np.uint64)
        width = 1
        while 2 * width <= REACH:
            low = np.minimum(low[: len(low) - width], low[width:])
            width *= 2
        rest = REACH - width
        low = np.minimum(low[: len(low) - rest], low[rest:])
        windows = np.diff(starts) - LENGTH + 1
        part = np.repeat(np.arange(len(nr)), windows)
        p = np.arange(len(part)) + np.repeat(starts[:-1] - np.concatenate(([0], np.cumsum(windows)[:-1])), windows)
        at = (low[p] & np.uint64((1 << 20) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (part[1:] != part[:-1]))))
        last = np.append(first[1:], len(p)) - 1
        s0, s1, x, part = p[first], p[last], at[first], part[first]
        lead = roll.of(x, x + REACH)
        whole = _mix(roll.of(s0, s1 + LENGTH) ^ ((x - s0).astype(np.uint64) << np.uint64(16)) ^ (s1 - s0).astype(np.uint64))
        move = base[part] - starts[part]
        yield nr[part], s0 + move, s1 + move, x + move, whole, lead


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


_RECORD = "k long, h long, s0 long, nd int, whole long, lead long"


def _records(docs: DataFrame) -> DataFrame:
    """A row for every anchor: row keys, first window start, nd (windows after it, 16 bits; bytes to the anchor above), hashes."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            k, h = (batch.column(c).to_numpy() for c in ("k", "h"))
            got = list(anchors(list(raw_texts(batch.column("text")))))
            nr, s0, s1, x, whole, lead = (np.concatenate(c) for c in zip(*got)) if got else [np.zeros(0, np.int64)] * 6
            nd = ((s1 - s0) | (x - s0) << 16).astype(np.int32)
            whole, lead = whole.view(np.int64), lead.view(np.int64)
            return {n: pa.array(v) for n, v in zip(("k", "h", "s0", "nd", "whole", "lead"), (k[nr], h[nr], s0, nd, whole, lead))}

        return work

    return by_arrow(docs.select("k", "h", "text"), _RECORD, make, 256)


class Marks:
    """The column of marks of a batch: flat arrays, and where each row's begin."""

    def __init__(self, column: pa.Array):
        flat = column.flatten()
        self.starts = np.concatenate(([0], np.cumsum(column.value_lengths().fill_null(0).to_numpy())))
        for nr in range(flat.type.num_fields):
            setattr(self, flat.type.field(nr).name, flat.field(nr).to_numpy(zero_copy_only=False))


# ------------------------------------------------------------- runs and merging


def _shared(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix, known to be at least ``at``."""
    n = min(len(a), len(b))
    while at + 32 <= n and a[at : at + 32] == b[at : at + 32]:
        at += 32
    while at < n and a[at] == b[at]:
        at += 1
    return at


def front_code(items: list[tuple[bytes, bytes]]) -> bytes:
    """A run: (suffix, payload) pairs, sorted, each with its shared prefix's length and the rest."""
    items.sort()
    out, before = [], b""
    for suffix, load in items:
        n = _shared(before, suffix, 0)
        out += [struct.pack("<HHH", n, len(suffix) - n, len(load)), suffix[n:], load]
        before = suffix
    return b"".join(out)


def read_run(run: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """(prefix shared with the one before, suffix, payload) of each item."""
    at, before = 0, b""
    while at < len(run):
        n, rest, load = struct.unpack_from("<HHH", run, at)
        at += 6
        before = before[:n] + run[at : at + rest]
        at += rest
        yield n, before, run[at : at + load]
        at += load


def merge_runs(runs: list[bytes]) -> Iterator[tuple[int, bytes, bytes]]:
    """Merge with a loser tree; yields (prefix shared with the last winner, suffix, payload)."""
    sources = [read_run(r) for r in runs]
    size = 1
    while size < len(sources):
        size *= 2
    heads: list[tuple[int, bytes, bytes] | None] = [next(s, None) for s in sources] + [None] * (size - len(sources))
    shared = [0] * size  # with the last winner
    tree = [0] * size  # losers at 1..size-1

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); afterwards the loser's prefix is the one it shares with the winner."""
        x, y = heads[a], heads[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        n = _shared(x[1], y[1], shared[a])
        if x[1][n : n + 1] <= y[1][n : n + 1]:
            shared[b] = n
            return a, b
        shared[a] = n
        return b, a

    def build(node: int) -> int:
        if node >= size:
            return node - size
        win, lose = play(build(2 * node), build(2 * node + 1))
        tree[node] = lose
        return win

    top = build(1) if size > 1 else 0
    while heads[top] is not None:
        _, suffix, load = heads[top]
        yield shared[top], suffix, load
        head = heads[top] = next(sources[top], None)
        shared[top] = head[0] if head else 0
        node = (top + size) // 2
        while node:
            top, tree[node] = play(top, tree[node])
            node //= 2


_META = "<qqqHH?"  # k, h, first window start, windows, bytes before the anchor, undecided


def _runs(held: DataFrame, parts: int, hot: int) -> DataFrame:
    """Front-coded sorted runs of the undecided families, by receiving task."""

    def make():
        seen: set[tuple[int, int]] = set()  # of rows with the same id and text one sends its suffixes

        def work(batch: pa.RecordBatch) -> dict:
            to: dict[int, list[tuple[bytes, bytes]]] = defaultdict(list)
            marks = Marks(batch.column("marks"))
            open_ = (marks.members > 0) & (marks.members <= hot)
            count = np.concatenate(([0], np.cumsum(open_)))
            k, h = (batch.column(c).to_numpy() for c in ("k", "h"))
            rows = enumerate(raw_texts(batch.column("text")))
            for i, raw in rows:
                a, b = marks.starts[i], marks.starts[i + 1]
                if count[a] == count[b] or (k[i], h[i]) in seen:
                    continue
                seen.add((k[i], h[i]))
                for j in (np.flatnonzero(open_[a:b]) + a).tolist():
                    s0, nd = int(marks.s0[j]), int(marks.nd[j])
                    n, before = nd & 0xFFFF, nd >> 16
                    meta = struct.pack(_META, k[i], h[i], s0, n + 1, before, marks.single[j])
                    x = s0 + before
                    to[int(marks.lead[j]) % parts].append((raw[x : s0 + n + LENGTH], meta + raw[s0:x]))
            return {"p": pa.array(list(to), pa.int32()), "run": pa.array([front_code(x) for x in to.values()], pa.binary())}

        return work

    return by_arrow(held.select("k", "h", "text", "marks"), "p int, run binary", make, 4096)


def _family(members: list[tuple[bytes, bytes]]) -> list[tuple[int, int, int, int]]:
    """Repeated windows (k, h, first, last start) of the undecided members of one family."""
    if len(members) < 2:
        return []
    seen: dict[tuple[int, bytes], int] = {}
    lists = []
    for suffix, load in members:
        k, h, s0, count, before, single = struct.unpack_from(_META, load)
        whole = load[struct.calcsize(_META) :] + suffix
        keys = [(before - i, hash(whole[i : i + LENGTH])) for i in range(count)]
        lists.append((k, h, s0, single, whole, keys))
        for key in keys:
            seen[key] = seen.get(key, 0) + 1
    # equal hashes are confirmed by the bytes before they count
    texts: dict[tuple[int, int], dict[bytes, int]] = defaultdict(lambda: defaultdict(int))
    for _, _, _, _, whole, keys in lists:
        for i, key in enumerate(keys):
            if seen[key] > 1:
                texts[key][whole[i : i + LENGTH]] += 1
    out = []
    for k, h, s0, single, whole, keys in lists:
        if not single:
            continue
        start = None
        for i, key in enumerate([*keys, None]):
            again = key is not None and seen[key] > 1 and texts[key][whole[i : i + LENGTH]] > 1
            if again and start is None:
                start = i
            elif not again and start is not None:
                out.append((k, h, s0 + start, s0 + i - 1))
                start = None
    return out


def _merged(part: pd.DataFrame) -> pd.DataFrame:
    out: list[tuple[int, int, int, int]] = []
    family: list[tuple[bytes, bytes]] = []
    for n, suffix, load in merge_runs(part["run"].tolist()):
        if n < REACH and family:
            out += _family(family)
            family = []
        family.append((suffix, load))
    out += _family(family)
    return pd.DataFrame(out, columns=["k", "h", "s0", "s1"], dtype="int64")


def window_hashes(raw: bytes, s0: np.ndarray, s1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The window starts of the given ranges and the windows' hashes, which depend on their bytes alone."""
    n = s1 - s0 + 1
    at = np.arange(n.sum()) + np.repeat(s0 - np.concatenate(([0], np.cumsum(n)[:-1])), n)
    b = np.frombuffer(raw, np.uint8)
    if len(raw) <= SEGMENT:
        return at, Rolling(b).of(at, at + LENGTH)
    return at, np.concatenate([Rolling(b[a : z + LENGTH]).every(LENGTH, z - a + 1) for a, z in zip(s0.tolist(), s1.tolist())])


def _hot_windows(held: DataFrame, hot: int) -> DataFrame:
    """Window hashes of the families that are too large to be gathered."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            marks = Marks(batch.column("marks"))
            k, h = (batch.column(c).to_numpy() for c in ("k", "h"))
            many = np.flatnonzero(marks.members > hot)
            row = np.searchsorted(marks.starts, many, side="right") - 1
            out: list[tuple[np.ndarray, ...]] = []
            for i, raw in enumerate(raw_texts(batch.column("text"))):
                lo, hi = np.searchsorted(row, (i, i + 1))
                if lo < hi:
                    j = many[lo:hi]
                    n = marks.nd[j] & 0xFFFF
                    s, w = window_hashes(raw, marks.s0[j], marks.s0[j] + n)
                    out.append((np.full(len(s), k[i]), np.full(len(s), h[i]), s, w.view(np.int64), np.repeat(marks.single[j].astype(bool), n + 1)))
            kinds = (np.int64, np.int64, np.int64, np.int64, bool)
            got = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, t) for t in kinds]
            return dict(zip(("k", "h", "s", "w", "single"), map(pa.array, got)))

        return work

    return by_arrow(held.select("k", "h", "text", "marks"), "k long, h long, s long, w long, single boolean", make, 256)


def merged_spans(s0: np.ndarray, s1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal covered stretches of ranges of repeated window starts."""
    if not len(s0):
        return s0, s1
    order = np.argsort(s0, kind="stable")
    start, reach = s0[order], np.maximum.accumulate(s1[order] + LENGTH)
    first = np.flatnonzero(np.concatenate(([True], start[1:] > reach[:-1])))
    return start[first], reach[np.append(first[1:], len(start)) - 1]


def _kept_digest(raw: bytes, starts: list[int], ends: list[int]) -> str:
    digest, at = hashlib.sha256(), 0
    for s, e in zip(starts, ends):
        digest.update(raw[at:s])
        at = e
    digest.update(raw[at:])
    return digest.hexdigest()


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", hot: int = 1000, lot: int = 10_000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_marks and spans (byte ranges) of every row."""
    spark = docs.sparkSession
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(id_col).alias("k"), F.xxhash64(text).alias("h"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    mark = ["s0", "nd", "lead", "members", "single"]
    with scratch(spark):
        passages = spool(_shared_marks(rows), keep=True)
    with scratch(spark):
        with scratch(spark):
            records = spool(_records(rows))
            # written first, so that both sides of the joins are plain shuffles and a hot key can be split
            twice = spool(records.groupBy("lead").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("lead"))
            able = spool(records.join(twice, "lead", "left_semi"), keep=True)
        ranges = able.groupBy("lead", "whole").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("k", "h", "s0", "nd")).alias("one"))
        ranges = spool(ranges)
        families = spool(
            ranges.groupBy("lead")
            .agg(F.count(F.lit(1)).alias("members"), F.max((F.col("c") == 1).cast("int")).alias("open"))
            .where("members > 1 and open = 1")
            .select("lead", "members")
        )
        undecided = spool(ranges.join(families, "lead").select("one.*", "lead", "members", (F.col("c") == 1).alias("single")))
        decided = able.join(ranges.where("c > 1").select("lead", "whole"), ["lead", "whole"], "left_semi").select(
            "k", "h", "s0", "nd", "lead", F.lit(0).cast("long").alias("members"), F.lit(False).alias("single")
        )
        # a set: rows with the same id and text have the same records
        marks = decided.unionByName(undecided).groupBy("k", "h").agg(F.collect_set(F.struct(*mark)).alias("marks"))
        marks = spool(marks, keep=True)
        sizes = undecided.agg(F.count(F.lit(1)), F.max("members")).first()
    held = spool(rows.join(marks, ["k", "h"]))
    n_open, largest = sizes[0], sizes[1] or 0
    parts = max(1, n_open // lot, min(n_open, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    found = _runs(held, parts, hot).groupBy("p").applyInPandas(_merged, "k long, h long, s0 long, s1 long")
    if largest > hot:
        windows = spool(_hot_windows(held, hot).distinct())
        again = windows.groupBy("w").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("w")
        found = found.union(
            windows.where("single").join(again, "w", "left_semi").select("k", "h", F.col("s").alias("s0"), F.col("s").alias("s1"))
        )
    more = found.groupBy("k", "h").agg(F.collect_set(F.struct("s0", "s1")).alias("more"))
    spans_type = "array<struct<start:long,stop:long>>"
    schema = f"doc_id {kind}, k long, h long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans {spans_type}"

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            marks, extra = Marks(batch.column("marks")), Marks(batch.column("more"))
            n_bytes, removed, digests, cuts = [], [], [], []
            for i, raw in enumerate(raw_texts(batch.column("text"))):
                a, b, c, d = marks.starts[i], marks.starts[i + 1], extra.starts[i], extra.starts[i + 1]
                known = marks.members[a:b] == 0
                s0, nd = marks.s0[a:b][known], marks.nd[a:b][known]
                starts, ends = merged_spans(np.concatenate((s0, extra.s0[c:d])), np.concatenate((s0 + (nd & 0xFFFF), extra.s1[c:d])))
                n_bytes.append(len(raw))
                removed.append(int((ends - starts).sum()))
                digests.append(_kept_digest(raw, starts.tolist(), ends.tolist()))
                cuts.append((starts, ends))
            flat = [np.concatenate(c).astype(np.int64) for c in zip(*cuts)]
            n = np.array([len(s) for s, _ in cuts])
            offsets = pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32))
            spans = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(x) for x in flat], names=["start", "stop"]))
            return {
                **{c: batch.column(c) for c in ("doc_id", "k", "h")},
                "n_bytes": pa.array(n_bytes, pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "n_spans": pa.array(n.astype(np.int64)),
                "kept_sha256": pa.array(digests),
                "spans": spans,
            }

        return work

    touched = by_arrow(held.join(more, ["k", "h"], "left").select("doc_id", "k", "h", "text", "marks", "more"), schema, make, 512)
    plain = F.coalesce(text, F.lit(""))
    others = (
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.xxhash64(id_col).alias("k"),
            F.xxhash64(text).alias("h"),
            F.octet_length(plain).cast("long").alias("n_bytes"),
            F.lit(0).cast("long").alias("n_removed"),
            F.lit(0).cast("long").alias("n_spans"),
            F.sha2(plain.cast("binary"), 256).alias("kept_sha256"),
            F.array().cast(spans_type).alias("spans"),
        )
        .join(marks.select("k", "h"), ["k", "h"], "left_anti")
        .select(*touched.columns)
    )
    out = touched.unionByName(others).join(passages, ["k", "h"], "left")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.coalesce("n_passage_marks", F.lit(0).cast("long")).alias("n_passage_marks"), "spans")

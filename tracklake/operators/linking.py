"""Links between tracks in time and space, their components, and conflicts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.functions import geometry as G
from tracklake.functions import vector as V


def _key(clip: str | None) -> list[str]:
    """The columns that keep clips apart."""
    return [clip] if clip else []


def _buckets(low: Column, high: Column, size: float) -> Column:
    return F.explode(F.sequence(F.floor(low / size), F.floor(high / size)))


def gap_candidates(tracks: DataFrame, max_gap: float, max_distance: float, *, clip: str | None = None) -> DataFrame:
    """Pairs (a, b) where b starts within ``max_gap`` after a's end, same team (and clip, if its column is given), ends close together.

    A range join by time buckets: a start meets the buckets that an end can reach. ``tracks``
    has track_id, team, start_s, end_s, x0, y0 (first position), x1, y1 (last position).
    """
    key = _key(clip)
    a = tracks.select(
        *key, F.col("track_id").alias("a"), "team", F.col("end_s").alias("a_end"), F.col("x1").alias("ax"), F.col("y1").alias("ay"),
    ).withColumn("bucket", _buckets(F.col("a_end"), F.col("a_end") + max_gap, max_gap))
    b = tracks.select(
        *key, F.col("track_id").alias("b"), "team", F.col("start_s").alias("b_start"), F.col("x0").alias("bx"), F.col("y0").alias("by"),
        F.floor(F.col("start_s") / max_gap).alias("bucket"),
    )
    gap = F.col("b_start") - F.col("a_end")
    return (
        a.join(b, [*key, "team", "bucket"])
        .where((F.col("a") != F.col("b")) & (gap >= 0) & (gap <= max_gap))
        .withColumn("gap", gap)
        .withColumn("distance", G.distance((F.col("ax"), F.col("ay")), (F.col("bx"), F.col("by"))))
        .where(F.col("distance") <= max_distance)
        .select(*key, "a", "b", "gap", "distance")
    )


def nearest_successor(pairs: DataFrame, *, clip: str | None = None) -> DataFrame:
    order = Window.partitionBy(*_key(clip), "a").orderBy("distance", "gap", "b")
    return pairs.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def gap_stitch(pairs: DataFrame, scores: DataFrame, rounds: int = 5) -> DataFrame:
    """Greedy chains: per round, sources by score take their nearest free successor, which is consumed.

    The candidate pairs are cut by the join before; the order makes the rest sequential, but only among
    tracks that pairs connect: each component is stitched by itself.
    ``scores`` has track_id, score. Returns source, sink, round.
    """
    pairs = checkpointed(pairs.select("a", "b", "distance", "gap"))
    group = components(pairs.select("a", "b"))
    rows = pairs.join(scores, pairs.a == scores.track_id).join(group, pairs.a == group.node).select("root", "a", "b", "distance", "gap", "score")

    def stitch(rows: pd.DataFrame) -> pd.DataFrame:
        by: dict[int, list[tuple[float, float, int]]] = {}
        score = dict(zip(rows["a"], rows["score"]))
        for r in rows.itertuples():
            by.setdefault(r.a, []).append((r.distance, r.gap, r.b))
        used: set[int] = set()
        out, sources = [], sorted(by, key=lambda a: (-score[a], a))
        for nr in range(rounds):
            reached = []
            for a in sources:
                free = [x for x in sorted(by.get(a, ())) if x[2] not in used]
                if free:
                    used.add(free[0][2])
                    reached.append(free[0][2])
                    out.append((a, free[0][2], nr))
            sources = sorted((b for b in reached if b in by), key=lambda a: (-score.get(a, 0.0), a))
            if not sources:
                break
        return pd.DataFrame(out, columns=["source", "sink", "round"])

    return rows.groupBy("root").applyInPandas(stitch, "source long, sink long, round int")


def _reaches(part: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The ends and, in order of time and id, the starts of a block of ``_gap_blocks``."""
    return part[~part["starts"]].sort_values(["t", "id"]), part[part["starts"]].sort_values(["t", "id"])


def _gap_blocks(tracks: DataFrame, max_gap: float, clip: str | None) -> tuple[DataFrame, list[str]]:
    """Every end of a track in the bucket of its time, and every start in its own bucket and the one before, where all ends that reach it are."""
    key = [*_key(clip), "team", "bucket"]
    at = lambda starts, t, x, y, back: F.struct(
        (F.floor(F.col(t) / max_gap) - back).alias("bucket"), F.lit(starts).alias("starts"), F.col(t).alias("t"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")
    )
    dealt = tracks.where("team is not null").select(
        *_key(clip), "team", F.col("track_id").alias("id"), F.inline(F.array(at(False, "end_s", "x1", "y1", 0), at(True, "start_s", "x0", "y0", 0), at(True, "start_s", "x0", "y0", 1)))
    )
    return dealt.where("t is not null"), key


def gap_nearest(tracks: DataFrame, max_gap: float, max_distance: float, *, clip: str | None = None) -> DataFrame:
    """(clip,) a, b, gap, distance: ``nearest_successor`` of ``gap_candidates``; a block's pairs are compared as matrices and only the nearest leave it."""
    dealt, key = _gap_blocks(tracks, max_gap, clip)
    kinds = {f.name: f.dataType.simpleString() for f in dealt.schema}

    def nearest(part: pd.DataFrame) -> pd.DataFrame:
        a, b = _reaches(part)
        out, size = [], 256
        at, bt = a["t"].to_numpy(), b["t"].to_numpy()
        (ai, ax, ay), (bi, bx, by) = ([df[c].to_numpy() for c in ("id", "x", "y")] for df in (a, b))
        for k in range(0, len(a), size):
            rows = slice(k, k + size)
            some = slice(np.searchsorted(bt, at[rows][0]), np.searchsorted(bt, at[rows][-1] + max_gap + 1, side="right"))
            if some.start >= some.stop:
                continue
            gap = bt[None, some] - at[rows, None]
            dx, dy = ax[rows, None] - bx[None, some], ay[rows, None] - by[None, some]
            far = np.sqrt(dx * dx + dy * dy)
            far[~((gap >= 0) & (gap <= max_gap) & (far <= max_distance) & (bi[None, some] != ai[rows, None]))] = np.inf
            best = far.argmin(axis=1)  # the first of equal ones has the smallest gap, then id
            each = np.arange(len(best))
            found = np.isfinite(far[each, best])
            out.append(pd.DataFrame({"a": ai[rows][found], "b": bi[some][best[found]], "gap": gap[each, best][found], "distance": far[each, best][found]}))
        got = pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=["a", "b", "gap", "distance"])
        for c in _key(clip):
            got.insert(0, c, part[c].iloc[0])
        return got

    schema = "".join(f"{c} {kinds[c]}, " for c in _key(clip)) + f"a {kinds['id']}, b {kinds['id']}, gap double, distance double"
    return dealt.groupBy(*key).applyInPandas(nearest, schema)


def gap_forest(tracks: DataFrame, max_gap: float, max_distance: float, *, clip: str | None = None) -> DataFrame:
    """(a, b): some of the pairs of ``gap_candidates``, fewer than a block's ends and starts, that connect the same tracks.

    A block is searched breadth first: every track is reached once, by one edge, and then leaves the search.
    """
    dealt, key = _gap_blocks(tracks, max_gap, clip)
    kind = dealt.schema["id"].dataType.simpleString()

    def forest(part: pd.DataFrame) -> pd.DataFrame:
        a, b = _reaches(part)
        side = [{c: df[c].to_numpy() for c in ("id", "t", "x", "y")} for df in (a, b)]
        open_ = [np.arange(len(a)), np.arange(len(b))]
        out: list[tuple[np.ndarray, np.ndarray]] = []

        def met(s: int, i: int) -> np.ndarray:
            """The open rows of the other side that pair with row i; they are no longer open."""
            me, other, rest = side[s], side[1 - s], open_[1 - s]
            t = me["t"][i]
            low, high = (t, t + max_gap) if s == 0 else (t - max_gap, t)
            lo, hi = np.searchsorted(other["t"][rest], [low - 1, high + 1])
            rows = rest[lo:hi]
            gap = (other["t"][rows] - t) if s == 0 else (t - other["t"][rows])
            dx, dy = other["x"][rows] - me["x"][i], other["y"][rows] - me["y"][i]
            fits = (gap >= 0) & (gap <= max_gap) & (np.sqrt(dx * dx + dy * dy) <= max_distance) & (other["id"][rows] != me["id"][i])
            if fits.any():
                open_[1 - s] = np.concatenate((rest[:lo], rows[~fits], rest[hi:]))
            return rows[fits]

        seen = np.zeros(len(a), bool)
        for first in range(len(a)):
            if seen[first]:
                continue
            seen[first] = True
            open_[0] = open_[0][open_[0] != first]
            todo = [(0, first)]
            while todo:
                s, i = todo.pop()
                new = met(s, i)
                if not len(new):
                    continue
                if s == 1:
                    seen[new] = True
                ends = (np.full(len(new), side[s]["id"][i]), side[1 - s]["id"][new])
                out.append(ends if s == 0 else ends[::-1])
                todo += [(1 - s, j) for j in new.tolist()]
        if not out:
            return pd.DataFrame(columns=["a", "b"])
        return pd.DataFrame({"a": np.concatenate([x for x, _ in out]), "b": np.concatenate([y for _, y in out])})

    return dealt.groupBy(*key).applyInPandas(forest, f"a {kind}, b {kind}")


def stitch_tracks(tracks: DataFrame, max_gap: float, max_distance: float, rounds: int = 5, *, clip: str | None = None) -> DataFrame:
    """source, sink, round: ``gap_stitch`` of ``gap_candidates``, without making the pairs.

    tracks: as there, and score. Tracks of different teams never meet, so a team (of a clip) is one group, of which a task holds a few numbers
    a track; a source looks for its nearest free successor among the starts that its end reaches.
    """
    key = [*_key(clip), "team"]
    rows = tracks.where("team is not null").select(*key, F.col("track_id").alias("id"), "start_s", "end_s", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")], F.col("score").cast("double").alias("score"))

    def stitch(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["start_s", "id"])
        ids, start, end, x0, y0, x1, y1, score = (part[c].to_numpy() for c in ("id", "start_s", "end_s", "x0", "y0", "x1", "y1", "score"))
        rank = np.empty(len(ids), np.int64)
        rank[np.lexsort((ids, -score))] = np.arange(len(ids))
        keep = np.flatnonzero(~np.isnan(start.astype(float)))
        t, x, y, free, taken = start[keep], x0[keep], y0[keep], np.ones(len(keep), bool), 0
        sources, out = np.argsort(rank), []
        for nr in range(rounds):
            reached = []
            for i in sources.tolist():
                if taken * 2 > len(keep):  # what is used goes, so later searches are shorter
                    keep, t, x, y = keep[free], t[free], x[free], y[free]
                    free, taken = np.ones(len(keep), bool), 0
                lo, hi = np.searchsorted(t, [end[i], end[i] + max_gap + 1])
                if lo >= hi:
                    continue
                gap = t[lo:hi] - end[i]
                dx, dy = x1[i] - x[lo:hi], y1[i] - y[lo:hi]
                far = np.sqrt(dx * dx + dy * dy)
                far[~(free[lo:hi] & (gap <= max_gap) & (far <= max_distance) & (keep[lo:hi] != i))] = np.inf
                at = int(far.argmin())  # the first of equal ones has the smallest gap, then id
                if np.isfinite(far[at]):
                    sink = int(keep[lo + at])
                    free[lo + at] = False
                    taken += 1
                    reached.append(sink)
                    out.append((ids[i], ids[sink], nr))
            sources = np.array(sorted(reached, key=rank.__getitem__), np.int64)
            if not len(sources):
                break
        return pd.DataFrame(out, columns=["source", "sink", "round"])

    kind = tracks.schema["track_id"].dataType.simpleString()
    return rows.groupBy(*key).applyInPandas(stitch, f"source {kind}, sink {kind}, round int")


def overlap_pairs(spans: DataFrame, bucket: float) -> DataFrame:
    """Pairs of one identity whose intervals overlap, with seconds and ratio to the shorter one.

    ``spans`` has track_id, identity, start_s, end_s. A pair meets in the bucket of its common start only.
    """
    side = lambda n: spans.select(
        "identity", F.col("track_id").alias(n), F.col("start_s").alias(f"{n}_start"), F.col("end_s").alias(f"{n}_end"),
        _buckets(F.col("start_s"), F.col("end_s"), bucket).alias("bucket"),
    )
    seconds = G.overlap_seconds(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end"))
    shorter = F.least(F.col("a_end") - F.col("a_start"), F.col("b_end") - F.col("b_start"))
    return (
        side("a")
        .join(side("b"), ["identity", "bucket"])
        .where((F.col("a") < F.col("b")) & (F.col("bucket") == F.floor(F.greatest("a_start", "b_start") / bucket)))
        .withColumn("seconds", seconds)
        .where("seconds > 0")
        .select("identity", "a", "b", "seconds", F.when(shorter > 0, F.col("seconds") / shorter).otherwise(F.lit(0.0)).alias("ratio"))
    )


#: Tracks of a key that a task of ``shared_frames`` compares with as many others.
SIDE = 1024


def shared_frames(obs: DataFrame, key: list[str]) -> DataFrame:
    """Pairs of tracks (a < b) of a key that share frames: count and ratio to a's and b's own frames.

    A key's tracks are dealt to blocks of about ``SIDE``, and every two blocks meet in a task that counts the frames of all their pairs at once:
    a pair is a row only in the result, never one for each frame that it shares.
    """
    kinds = {f.name: f.dataType.simpleString() for f in obs.schema}
    own = obs.where(" and ".join(f"{c} is not null" for c in (*key, "track_id", "frame_index"))).groupBy(*key, "track_id").agg(F.collect_set("frame_index").alias("frames"))
    blocks = own.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / SIDE).cast("int").alias("_blocks"))
    place = F.pmod(F.xxhash64("track_id"), F.col("_blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    dealt = own.join(blocks, key).select(*key, "track_id", "frames", place.alias("_at"), other.alias("_with"))
    dealt = dealt.select(*key, F.least("_at", "_with").alias("_i"), F.greatest("_at", "_with").alias("_j"), "_at", "track_id", "frames")

    def count(values: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("track_id")
        sizes = rows["frames"].map(len).to_numpy()
        at = np.unique(np.concatenate(rows["frames"].to_list()), return_inverse=True)[1]
        row, width = np.repeat(np.arange(len(rows)), sizes), int(at.max()) + 1
        one = rows["_at"].to_numpy() == values[-2]
        x, y = (np.flatnonzero(s) for s in (one, one if values[-2] == values[-1] else ~one))
        met = np.zeros((len(x), len(y)), np.float32)  # whole numbers below 2^24
        for k in range(0, width, SIDE):
            seen, some = np.zeros((len(rows), min(SIDE, width - k)), np.float32), (at >= k) & (at < k + SIDE)
            seen[row[some], at[some] - k] = 1
            met += seen[x] @ seen[y].T
        i, j = np.nonzero(met)
        p, q = x[i], y[j]
        # within a block a pair comes both ways
        keep = p < q if values[-2] == values[-1] else np.ones(len(p), bool)
        p, q, shared = p[keep], q[keep], met[i[keep], j[keep]].astype(np.int64)
        low, high, ids = np.minimum(p, q), np.maximum(p, q), rows["track_id"].to_numpy()
        return pd.DataFrame(dict(zip(key, values)) | {"a": ids[low], "b": ids[high], "shared": shared, "ratio_a": shared / sizes[low], "ratio_b": shared / sizes[high]})

    schema = "".join(f"{c} {kinds[c]}, " for c in key) + f"a {kinds['track_id']}, b {kinds['track_id']}, shared long, ratio_a double, ratio_b double"
    return dealt.groupBy(*key, "_i", "_j").applyInPandas(count, schema)


def active_windows(spans: DataFrame, length: float, step: float, *, clip: str | None = None) -> DataFrame:
    """window, start and the tracks active in it; windows are closed, anchored at the first start (of the clip, if its column is given).

    Each track is expanded only to the windows that it touches.
    """
    key = _key(clip)
    ends = (F.min("start_s").alias("origin"), F.max("end_s").alias("stop"))
    anchored = spans.join(spans.groupBy(*key).agg(*ends), key) if key else spans.withColumn("one", F.lit(1)).join(F.broadcast(spans.agg(*ends).withColumn("one", F.lit(1))), "one")  # one row
    first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("start_s") - length - F.col("origin")) / step))
    last = F.least(F.floor((F.col("stop") + 1e-6 - F.col("origin")) / step), F.floor((F.col("end_s") - F.col("origin")) / step))
    begins = F.col("origin") + F.col("window") * F.lit(step)
    return (
        anchored.withColumn("window", F.explode(F.sequence(first, last)))
        .where((F.col("start_s") <= begins + length) & (F.col("end_s") >= begins))
        .select(*key, "window", begins.alias("window_start"), "track_id")
    )


def inherit_labels(losers: DataFrame, winners: DataFrame, candidates: DataFrame, *, max_overlap: float, min_ratio: float) -> DataFrame:
    """For each loser the label of the best winner of its team that stands among its own candidates.

    Losers and winners meet by team and label, where a loser stops at the first winner in order that it may follow; pairs are never written.
    losers: track_id, team, start_s, end_s, best_score; winners: also label, score;
    candidates: track_id, candidate, score (long form).
    """
    c = losers.join(candidates, "track_id").where(F.col("score") >= min_ratio * F.col("best_score")).select(
        "team", F.col("candidate").alias("label"), F.lit(True).alias("loses"), F.col("track_id").alias("id"), F.col("start_s").alias("t0"), F.col("end_s").alias("t1"), F.lit(None).cast("double").alias("score")
    )
    w = winners.select("team", "label", F.lit(False).alias("loses"), F.col("track_id").alias("id"), F.col("start_s").alias("t0"), F.col("end_s").alias("t1"), F.col("score").cast("double").alias("score"))
    kinds = {f.name: f.dataType.simpleString() for f in c.schema}

    def best(part: pd.DataFrame) -> pd.DataFrame:
        """Each loser's first winner that fits, looked for in ever longer pieces of the winners' order."""
        won = part[~part["loses"]].sort_values(["score", "id"], ascending=[False, True])
        lost = part[part["loses"]]
        (li, l0, l1), (wi, w0, w1) = ([df[x].to_numpy() for x in ("id", "t0", "t1")] for df in (lost, won))
        found, left, at, size = np.full(len(lost), -1), np.arange(len(lost)), 0, 64
        while len(left) and at < len(won):
            piece, still = slice(at, at + size), []
            for some in np.array_split(left, -(-len(left) * size // 4_000_000)):
                both = np.minimum(l1[some, None], w1[None, piece]) - np.maximum(l0[some, None], w0[None, piece])
                fits = (np.maximum(0.0, both) <= max_overlap) & (li[some, None] != wi[None, piece])
                hit = fits.any(axis=1)
                found[some[hit]] = at + fits[hit].argmax(axis=1)
                still.append(some[~hit])
            left, at, size = np.concatenate(still), at + size, size * 2
        hit = found >= 0
        return pd.DataFrame({"loser": li[hit], "winner": wi[found[hit]], "label": part["label"].iloc[0], "w_score": won["score"].to_numpy()[found[hit]]})

    order = Window.partitionBy("loser").orderBy(F.desc("w_score"), "winner", "label")
    got = c.unionByName(w).where("team is not null and label is not null").groupBy("team", "label").applyInPandas(best, f"loser {kinds['id']}, winner {kinds['id']}, label {kinds['label']}, w_score double")
    return got.withColumn("rank", F.row_number().over(order)).where("rank = 1").select("loser", "winner", "label")


def stars(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node and root (smallest node reachable) of every node of the edge table (a, b) but the roots.

    Alternating star steps: large-star links each node's larger neighbours to its smallest one,
    small-star its smaller ones. Each round keeps the components and flattens them, so long chains
    take a logarithmic number of rounds. The rounds are checkpointed to the shared folder. A graph
    that has not settled after ``max_rounds`` is an error.
    """
    _ensure_checkpoint_dir(edges)
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct().checkpoint()
    seen = None
    for _ in range(max_rounds):
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        far = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = far.groupBy("u").agg(F.min("v").alias("m"))
        e = far.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct().checkpoint()
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node and root (smallest node reachable) of every node of the edge table (a, b)."""
    e = stars(edges, max_rounds)
    return e.union(e.select(F.col("root").alias("node"), "root").distinct())


def identity_edges(
    tracks: DataFrame, visible: DataFrame, *, least: float = 0.65, max_gap: float = 3.0, max_overlap: float = 1.0, max_distance: float = 250.0, clip: str | None = None
) -> DataFrame:
    """Pairs (a, b) of track ids, a first in the canonical order, that may be one identity.

    The teams do not differ, one starts from ``max_overlap`` before to ``max_gap`` after the other's end, it starts near
    that end if it starts after it, the jerseys do not contradict (they differ, and both are visible for
    the team, or the team lists none), and the embeddings are alike. tracks: track_id, seq (canonical order), team and jersey
    (nullable), start_s, end_s, x0, y0, x1, y1, embedding (of unit length; null: no edge). The times cut the pairs by buckets, of
    a clip if its column is given; ``visible`` may have that column, too.
    """
    from tracklake.operators.registry import PAIRS, cosine_codes, dots

    key = _key(clip)
    of_visible = key if key and clip in visible.columns else []
    reach = max_gap + max_overlap
    of_jersey = visible.groupBy(*of_visible, "jersey").agg(F.collect_set("team").alias("_teams"))
    listed = visible.select(*of_visible, "team").distinct().withColumn("_listed", F.lit(True))
    rows = tracks.where("embedding is not null").join(of_jersey, [*of_visible, "jersey"], "left").join(listed, [*of_visible, "team"], "left")
    cols = ["track_id", "seq", "team", "jersey", "start_s", "end_s", "x0", "y0", "x1", "y1", "embedding", "_teams", F.coalesce("_listed", F.lit(False)).alias("_listed")]
    ends = rows.withColumn("bucket", _buckets(F.col("end_s") - max_overlap, F.col("end_s") + max_gap, reach)).select(*key, "bucket", *cols)
    starts = rows.select(*key, F.floor(F.col("start_s") / reach).alias("bucket"), *cols)
    starts = starts.select(*[F.col(c).alias(f"b_{c}") for c in starts.columns])

    def after(t0, t1, x0, y0, x1, y1, i, j) -> np.ndarray:
        """Whether j starts in time and place where i ends."""
        gap = t0[j] - t1[i]
        return (gap <= max_gap) & (gap >= -max_overlap) & ((gap <= 0) | (np.sqrt((x1[i] - x0[j]) ** 2 + (y1[i] - y0[j]) ** 2) <= max_distance))

    def meet(values: tuple, ended: pd.DataFrame, started: pd.DataFrame) -> pd.DataFrame:
        started = started.rename(columns=lambda c: c[2:])
        if not len(ended) or not len(started):
            return pd.DataFrame()
        both, n = pd.concat([ended.sort_values("end_s"), started.sort_values("start_s")], ignore_index=True), len(ended)
        place = [both[c].to_numpy(float) for c in ("start_s", "end_s", "x0", "y0", "x1", "y1")]
        ids, seq, known = both["track_id"].to_numpy(), both["seq"].to_numpy(), both["_listed"].to_numpy(bool)
        (team, teams), (jersey, jerseys) = (pd.factorize(both[c].astype(object)) for c in ("team", "jersey"))
        code, vectors = cosine_codes(both["embedding"])
        # whether a jersey (the last row: none) is visible for a team
        shown, names = np.zeros((len(jerseys) + 1, len(teams) + 1), bool), {t: k for k, t in enumerate(teams)}
        for k, own in zip(*(x[~both["jersey"].duplicated().to_numpy()] for x in (jersey, both["_teams"].to_numpy()))):
            for t in own if own is not None and k >= 0 else ():
                if t in names:
                    shown[k, names[t]] = True
        out = []
        for t in np.unique(team[:n]).tolist():
            a, b = np.flatnonzero(team[:n] == t), n + np.flatnonzero((team[n:] == t) | (team[n:] < 0) | (t < 0))
            at = place[0][b]
            step = max(1, min(512, PAIRS // max(1, len(b))))
            for k in range(0, len(a), step):
                i = a[k : k + step]
                lo, hi = np.searchsorted(at, [place[1][i[0]] - max_overlap - 1.0, place[1][i[-1]] + max_gap + 1.0])
                if lo == hi:
                    continue
                j = b[lo:hi]
                p, q = np.nonzero(after(*place, i[:, None], j[None, :]) & (ids[i][:, None] != ids[j][None, :]))
                (ui, ri), (uj, rj) = (np.unique(code[v], return_inverse=True) for v in (i, j))
                p, q = (x[dots([vectors[v] for v in ui], [vectors[v] for v in uj])[ri[p], rj[q]] >= least] for x in (p, q))
                p, q = i[p], j[q]
                which = np.where(team[p] >= 0, team[p], team[q])
                is_listed = (which >= 0) & np.where(team[p] >= 0, known[p], known[q])
                differ = (jersey[p] >= 0) & (jersey[q] >= 0) & (jersey[p] != jersey[q])
                fits = ~(differ & (~is_listed | (shown[jersey[p], which] & shown[jersey[q], which])))
                # a pair that fits both ways comes once
                p, q = p[fits], q[fits]
                once = ~after(*place, q, p) | (seq[p] <= seq[q])
                p, q = p[once], q[once]
                first = seq[p] < seq[q]
                out.append((ids[np.where(first, p, q)], ids[np.where(first, q, p)]))
        if not out:
            return pd.DataFrame()
        x, y = (np.concatenate(v) for v in zip(*out))
        return pd.DataFrame(dict(zip(key, values)) | {"a": x, "b": y})

    kinds = {f.name: f.dataType.simpleString() for f in tracks.schema}
    schema = "".join(f"{c} {kinds[c]}, " for c in key) + f"a {kinds['track_id']}, b {kinds['track_id']}"
    return ends.groupBy(*key, "bucket").cogroup(starts.groupBy(*[f"b_{c}" for c in key], "b_bucket")).applyInPandas(meet, schema)


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder, with their lineage cut."""
    _ensure_checkpoint_dir(df)
    return df.checkpoint()


def _ensure_checkpoint_dir(df: DataFrame) -> None:
    import tempfile

    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    configured = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not configured and not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="tracklake-"))


def propagate(members: DataFrame, floor: float = 0.3) -> DataFrame:
    """Fills missing identities of a group from its most confident member; never overwrites.

    members: root, track_id, identity (nullable), confidence. Equal confidence goes to the later track.
    """
    best = members.where("identity is not null").groupBy("root").agg(F.max_by("identity", F.struct("confidence", "track_id")).alias("best"))
    filled = F.col("identity").isNull() & F.col("best").isNotNull()
    return members.join(best, "root", "left").select(
        "root", "track_id", F.coalesce("identity", "best").alias("identity"),
        F.when(filled, F.greatest("confidence", F.lit(floor))).otherwise(F.col("confidence")).alias("confidence"),
    )


def demote_conflicts(claims: DataFrame, max_ratio: float = 0.6) -> DataFrame:
    """Per identity, tracks by score: one that shares more than ``max_ratio`` of its frames with those kept is demoted.

    claims: identity, track_id, score, frames (array<long>). The kept set grows, so it is sequential per identity; Spark sorts the claims, and a
    task reads them as a stream and holds one identity's kept frames, as identities may be many and small.
    """
    kind = claims.schema["identity"].dataType.simpleString()
    order = ["identity", F.when(~F.isnan("score"), F.col("score")).desc_nulls_last(), F.col("track_id").asc_nulls_last()]
    rows = claims.withColumn("score", F.col("score").cast("double")).repartition("identity").sortWithinPartitions(*order)

    def resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: set[int] = set()
        owner, begun = None, False
        for batch in batches:
            identities, out = batch["identity"].tolist(), []
            for identity, frames in zip(identities, batch["frames"].tolist()):
                identity = None if pd.isna(identity) else identity
                if not begun or identity != owner:
                    owner, begun, kept = identity, True, set()
                own = set(frames)
                demoted = bool(kept) and bool(own) and len(own & kept) / len(own) > max_ratio
                if not demoted:
                    kept |= own
                out.append(demoted)
            yield pd.DataFrame({"identity": batch["identity"], "track_id": batch["track_id"], "demoted": out})

    return rows.select("identity", "track_id", "frames").mapInPandas(resolve, f"identity {kind}, track_id long, demoted boolean")


def simple_dedup(labelled: DataFrame) -> DataFrame:
    """One holder per (team, label): the best score, equal scores by track id descending as text; others lose the label."""
    order = Window.partitionBy("team", "label").orderBy(F.desc("score"), F.desc(F.col("track_id").cast("string")))
    rank = F.row_number().over(order)
    return labelled.withColumn("rank", rank).select(
        "track_id", "team", "score", F.when(F.col("rank") == 1, F.col("label")).alias("label")
    )


def strongest_per_frame(rows: DataFrame, tolerance: float = 1e-6, *, clip: str | None = None) -> DataFrame:
    """Rows of (frame, identity), of a clip if its column is given, within the tolerance of the strongest one."""
    top = F.max("strength").over(Window.partitionBy(*_key(clip), "frame", "identity"))
    return rows.withColumn("top", top).where(F.col("strength") >= F.col("top") - tolerance).drop("top")


def gate_by_roster(labelled: DataFrame, valid: DataFrame) -> DataFrame:
    """Labels outside the (team, label) pairs are nulled and flagged; tracks without a team pass."""
    v = valid.select("team", F.col("label").alias("valid_label")).distinct().withColumn("ok", F.lit(True))
    j = labelled.join(v, (labelled.team == v.team) & (labelled.label == v.valid_label), "left").select(labelled["*"], "ok")
    off = F.col("label").isNotNull() & F.col("team").isNotNull() & F.col("ok").isNull()
    return j.select("track_id", "team", F.when(~off, F.col("label")).alias("label"), F.when(off, F.col("label")).alias("off_roster"))

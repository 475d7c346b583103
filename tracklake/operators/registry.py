"""Registries of known identities, reassignment of observations to them, and location memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklake.functions import vector as V
from tracklake.operators.evidence import by_team_and_jersey
from tracklake.operators.groups import whole_groups


def anchored_tracks(tracks: DataFrame, players: DataFrame, visible: DataFrame, *, least: float = 0.4) -> DataFrame:
    """track_id, player, team: resolved with confidence, of the same jersey as read, and on the team's visible list if it has one."""
    p = players.select(F.col("player").alias("resolved"), F.col("team").alias("_team"), F.col("jersey").alias("_jersey"))
    teams = visible.select(F.col("team").alias("_team")).distinct().withColumn("_listed", F.lit(True))
    ok = visible.select(F.col("team").alias("_team"), F.col("jersey").alias("_jersey")).distinct().withColumn("_ok", F.lit(True))
    j = tracks.where(F.col("confidence") >= least).join(p, "resolved").where(F.col("jersey") == F.col("_jersey"))
    j = j.join(teams, "_team", "left").join(ok, ["_team", "_jersey"], "left").where("_listed is null or _ok")
    return j.select("track_id", F.col("resolved").alias("player"), F.col("_team").alias("team"))


def build_registry(anchored: DataFrame, obs: DataFrame, size: int, *, peak: float = 0.85, least_peaks: int = 3, least_rows: int = 5) -> DataFrame:
    """player, team, n and the unit median embedding over its anchored tracks that have enough peak observations.

    obs: track_id, embedding (nullable), peak (its strongest contribution); only those with an embedding count.
    """
    seen = obs.where("embedding is not null")
    good = seen.groupBy("track_id").agg(F.count_if(F.col("peak") >= peak).alias("n_peaks")).where(F.col("n_peaks") >= least_peaks)
    rows = seen.join(good, "track_id").join(anchored, "track_id")
    median = rows.groupBy("player", "team").agg(F.count(F.lit(1)).alias("n"), V.median_vector("embedding", size).alias("m")).where(F.col("n") >= least_rows)
    return median.withColumn("_length", V.norm(F.col("m"))).where("_length > 1e-8").select("player", "team", "n", F.transform("m", lambda x: x / F.col("_length")).alias("embedding"))


def forced_players(reads: DataFrame, players: DataFrame, peak: float = 0.85) -> DataFrame:
    """obs_id and the player that a sure read names: the first candidate in order with a peak whose (team, candidate) is a player.

    reads: obs_id, team, candidate, contribution.
    """
    p = by_team_and_jersey(players).select("team", F.col("jersey").alias("candidate"), "player")
    sure = reads.where(F.col("contribution") >= peak).join(p, ["team", "candidate"])
    return sure.groupBy("obs_id").agg(F.min_by("player", "candidate").alias("player"))


def reassign(obs: DataFrame, forced: DataFrame, registry: DataFrame, *, least: float = 0.6, margin: float = 0.05, clip: str | None = None) -> DataFrame:
    """obs_id and its player: forced by a read, or the nearest registry row of its team that is good, clear and free in the frame.

    obs: obs_id, frame, team (nullable), embedding (nullable). In a frame the observations come in
    the order of their ids, and a player goes to one of them; those taken already are no rival for the margin. With the clip's column
    (in all three tables) ids, frames and players are a clip's own, and the result has it, too.
    """
    key = [clip] if clip else []
    taken = obs.join(forced, [*key, "obs_id"]).select(*key, "frame", "player").distinct()
    free = obs.where("embedding is not null").join(forced.select(*key, "obs_id"), [*key, "obs_id"], "left_anti").select(*key, "frame", "obs_id", "team", "embedding")
    # every frame gets the players that are free in it: no pair becomes a row
    on = key or ["one"]
    frames = free.select(*key, "frame").distinct().withColumn("one", F.lit(1))
    g = registry.withColumn("one", F.lit(1)).select(*on, "player", F.col("team").alias("g_team"), F.col("embedding").alias("g_embedding"))
    players = frames.join(g, on).drop("one").join(taken, [*key, "frame", "player"], "left_anti")
    players = players.select(*[F.col(c).alias(f"g_{c}") for c in (*key, "frame", "player")], "g_team", "g_embedding")
    kind = {f.name: f.dataType.simpleString() for f in [*registry.schema, *obs.schema]}

    def run(values: tuple, rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(known):
            return pd.DataFrame()
        rows, known = rows.sort_values("obs_id", kind="stable"), known.sort_values("g_player", kind="stable")
        n, ids = len(rows), rows["obs_id"].to_numpy()
        team = pd.factorize(pd.concat([rows["team"], known["g_team"]], ignore_index=True).astype(object))[0]
        names, who = np.unique(known["g_player"].to_numpy(), return_inverse=True)
        code, vectors = cosine_codes(pd.concat([rows["embedding"], known["g_embedding"]]))
        (ui, ri), (uj, rj) = (np.unique(c, return_inverse=True) for c in (code[:n], code[n:]))
        near, own, rival = _cosines([vectors[v] for v in ui], [vectors[v] for v in uj])[:, rj], team[:n, None], team[None, n:]
        used, out, at, step = np.zeros(len(names), bool), [], 0, max(1, min(4096, PAIRS // len(known)))
        while at < n and not used.all():
            # the first observation that gets a player; what stands before it gets none, as players only go
            some = slice(at, at + step)
            open_ = ((own[some] < 0) & (rival >= 0) | (own[some] == rival) & (own[some] >= 0)) & ~used[who]
            sim = np.where(open_, near[ri[some]], -np.inf)
            best = sim.argmax(axis=1)
            first = sim[np.arange(len(sim)), best]
            sim[np.arange(len(sim)), best] = -np.inf
            second = sim.max(axis=1)
            won = np.flatnonzero((first >= least) & (first - np.where(second > -np.inf, second, -2.0) >= margin))
            if not len(won):
                at += step
                continue
            k = int(won[0])
            used[who[best[k]]] = True
            out.append((ids[at + k], names[who[best[k]]]))
            # an observation goes to one player
            at = int(np.searchsorted(ids, ids[at + k], side="right"))
        return pd.DataFrame(dict(zip(key, values)) | {"obs_id": [x for x, _ in out], "player": [x for _, x in out]}) if out else pd.DataFrame()

    schema = "".join(f"{c} {kind[c]}, " for c in key) + f"obs_id {kind['obs_id']}, player {kind['player']}"
    near = free.groupBy(*key, "frame").cogroup(players.groupBy(*[f"g_{c}" for c in (*key, "frame")])).applyInPandas(run, schema)
    return forced.select(*key, "obs_id", "player", F.lit(True).alias("forced")).union(near.select(*key, "obs_id", "player", F.lit(False).alias("forced")))


def new_track_ids(assigned: DataFrame, first: int = 10001) -> DataFrame:
    """player and its new track id, numbered in the order of the players."""
    return assigned.select("player").distinct().withColumn("track_id", (F.row_number().over(Window.orderBy("player")) + (first - 1)).cast("string"))  # one row a player


def carried_over(obs: DataFrame, assigned: DataFrame) -> DataFrame:
    """Tracks with an observation that went to no player."""
    return obs.join(assigned.select("obs_id"), "obs_id", "left_anti").select("track_id").distinct()


def split_parents(children: DataFrame, rows: DataFrame, on: list[str]) -> DataFrame:
    """child and the track whose observation equals the child's first one in frame and box; the smallest if there are several."""
    first = children.groupBy("child").agg(F.min_by(F.struct(*on), "seq").alias("f")).select("child", *[F.col(f"f.{c}").alias(c) for c in on])
    return first.join(rows.select("track_id", *on), on, "left").groupBy("child").agg(F.min("track_id").alias("parent"))


def trajectory(anchors: DataFrame) -> DataFrame:
    """key, t, x, y: one point per time, the median of those that share it."""
    mid = lambda c: F.percentile(c, F.lit(0.5)).alias(c)
    return anchors.groupBy("key", "t").agg(mid("x"), mid("y"))


#: So many pairs of observations and places of a frame are compared at a time.
PAIRS = 4_000_000


def cosine_codes(embeddings: pd.Series) -> tuple[np.ndarray, list[np.ndarray]]:
    """The number of each row's vector, and the different vectors."""
    code, kinds = pd.factorize(np.array([np.asarray(v, float).tobytes() for v in embeddings] + [None], object))
    return code[:-1], [np.frombuffer(v) for v in kinds]


def dots(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """``vector.dot`` of all a with all b, summed up in the same order; NaN if the sizes differ."""
    out = np.full((len(a), len(b)), np.nan)
    for n in {len(x) for x in a} & {len(x) for x in b}:
        (ia, ma), (ib, mb) = ((np.array([i for i, x in enumerate(v) if len(x) == n]), np.array([x for x in v if len(x) == n]).reshape(-1, n)) for v in (a, b))
        total = np.zeros((len(ia), len(ib)))
        for k in range(n):
            total += ma[:, k, None] * mb[None, :, k]
        out[np.ix_(ia, ib)] = total
    return out


def _cosines(a: list[np.ndarray], b: list[np.ndarray], least: float = 1e-8) -> np.ndarray:
    """``vector.cosine`` of all a with all b."""
    norm = lambda v: np.sqrt(np.array([np.cumsum(x * x)[-1] if len(x) else 0.0 for x in v]))
    size, product = norm(a)[:, None] * norm(b)[None, :], dots(a, b)
    usable = (size > least) & ~np.isnan(product)
    return np.where(usable, product / np.where(usable, size, 1.0), 0.0)


class _Frame:
    """Observations and expected places of one frame; scores come for some observations and the places in their reach.

    ``similar`` holds the cosines of all pairs of the vectors whose numbers the rows have in ``code``.
    """

    def __init__(self, o: pd.DataFrame, e: pd.DataFrame, similar: np.ndarray, reach: float, least_similarity: float, least: float):
        self.reach, self.least_similarity, self.least, self.similar = reach, least_similarity, least, similar
        o, e = (df[df["x"].notna() & df["y"].notna()] for df in (o, e))
        self.o, self.e = o["id"].to_numpy(), e["id"].to_numpy()
        team = pd.factorize(pd.concat([o["team"], e["team"]], ignore_index=True).astype(object))[0]
        n = len(o)
        self.ox, self.oy, self.ot, self.ov = o["x"].to_numpy(float), o["y"].to_numpy(float), team[:n], o["code"].to_numpy(int)
        self.ex, self.ey, self.et, self.ev = e["x"].to_numpy(float), e["y"].to_numpy(float), team[n:], e["code"].to_numpy(int)
        self.top = float(similar.max()) if similar.size else 1.0

    def within(self, least: float) -> float:
        """Pairs that are farther apart have a score below ``least``."""
        if not np.isfinite(least):
            return self.reach
        return min(self.reach, self.reach * (2 * (0.5 + (self.top + 1) / 4 - least) + 1e-6))

    def scores(self, rows: np.ndarray, columns: np.ndarray, within: float, least: float = -np.inf) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Place of the observation, of the expected place, and score, of every pair of the given ones that counts and is not farther apart than ``within``.

        Observations of a strip of x, in the order of y, meet the places that they can reach, a bounded number of pairs at a time. Where only scores from
        ``least`` on are asked for and few vectors are alike enough for them, observations meet the places by their vectors instead.
        """
        if not len(rows) or not len(columns) or within < 0:
            return
        if np.isfinite(least) and isinstance(self.similar, np.ndarray):
            alike = self.similar >= max(self.least_similarity, 4 * least - 3 - 1e-6)
            n, m = (np.bincount(c, minlength=len(alike)) for c in (self.ov[rows], self.ev[columns]))
            if n @ (alike @ m) < len(rows) * len(columns) / 32:
                yield from self._by_vector(rows, columns, within, alike)
                return
        far = within * 1.001  # a margin, as the distance is rounded
        x = self.ox[rows]
        strip = max(within / 2, (x.max() - x.min()) * 256 / len(rows), 1e-9)
        strips = np.floor((x - x.min()) / strip)
        by_x = columns[np.argsort(self.ex[columns], kind="stable")]
        rows = rows[np.lexsort((self.oy[rows], strips))]
        strips = np.sort(strips)
        for first, end in zip(*(np.searchsorted(strips, np.unique(strips), side=s) for s in ("left", "right"))):
            own = rows[first:end]
            lo, hi = np.searchsorted(self.ex[by_x], [self.ox[own].min() - far, self.ox[own].max() + far])
            near = by_x[lo:hi]
            near = near[np.argsort(self.ey[near], kind="stable")]
            at = 0
            while at < len(own) and len(near):
                i = own[at : at + 512]
                lo, hi = np.searchsorted(self.ey[near], [self.oy[i[0]] - far, self.oy[i[-1]] + far])
                i = i[: max(1, PAIRS // max(1, hi - lo))]
                at += len(i)
                for k in range(lo, hi, PAIRS):
                    yield from self._some(i, near[k : min(hi, k + PAIRS)], within)

    def _by_vector(self, rows: np.ndarray, columns: np.ndarray, within: float, alike: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        columns = columns[np.argsort(self.ev[columns], kind="stable")]
        m = np.bincount(self.ev[columns], minlength=len(alike))
        alike = alike & (m > 0)
        u, v = np.nonzero(alike)
        per, weight = np.bincount(u, minlength=len(alike)), (alike @ m)[self.ov[rows]]
        rows, weight = rows[weight > 0], weight[weight > 0]
        places = lambda first, n: np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)
        for part in np.split(rows, np.flatnonzero(np.diff(np.cumsum(weight) // PAIRS)) + 1) if len(rows) else []:
            n = per[self.ov[part]]
            code = v[places((np.cumsum(per) - per)[self.ov[part]], n)]
            k = m[code]
            i, j = np.repeat(np.repeat(part, n), k), columns[places((np.cumsum(m) - m)[code], k)]
            dx, dy = self.ox[i] - self.ex[j], self.oy[i] - self.ey[j]
            gone = np.sqrt(dx * dx + dy * dy)
            ok = (gone <= within) & ((self.ot[i] < 0) | (self.et[j] < 0) | (self.ot[i] == self.et[j]))
            yield self._counted(i[ok], j[ok], gone[ok])

    def _some(self, i: np.ndarray, j: np.ndarray, within: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        dx, dy = self.ox[i, None] - self.ex[None, j], self.oy[i, None] - self.ey[None, j]
        gone = np.sqrt(dx * dx + dy * dy)
        ti, tj = self.ot[i, None], self.et[None, j]
        at, to = np.nonzero((gone <= within) & ((ti < 0) | (tj < 0) | (ti == tj)))
        yield self._counted(i[at], j[to], gone[at, to])

    def _counted(self, i: np.ndarray, j: np.ndarray, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sim = self.similar[self.ov[i], self.ev[j]]
        score = 0.5 * np.maximum(0.0, 1 - gone / self.reach) + 0.5 * (sim + 1) / 2
        ok = (sim >= self.least_similarity) & (score >= self.least)
        return i[ok], j[ok], score[ok]


#: Tables of at most so many vectors go to the tasks whole.
VECTORS = 2_000


def _by_frame(obs: DataFrame, expected: DataFrame, key: list[str], work: Callable[[_Frame], Iterator[dict]], more: str, given: tuple[float, float, float], vectors: DataFrame | None) -> DataFrame:
    """The key, obs_id, player and ``more`` that ``work`` makes of the rows of every frame that have an embedding.

    Spark sorts both sides by frame, and a task reads them as a stream: it holds a batch and one frame's rows. Rows carry the number of their vector if the
    table of vectors is small, else the vector.
    """
    known = None
    if vectors is not None:
        held = vectors.where("embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
        if held.count() <= VECTORS:
            known = held.toPandas()  # counted
            names = held.sparkSession.createDataFrame([(int(v), k) for k, v in enumerate(known["vec_id"])], "vec_id long, code int")
            obs, expected = (df.join(F.broadcast(names), "vec_id") for df in (obs, expected))
        else:
            obs, expected = (df.join(held, "vec_id") for df in (obs, expected))
    cosines: list[np.ndarray] = []
    kinds = {f.name: f.dataType.simpleString() for f in [*expected.schema, *obs.schema]}
    same = obs.schema["obs_id"].dataType == expected.schema["player"].dataType
    vector = [F.col("code")] if known is not None else [F.col("embedding")]

    def side(df: DataFrame, i: str, own: int) -> DataFrame:
        df = df if known is not None else df.where("embedding is not null")
        return df.select(*key, F.lit(own).alias("side"), (F.col(i) if same else F.col(i).cast("string")).alias("id"), "team", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), *vector)

    rows = side(obs, "obs_id", 0).unionByName(side(expected, "player", 1)).repartition(*key).sortWithinPartitions(*key, "side")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if known is not None and not cosines:
            table = [np.asarray(v, float) for v in known["embedding"]]
            cosines.append(_cosines(table, table))
        for part, cuts in whole_groups(batches, key):
            for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(part)]):
                frame = part.iloc[lo:hi]
                split = int((frame["side"] == 0).sum())
                if not 0 < split < len(frame):
                    continue
                if known is not None:
                    similar = cosines[0]
                else:
                    code, kept = cosine_codes(frame["embedding"])
                    frame, similar = frame.assign(code=code), _cosines(kept, kept) if len(kept) <= VECTORS else _Cosines(kept)
                f = _Frame(frame.iloc[:split], frame.iloc[split:], similar, *given)
                values = {c: frame[c].iloc[0] for c in key}
                for found in work(f):
                    if len(found["obs_id"]):
                        yield pd.DataFrame(values | found)

    text = (kinds["obs_id"], kinds["player"]) if same else ("string", "string")
    got = rows.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in key) + f", obs_id {text[0]}, player {text[1]}{more}")
    return got if same else got.withColumns({c: F.col(c).cast(kinds[c]) for c in ("obs_id", "player")})


class _Cosines:
    """The cosines of the pairs that are asked for, where there are too many vectors for a table of all."""

    size, top = 1, 1.0

    def __init__(self, vectors: list[np.ndarray]):
        self.vectors = vectors

    def max(self) -> float:
        return 1.0 + 1e-9

    def __getitem__(self, pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        a, b = pairs
        (ui, ri), (uj, rj) = (np.unique(v, return_inverse=True) for v in (a, b))
        out = np.empty(len(a))
        for k in range(0, len(ui), VECTORS):
            for m in range(0, len(uj), VECTORS):
                some = (ri >= k) & (ri < k + VECTORS) & (rj >= m) & (rj < m + VECTORS)
                if some.any():
                    out[some] = _cosines([self.vectors[v] for v in ui[k : k + VECTORS]], [self.vectors[v] for v in uj[m : m + VECTORS]])[ri[some] - k, rj[some] - m]
        return out


def location_scores(
    obs: DataFrame, expected: DataFrame, *, reach: float = 150.0, least_similarity: float = 0.4, least: float = 0.5, clip: str | None = None, vectors: DataFrame | None = None
) -> DataFrame:
    """(clip,) frame, obs_id, player, score of observations near where a player of their team is expected and alike.

    obs: frame, obs_id, team (nullable), x, y, embedding; expected: frame, player, team, x, y, embedding. With ``vectors`` (vec_id, embedding) both have vec_id
    instead of the embedding, and a vector that many rows share is no part of them.
    The score is half place, half (cosine + 1) / 2. A task holds a frame's rows and compares a few observations at a time with the places in
    reach; only the pairs that count leave it, a few at a time.
    """
    key = [*([clip] if clip else []), "frame"]

    def work(f: _Frame) -> Iterator[dict]:
        for i, j, score in f.scores(np.arange(len(f.o)), np.arange(len(f.e)), reach):
            yield {"obs_id": f.o[i], "player": f.e[j], "score": score}

    return _by_frame(obs, expected, key, work, ", score double", (reach, least_similarity, least), vectors)


#: Scores from which the bands of a large frame begin; the higher a band, the nearer are its pairs.
BANDS = (0.98, 0.96, 0.93, 0.9, 0.87, 0.84, 0.8, 0.76, 0.72, 0.68, 0.64, 0.6, 0.55, 0.5)


def locate_observations(
    obs: DataFrame, expected: DataFrame, locked: DataFrame, *, reach: float = 150.0, least_similarity: float = 0.4, least: float = 0.5, clip: str | None = None, most: int = 4_000_000,
    vectors: DataFrame | None = None,
) -> DataFrame:
    """``assign_locations`` of ``location_scores``, rounded to nine digits, without making the pairs rows.

    A frame's pairs are taken in bands of falling scores; a band looks only at observations and players that are still free, and at places as near as its scores
    ask for. A band of more than ``most`` pairs is cut in two.
    """
    key = [*([clip] if clip else []), "frame"]
    kept = obs.join(locked, [*key[:-1], "track_id"]).select(*key, "obs_id", "player")
    free_obs = obs.join(kept.select(*key[:-1], "obs_id"), [*key[:-1], "obs_id"], "left_anti")
    free_places = expected.join(kept.select(*key, "player").distinct(), [*key, "player"], "left_anti")

    def work(f: _Frame) -> Iterator[dict]:
        (same, which), (players, who) = (np.unique(v, return_inverse=True) for v in (f.o, f.e))
        used, taken, out = np.zeros(len(same), bool), np.zeros(len(players), bool), []
        edges = [b for b in BANDS if b > least] if len(which) * len(who) > min(most, PAIRS) else []
        todo = [*zip([np.inf, *edges], [*edges, -np.inf])][::-1]
        while todo:
            high, low = todo.pop()
            band, n = [], 0
            for i, j, score in f.scores(np.flatnonzero(~used[which]), np.flatnonzero(~taken[who]), f.within(low), low):
                score = np.sign(score) * np.floor(np.abs(score) * 1e9 + 0.5) / 1e9
                ok = (score < high) & (score >= low)
                band.append((which[i[ok]], who[j[ok]], score[ok]))
                n += int(ok.sum())
                if n > most and min(high, 1.0) - max(low, least) > 1e-8:
                    break
            else:
                if not n:
                    continue
                i, j, score = (np.concatenate(x) for x in zip(*band))
                order = np.lexsort((j, i, -score))
                for k in range(0, len(order), 4096):
                    some = order[k : k + 4096]
                    some = some[~used[i[some]] & ~taken[j[some]]]
                    for x, y in zip(i[some].tolist(), j[some].tolist()):
                        if not used[x] and not taken[y]:
                            used[x] = taken[y] = True
                            out.append((x, y))
                continue
            middle = (min(high, 1.0) + max(low, least)) / 2
            todo += [(middle, low), (high, middle)]
        at = np.array(out, np.int64).reshape(-1, 2)
        yield {"obs_id": same[at[:, 0]], "player": players[at[:, 1]]}

    found = _by_frame(free_obs, free_places, key, work, "", (reach, least_similarity, least), vectors)
    return kept.select(*key[:-1], "obs_id", "player", F.lit(True).alias("locked")).union(found.select(*key[:-1], "obs_id", "player", F.lit(False)))


def assign_locations(obs: DataFrame, locked: DataFrame, scored: DataFrame, *, clip: str | None = None) -> DataFrame:
    """(clip,) obs_id and player: observations of firmly identified tracks keep theirs; the others are matched greedily to players free in the frame.

    locked: (clip,) track_id, player.
    """
    key = [clip] if clip else []
    from tracklake.operators.matching import locate_players

    kept = obs.join(locked, [*key, "track_id"]).select(*key, "frame", "obs_id", "player")
    free = scored.join(kept.select(*key, "obs_id"), [*key, "obs_id"], "left_anti").join(kept.select(*key, "frame", "player").distinct(), [*key, "frame", "player"], "left_anti")
    found = locate_players(free.select(*key, "frame", "obs_id", "player", "score"), clip=clip)
    return kept.select(*key, "obs_id", "player", F.lit(True).alias("locked")).union(found.select(*key, "obs_id", "player", F.lit(False)))

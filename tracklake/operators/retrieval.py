"""Embedding retrieval: similarity search, average precision, centroids, weight sweeps.

``appearance`` has vec_id, frame, identity, embedding. Searches compare a stated query set
with all rows in blocks of both: a task holds one block of each as matrices, and only its best
rows leave it. Metrics that need the rank of every positive count, block by block, the rows above it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklake.functions import vector as V
from tracklake.operators.ranking import next_value


#: So many queries of a block are compared with its gallery at a time, which bounds a task's matrices.
SLICE = 128


def unit(appearance: DataFrame) -> DataFrame:
    return appearance.withColumn("n", V.norm(F.col("embedding"))).withColumn(
        "embedding", F.transform("embedding", lambda x: x / F.greatest(F.col("n"), F.lit(1e-12)))
    ).drop("n")


def in_blocks(
    queries: DataFrame, gallery: DataFrame, work: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, *, q_block: int = 2048, g_block: int = 8192
) -> DataFrame:
    """``work`` on every block of queries with every block of the gallery; both have vec_id, and a task holds one block of each."""
    nq, ng = -(-queries.count() // q_block) or 1, -(-gallery.count() // g_block) or 1
    slot = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.withColumn("_q", slot(nq)).withColumn("_g", every(ng))
    g = gallery.withColumn("_g", slot(ng)).withColumn("_q", every(nq))
    # names of their own, as both sides may come from one table
    names = {f"b_{c}": c for c in g.columns}
    g = g.select(*[F.col(c).alias(n) for n, c in names.items()])
    return q.groupBy("_q", "_g").cogroup(g.groupBy("b__q", "b__g")).applyInPandas(lambda a, b: work(a, b.rename(columns=names)), schema)


def _matrix(rows: pd.Series) -> np.ndarray:
    m = np.array(rows.tolist(), float).reshape(len(rows), -1)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _other_frames(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
    return a["frame"].to_numpy()[:, None] != b["frame"].to_numpy()[None, :]


def top_k(queries: DataFrame, gallery: DataFrame, k: int, *, team: str | None = None) -> DataFrame:
    """q_id, q_identity, vec_id, identity, similarity, rank: the k most similar rows of other frames; equal ones by vec_id.

    With a ``team`` column rows of another known team are no candidates; a query or row without a team fits all.
    A block gives its k best rows of each query, and these meet in the end.
    """
    cols = ["vec_id", "frame", "identity", "embedding", *([team] if team else [])]
    kinds = {f.name: f.dataType.simpleString() for f in gallery.select(*cols).schema}

    def work(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            b = b.sort_values("vec_id")
            sims = np.round(_matrix(a["embedding"]) @ _matrix(b["embedding"]).T, 9)
            fits = _other_frames(a, b)
            if team:
                ta, tb = a[team].to_numpy()[:, None], b[team].to_numpy()[None, :]
                fits &= (ta == tb) | pd.isna(ta) | pd.isna(tb)
            sims[~fits] = -np.inf
            ids, labels = b["vec_id"].to_numpy(), b["identity"].to_numpy()
            for q_id, identity, row in zip(a["vec_id"], a["identity"], sims):
                some = np.flatnonzero(row >= np.partition(row, -k)[-k]) if len(row) > k else np.arange(len(row))
                best = some[np.argsort(-row[some], kind="stable")][:k]
                out += [(q_id, identity, ids[j], labels[j], row[j]) for j in best.tolist() if np.isfinite(row[j])]
        return pd.DataFrame(out, columns=["q_id", "q_identity", "vec_id", "identity", "similarity"])

    schema = f"q_id {kinds['vec_id']}, q_identity {kinds['identity']}, vec_id {kinds['vec_id']}, identity {kinds['identity']}, similarity double"
    found = in_blocks(queries.select(*cols), gallery.select(*cols), work, schema)
    order = Window.partitionBy("q_id").orderBy(F.desc("similarity"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class _Ranks:
    """A block of queries and the ranks of their positives.

    A positive is one number, its similarity in units of the ninth digit and then its place among the ids of the identity, and a count: twelve bytes.
    """

    def __init__(self, rows: pd.DataFrame):
        self.ids, self.frames, self.labels, self.m = rows["vec_id"].to_numpy(), rows["frame"].to_numpy(), rows["identity"].to_numpy(), _vectors(rows)
        self.found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in self.ids]
        self.met: dict[object, list[np.ndarray]] = {}
        self.names: dict[object, np.ndarray] = {}
        self.keys: list[np.ndarray] | None = None
        self.steps: list[np.ndarray] = []

    def _sims(self, rows: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Place, similarities and which of them count, of a few queries at a time, which bounds the matrices; rows of a query's own frame do not count."""
        other, frames = _vectors(rows).T, rows["frame"].to_numpy()
        for k in range(0, len(self.ids), SLICE):
            sims = np.rint((self.m[k : k + SLICE] @ other) * 1e9)
            fits = (self.frames[k : k + SLICE, None] != frames[None, :]) & ~np.isnan(sims)
            for i, (row, ok) in enumerate(zip(np.where(fits, sims, 0).astype(np.int32), fits), k):
                yield i, row, ok

    def meet(self, rows: pd.DataFrame) -> None:
        """Rows that have identities of the block."""
        ids, labels = rows["vec_id"].to_numpy(), rows["identity"].to_numpy()
        place = np.zeros(len(rows), np.int32)
        for label in set(labels.tolist()):
            own, parts = np.flatnonzero(labels == label), self.met.setdefault(label, [])
            place[own] = sum(map(len, parts)) + np.arange(len(own))
            parts.append(ids[own])
        for k, row, fits in self._sims(rows):
            own = (labels == self.labels[k]) & fits
            self.found[k].append((row[own], place[own]))

    def _start(self) -> None:
        """Positives by similarity, equal ones from the last id on; ``steps`` counts the rows by the number of positives that they stand above."""
        self.keys, place = [], {}
        for label, parts in self.met.items():
            ids = np.concatenate(parts)
            self.names[label] = np.sort(ids)
            place[label] = np.searchsorted(self.names[label], ids)
        self.met = {}
        for k, label in enumerate(self.labels.tolist()):
            parts, self.found[k] = self.found[k], []
            sims, at = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int32), np.zeros(0, np.int32))
            n = len(self.names.get(label, ()))
            self.keys.append(np.sort(sims.astype(np.int64) * (n + 1) + n - place[label][at]) if len(sims) else np.zeros(0, np.int64))
            self.steps.append(np.zeros(len(sims) + 1, np.int32))

    def count(self, rows: pd.DataFrame) -> None:
        """Any rows of the gallery, each once."""
        if self.keys is None:
            self._start()
        ids = rows["vec_id"].to_numpy()
        # among equal ones a row stands above those with a larger id
        below = {label: len(names) - np.searchsorted(names, ids, "right") for label, names in self.names.items()}
        for k, row, fits in self._sims(rows):
            keys = self.keys[k]
            if len(keys):
                label = self.labels[k]
                own = row.astype(np.int64) * (len(self.names[label]) + 1) + below[label]
                self.steps[k] += np.bincount(np.searchsorted(keys, own[fits], "right"), minlength=len(keys) + 1).astype(np.int32)

    def ranks(self) -> Iterator[tuple[object, np.ndarray, np.ndarray]]:
        """Query, its positives and their ranks, best first."""
        if self.keys is None:
            self._start()
        for q_id, label, keys, step in zip(self.ids, self.labels.tolist(), self.keys, self.steps):
            names = self.names.get(label, self.ids[:0])
            yield q_id, names[len(names) - np.mod(keys[::-1], len(names) + 1)], 1 + np.cumsum(step[::-1], dtype=np.int64)[:-1]


def _vectors(rows: pd.DataFrame) -> np.ndarray:
    return _matrix(rows["e64"].where(rows["e64"].notna(), rows["e32"]))


#: So many positives of a block's queries are held by a task: about twelve bytes each.
POSITIVES = 24_000_000


def _ranked(queries: DataFrame, gallery: DataFrame, out: Callable[[_Ranks], pd.DataFrame], schema: str, q_block: int, most: int = POSITIVES) -> DataFrame:
    """``out`` of every block of queries after all of the gallery has passed it.

    Queries are dealt by identity to blocks of about ``q_block`` queries or ``most`` positives, whichever is less. A task gets, in order, a block's queries, the rows
    of their identities and all rows, batch by batch; it holds the queries, the similarities of their positives and one batch. As all blocks
    get the gallery, its vectors are exchanged as floats where that loses nothing.
    """
    exact = F.coalesce(F.forall("embedding", lambda x: x == x.cast("float").cast("double")), F.lit(False))
    packed = [F.when(exact, F.col("embedding").cast("array<float>")).alias("e32"), F.when(~exact, F.col("embedding").cast("array<double>")).alias("e64")]
    cols = ["vec_id", "frame", "identity", "e32", "e64"]
    q, g = (df.select("vec_id", "frame", "identity", *packed) for df in (queries.where("identity is not null"), gallery))
    positives = gallery.where("identity is not null").groupBy("identity").agg(F.count(F.lit(1)).alias("_p"))
    weight = F.col("n") * F.greatest(F.coalesce("_p", F.lit(0)), F.lit(-(-most // q_block)))
    sizes = q.groupBy("identity").agg(F.count(F.lit(1)).alias("n")).join(positives, "identity", "left").select("identity", weight.alias("w"))
    total = sizes.agg(F.sum("w")).first()[0] or 0
    n = -(-total // most) or 1
    # the blocks of an identity follow each other, so that a block has few identities
    start = F.coalesce(F.sum("w").over(Window.orderBy("identity").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row an identity
    share = float(n) / max(total, 1)
    first = sizes.select("identity", F.least(F.lit(n - 1), F.floor(start * share)).cast("int").alias("_first"), F.least(F.lit(n), F.ceil((start + F.col("w")) * share)).cast("int").alias("_end"))
    first = first.withColumn("_n", F.greatest(F.lit(1), F.col("_end") - F.col("_first")))
    mine = q.join(first, "identity").withColumn("_q", (F.col("_first") + F.pmod(F.xxhash64("vec_id"), F.col("_n"))).cast("int"))
    every = lambda low, high: F.explode(F.sequence(low, high))
    met = g.join(first, "identity").withColumn("_q", every(F.col("_first"), F.col("_first") + F.col("_n") - 1))
    seen = g.withColumn("_q", every(F.lit(0), F.lit(n - 1)))
    parts = [df.select(F.col("_q").cast("int").alias("_q"), F.lit(k).alias("_pass"), *cols) for k, df in enumerate((mine, met, seen))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).repartition(n, "_q").sortWithinPartitions("_q", "_pass")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, held, asked = None, None, []

        def begin() -> None:
            nonlocal held, asked
            held, asked = _Ranks(pd.concat(asked, ignore_index=True)), []

        for batch in batches:
            for (at, nr), part in batch.groupby(["_q", "_pass"]):
                if at != block:
                    if held is not None or asked:
                        if held is None:
                            begin()
                        yield out(held)
                    block, held, asked = at, None, []
                if nr == 0:
                    asked.append(part)
                    continue
                if held is None and asked:
                    begin()
                if held is not None:
                    (held.meet if nr == 1 else held.count)(part)
        if held is not None:
            yield out(held)

    return rows.mapInPandas(run, schema)


def positive_ranks(queries: DataFrame, gallery: DataFrame, *, chunk: int = 1024, most: int = POSITIVES) -> DataFrame:
    """q_id, vec_id and rank of every positive: the rows of a query's identity in other frames, among all rows of other frames by similarity, then vec_id."""
    kind = gallery.schema["vec_id"].dataType.simpleString()

    def out(block: _Ranks) -> pd.DataFrame:
        return pd.concat([pd.DataFrame({"q_id": q, "vec_id": ids, "rank": ranks}) for q, ids, ranks in block.ranks()], ignore_index=True)

    return _ranked(queries, gallery, out, f"q_id {kind}, vec_id {kind}, rank long", chunk, most)


def retrieval_metrics(queries: DataFrame, gallery: DataFrame, *, chunk: int = 1024, most: int = POSITIVES) -> DataFrame:
    """queries, rank1, rank5 and mean average precision over queries with a positive; a query's precision is averaged in its task."""
    kind = gallery.schema["vec_id"].dataType.simpleString()

    def out(block: _Ranks) -> pd.DataFrame:
        got = [(q, float(np.mean(np.arange(1, len(r) + 1) / r)), int(r[0])) for q, _, r in block.ranks() if len(r)]
        return pd.DataFrame(got, columns=["q_id", "ap", "best"])

    per = _ranked(queries, gallery, out, f"q_id {kind}, ap double, best long", chunk, most)
    share = lambda k: F.round(F.avg((F.col("best") <= k).cast("int")), 6)
    return per.agg(F.count(F.lit(1)).alias("queries"), share(1).alias("rank1"), share(5).alias("rank5"), F.round(F.avg("ap"), 6).alias("map"))


def half_centroids(appearance: DataFrame, size: int, least: int = 6) -> DataFrame:
    """Per identity the mean vector of its even (gallery) and odd (query) rows in time order."""
    order = Window.partitionBy("identity").orderBy("frame", "vec_id")
    rows = appearance.withColumn("nr", F.row_number().over(order) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("identity")))
    return (
        rows.where(F.col("n") >= least)
        .groupBy("identity", F.pmod("nr", F.lit(2)).alias("half"))
        .agg(V.mean_vector("embedding", size).alias("embedding"))
    )


def temporal_split(appearance: DataFrame, size: int) -> DataFrame:
    """rank-1 accuracy and mean reciprocal rank of odd-half centroids against even-half ones."""
    c = half_centroids(appearance, size)
    g = c.where("half = 0").select(F.col("identity").alias("vec_id"), "identity", F.lit(0).alias("frame"), "embedding")
    q = c.where("half = 1").select(F.col("identity").alias("vec_id"), "identity", F.lit(1).alias("frame"), "embedding")
    hits = positive_ranks(q, g)
    return hits.agg(
        F.count(F.lit(1)).alias("queries"), F.round(F.avg((F.col("rank") == 1).cast("int")), 6).alias("rank1"), F.round(F.avg(1 / F.col("rank")), 6).alias("mrr")
    )


def centroid_medians(appearance: DataFrame, size: int, least: int = 5) -> DataFrame:
    """identity, place, value: component-wise median of identities with enough rows."""
    return (
        appearance.groupBy("identity")
        .agg(F.count(F.lit(1)).alias("n"), V.median_vector("embedding", size).alias("m"))
        .where(F.col("n") >= least)
        .select("identity", F.posexplode("m").alias("place", "value"))
    )


def nearest_with_margin(queries: DataFrame, registry: DataFrame, least: float, margin: float, *, team: str | None = None) -> DataFrame:
    """q_id, vec_id, similarity: the best registry row (of the team) if it is good and clear enough; a missing second counts as -2."""
    two = top_k(queries, registry, 2, team=team)
    second = F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("similarity"))), F.lit(-2.0))
    best = F.max(F.when(F.col("rank") == 1, F.struct("vec_id", "similarity")))
    return (
        two.groupBy("q_id").agg(best.alias("b"), second.alias("second")).select("q_id", "b.vec_id", "b.similarity", "second")
        .where((F.col("similarity") >= least) & (F.col("similarity") - F.col("second") >= margin))
        .select("q_id", "vec_id", "similarity")
    )


def fusion_sweep(queries: DataFrame, gallery: DataFrame, weights: list[float]) -> DataFrame:
    """weight and rank1 of (1 - weight) * similarity of ``embedding`` + weight * that of ``other``, for each weight."""
    cols = ["vec_id", "frame", "identity", "embedding", "other"]
    kinds = {f.name: f.dataType.simpleString() for f in gallery.select(*cols).schema}

    def work(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            b = b.sort_values("vec_id")
            sides = [(_matrix(a[c]), _matrix(b[c]).T) for c in ("embedding", "other")]
            ids, labels = b["vec_id"].to_numpy(), b["identity"].to_numpy()
            for k in range(0, len(a), SLICE):
                part = a.iloc[k : k + SLICE]
                one, two = (np.round(x[k : k + SLICE] @ y, 9) for x, y in sides)
                fits = _other_frames(part, b)
                for w in weights:
                    fused = np.where(fits, np.round((1 - w) * one + w * two, 9), -np.inf)
                    best = fused.argmax(axis=1)
                    top = fused[np.arange(len(best)), best]
                    out += [(w, q, i, ids[j], labels[j], v) for q, i, j, v in zip(part["vec_id"], part["identity"], best.tolist(), top.tolist()) if np.isfinite(v)]
        return pd.DataFrame(out, columns=["weight", "q_id", "q_identity", "vec_id", "found", "fused"])

    schema = f"weight double, q_id {kinds['vec_id']}, q_identity {kinds['identity']}, vec_id {kinds['vec_id']}, found {kinds['identity']}, fused double"
    blocks = in_blocks(queries.select(*cols), gallery.select(*cols), work, schema)
    top = blocks.groupBy("weight", "q_id", "q_identity").agg(F.max_by("found", F.struct("fused", -F.col("vec_id"))).alias("found"))
    return top.groupBy("weight").agg(F.round(F.avg((F.col("found") == F.col("q_identity")).cast("int")), 6).alias("rank1"))


def best_weight(sweep: DataFrame, metric: str = "rank1") -> DataFrame:
    """The weight with the largest metric; of equal ones the smallest."""
    return sweep.orderBy(F.desc(metric), "weight").limit(1)


def adjacent_frames(appearance: DataFrame) -> DataFrame:
    """frame and the next distinct frame."""
    return next_value(appearance.select("frame").distinct(), "frame", 4096, "next_frame").where("next_frame is not null")

"""Registries, clusters and kits: canonical labels, merges, two-means and window votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklake.functions import color as C
from tracklake.functions import vector as V


def weighted_centroids(rows: DataFrame, key: str, size: int, floor: float = 0.01, unit: bool = True) -> DataFrame:
    """Per key the weighted mean of its embeddings (weight max(floor, weight)), of unit length if asked."""
    w = F.greatest(F.lit(floor), F.col("weight"))
    mean = rows.groupBy(key).agg(V.weighted_mean_vector("embedding", w, size).alias("embedding"), F.count(F.lit(1)).alias("n"))
    if not unit:
        return mean
    return mean.withColumn("length", V.norm(F.col("embedding"))).select(
        key, "n", F.transform("embedding", lambda x: x / F.greatest(F.col("length"), F.lit(1e-12))).alias("embedding")
    )


def window_votes(assigned: DataFrame) -> DataFrame:
    """The label of every track by votes prob * max(overlap, 0.05) over its windows; ties to the smaller label."""
    votes = assigned.groupBy("track_id", "label").agg(F.sum(F.col("prob") * F.greatest(F.lit(0.05), F.col("overlap"))).alias("vote"))
    order = Window.partitionBy("track_id").orderBy(F.desc("vote"), "label")
    return votes.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def canonical_labels(members: DataFrame, valid: DataFrame | None = None) -> DataFrame:
    """Per cluster the label with the highest summed score that its team's roster has.

    members: cluster_id, team, label, score; the team is that of the best member. Without
    a valid label the cluster has none.
    """
    team = members.groupBy("cluster_id").agg(F.max_by("team", F.struct("score", -F.col("member"))).alias("team"))
    sums = members.groupBy("cluster_id", "label").agg(F.sum("score").alias("total")).join(team, "cluster_id")
    if valid is not None:
        sums = sums.join(valid.select("team", "label").distinct(), ["team", "label"], "left_semi")
    order = Window.partitionBy("cluster_id").orderBy(F.desc("total"), "label")
    best = sums.withColumn("rank", F.row_number().over(order)).where("rank = 1").select("cluster_id", "label", "total")
    return team.join(best, "cluster_id", "left")


def two_means(points: DataFrame, rounds: int = 12) -> DataFrame:
    """Two-means of (id, r, g, b): seeds are the points with the least and greatest r (then id); cluster 0 or 1.

    The centres are two rows that every round replaces; each round is one aggregation over the points, which are written once.
    """
    from tracklake.operators.linking import checkpointed

    points = checkpointed(points)
    order = F.struct("r", "id")
    at = F.struct("r", "g", "b")
    first = points.agg(F.min_by(at, order).alias("c0"), F.max_by(at, order).alias("c1")).first()
    centres = [tuple(first["c0"]), tuple(first["c1"])] if first["c0"] is not None else [(0.0,) * 3] * 2

    def gone(c):
        return sum((F.col(n) - F.lit(float(v))) * (F.col(n) - F.lit(float(v))) for n, v in zip("rgb", c))

    def labelled():
        return points.withColumn("cluster", (gone(centres[1]) < gone(centres[0])).cast("int"))

    for _ in range(rounds):
        means = {r["cluster"]: (r["r"], r["g"], r["b"]) for r in labelled().groupBy("cluster").agg(F.avg("r").alias("r"), F.avg("g").alias("g"), F.avg("b").alias("b")).collect()}  # two rows
        moved = [means.get(k, centres[k]) for k in (0, 1)]
        if moved == centres:
            break
        centres = moved
    return labelled()


def special_roles(
    kits: DataFrame, team_hues: list[int], *, referee_gap: int = 35, keeper_gap: int = 55, least: int = 5, uniform: bool = True, dark: float = 100.0
) -> DataFrame:
    """Adds hue, saturation and role: referee (shirt far from all teams, dark shorts), goalkeeper (farther, shirt and shorts alike) or null.

    kits: n (observations), r, g, b (median shirt), sr, sg, sb (median shorts, nullable). Tracks of
    fewer than ``least`` rows and washed-out shirts have no role; the referee is tested first.
    """
    h, s, _ = C.hsv(tuple(F.col(c).cast("int") for c in ("r", "g", "b")))
    sh, ss, _ = C.hsv(tuple(F.col(c).cast("int") for c in ("sr", "sg", "sb")))
    gaps = [C.hue_distance(F.col("hue"), F.lit(t)) for t in team_hues]
    far = F.least(*gaps) if len(gaps) > 1 else gaps[0]
    shorts_dark = F.coalesce((F.col("sr") + F.col("sg") + F.col("sb")) / 3 < dark, F.lit(False))
    alike = F.coalesce((F.col("_ss") >= 30) & (C.hue_distance(F.col("_sh"), F.col("hue")) <= 20), F.lit(False))
    keeper = (far >= keeper_gap) & (alike & ~shorts_dark if uniform else F.lit(True))
    role = F.when((F.col("n") < least) | F.col("r").isNull() | (F.col("saturation") < 30), F.lit(None)).when((far >= referee_gap) & shorts_dark, "referee").when(keeper, "goalkeeper")
    return kits.withColumns({"hue": h, "saturation": s, "_sh": sh, "_ss": ss}).withColumn("role", role).drop("_sh", "_ss")


def kit_fit(rows: DataFrame, shirt_weight: float = 0.58, shorts_weight: float = 0.42, cap: float = 0.42, mismatch: float = 0.5) -> DataFrame:
    """Best fit of a track to any team from shirt and shorts distances (0.5 without reference).

    A shorts distance beyond ``mismatch`` caps the fit. rows: track_id, team, shirt, shorts (nullable).
    """
    like = lambda c: 1 - F.least(F.lit(1.0), F.col(c))
    raw = F.when(F.col("shorts").isNull(), like("shirt")).otherwise(shirt_weight * like("shirt") + shorts_weight * like("shorts"))
    fit = F.when(F.col("shirt").isNull(), F.lit(0.5)).when(F.col("shorts") > mismatch, F.least(F.lit(cap), raw)).otherwise(raw)
    return rows.groupBy("track_id").agg(F.max(fit).alias("fit"))


def merge_by_registry(nearest: DataFrame, current: DataFrame, strong: float = 0.5) -> DataFrame:
    """Tracks take their nearest registry identity unless they hold another one with confidence ``strong``.

    nearest: track_id, identity, similarity; current: track_id, identity (nullable), confidence.
    """
    c = current.select("track_id", F.col("identity").alias("held"), "confidence")
    j = c.join(nearest, "track_id", "left")
    keeps = F.col("identity").isNull() | (F.col("held").isNotNull() & (F.col("held") != F.col("identity")) & (F.col("confidence") >= strong))
    return j.select(
        "track_id", F.when(keeps, F.col("held")).otherwise(F.col("identity")).alias("identity"), (~keeps & ~F.col("held").eqNullSafe(F.col("identity"))).alias("merged")
    )


def override_labels(members: DataFrame, margin: float = 0.15) -> DataFrame:
    """In clusters of two tracks or more, a member whose own score is below the best one's by the margin takes its label.

    members: cluster_id, track_id, label, score. A track in several clusters follows the last one.
    """
    group = Window.partitionBy("cluster_id")
    top = F.max(F.struct("score", -F.col("track_id"), "label")).over(group)
    rows = members.withColumn("n", F.count(F.lit(1)).over(group)).withColumn("top", top)
    wins = (F.col("n") >= 2) & (F.col("top.score") > F.col("score") + margin)
    return rows.withColumn("new", F.when(wins, F.col("top.label"))).groupBy("track_id").agg(
        F.max_by(F.coalesce("new", "label"), "cluster_id").alias("label"), F.max(F.col("new").isNotNull()).alias("overridden")
    )


def own_clusters(members: DataFrame) -> DataFrame:
    """The cluster that a track belongs to: the one with its best anchor, the earlier one if equal."""
    order = Window.partitionBy("track_id").orderBy(F.desc("score"), "cluster_id")
    return members.withColumn("rank", F.row_number().over(order)).where("rank = 1").select("track_id", "cluster_id")


def memory_vectors(rows: DataFrame, keep: float = 0.8) -> DataFrame:
    """player and its remembered embedding: the first one, then in order keep * memory + (1 - keep) * new, of unit length each time.

    rows: player, seq (order), embedding. A player's rows are folded in one place; they are one a track.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "embedding"))), lambda x: x["embedding"])

    def mix(a, b):
        new = F.zip_with(a, b, lambda x, y: keep * x + (1 - keep) * y)
        return F.element_at(F.transform(F.array(new), lambda v: F.transform(v, lambda x: x / F.greatest(V.norm(v), F.lit(1e-8)))), 1)

    rest = F.slice("v", 2, F.greatest(F.size("v") - 1, F.lit(0)))
    return rows.groupBy("player").agg(ordered.alias("v")).select("player", F.aggregate(rest, F.get("v", F.lit(0)), mix).alias("embedding"))


def linear_paths(points: DataFrame, frames: int, fps: float) -> DataFrame:
    """path, frame, x, y on piecewise-linear paths through the points (path, t, x, y), clamped at both ends.

    Every leg makes its own frames, so no path is joined with a grid. Of points at one time the last one in (x, y) counts from there on.
    """
    from tracklake.functions.geometry import interpolate

    order = Window.partitionBy("path").orderBy("t", "x", "y")
    legs = points.select("path", "t", "x", "y").withColumn("n", F.lead(F.struct("t", "x", "y")).over(order)).withColumn("first", F.row_number().over(order) == 1)
    frame_of = lambda c: F.ceil(F.col(c) * fps).cast("long")
    low = F.when(F.col("first"), F.lit(0).cast("long")).otherwise(F.greatest(F.lit(0).cast("long"), frame_of("t")))
    high = F.least(F.lit(frames - 1).cast("long"), F.coalesce(frame_of("n.t") - 1, F.lit(frames - 1).cast("long")))
    rows = legs.withColumns({"_low": low, "_high": high}).where("_low <= _high").withColumn("frame", F.explode(F.sequence("_low", "_high")))
    at = F.col("frame") / F.lit(fps)
    value = lambda c: F.when(F.col("n").isNull() | (at < F.col("t")), F.col(c)).otherwise(interpolate(at, F.col("t"), F.col(c), F.col("n.t"), F.col(f"n.{c}")))
    return rows.select("path", "frame", value("x").alias("x"), value("y").alias("y"))

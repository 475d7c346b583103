"""Candidate labels: weighted votes, top-k sums, rarity weights, locks and merges.

An observation's contribution to a candidate is prob * max(0.01, quality).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PEAK, TOP_K, FLOOR = 0.85, 24, 0.01


def contribution() -> Column:
    return F.col("prob") * F.greatest(F.lit(FLOOR), F.col("quality"))


def top_k_votes(obs: DataFrame, k: int = TOP_K, peak: float = PEAK) -> DataFrame:
    """track_id, candidate, votes (sum of the k largest contributions) and peaks among them."""
    order = Window.partitionBy("track_id", "candidate").orderBy(F.desc("c"), "seq")
    return (
        obs.withColumn("c", contribution())
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .groupBy("track_id", "candidate")
        .agg(F.sum("c").alias("votes"), F.count_if(F.col("c") >= peak).alias("peaks"))
    )


def rarity(obs: DataFrame, peak: float = PEAK, smoothing: float = 1.0, *, clip: str | None = None) -> DataFrame:
    """(clip,) candidate, n_tracks, weight = ln((N + s) / (n + s)) + 1; N and n count tracks (of the clip, if its column is given) with a peak."""
    own, key = [clip] if clip else [], clip or "one"
    rows = obs if clip else obs.withColumn(key, F.lit(1))
    peaks = rows.where(contribution() >= peak).select(key, "track_id", "candidate").distinct()
    total = peaks.select(key, "track_id").distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n_all"))
    n = peaks.groupBy(key, "candidate").agg(F.count(F.lit(1)).alias("n_tracks"))
    return n.join(total, key).select(
        *own, "candidate", "n_tracks", (F.ln((F.col("n_all") + smoothing) / (F.col("n_tracks") + smoothing)) + 1).alias("weight")
    )


def weighted_votes(votes: DataFrame, weights: DataFrame | None, *, clip: str | None = None) -> DataFrame:
    """Votes and peaks times the candidate's weight (1 where it has none), which is the clip's if its column is given."""
    key = [*([clip] if clip else []), "candidate"]
    if weights is None:
        return votes.withColumn("peaks", F.col("peaks").cast("double"))
    w = F.coalesce("weight", F.lit(1.0))
    return votes.join(weights.select(*key, "weight"), key, "left").select(
        "track_id", "candidate", (F.col("votes") * w).alias("votes"), (F.col("peaks") * w).alias("peaks")
    )


def scored(votes: DataFrame, lock: float = 2, peak_min: float = 2) -> DataFrame:
    """Adds share, locked (enough peaks) and any_locked of the track."""
    track = Window.partitionBy("track_id")
    return (
        votes.withColumn("total", F.sum("votes").over(track))
        .withColumn("share", F.when(F.col("total") > 0, F.col("votes") / F.col("total")).otherwise(F.lit(0.0)))
        .withColumn("locked", F.col("peaks") >= lock)
        .withColumn("any_locked", F.max("locked").over(track))
        .withColumn("boost", 1 + F.least(F.lit(1.0), F.col("peaks") / max(1.0, peak_min)))
    )


def best_candidate(votes: DataFrame, *, lock: float = 2, peak_min: float = 2, min_share: float = 0.3) -> DataFrame:
    """One row per track: candidate (null if unlocked and below the share) and score.

    With locked candidates the one with most peaks, then votes, wins; otherwise that with most votes.
    """
    s = scored(votes, lock, peak_min)
    order = Window.partitionBy("track_id").orderBy(
        F.desc("locked"), F.desc(F.when(F.col("locked"), F.col("peaks")).otherwise(F.lit(0.0))), F.desc("votes"), "candidate"
    )
    return (
        s.withColumn("rank", F.row_number().over(order))
        .where("rank = 1")
        .select(
            "track_id",
            F.when(F.col("locked") | (F.col("share") >= min_share), F.col("candidate")).alias("candidate"),
            (F.col("votes") * F.col("share") * F.col("boost")).alias("score"),
        )
    )


def ranked_candidates(votes: DataFrame, *, lock: float = 2, peak_min: float = 2, top: int = 5) -> DataFrame:
    """track_id, rank, candidate, score: locked ones first by peaks and votes; others lack the boost."""
    s = scored(votes, lock, peak_min).withColumn(
        "score", F.col("votes") * F.col("share") * F.when(F.col("locked"), F.col("boost")).otherwise(F.lit(1.0))
    )
    order = Window.partitionBy("track_id").orderBy(
        F.desc("locked"), F.desc(F.when(F.col("locked"), F.col("peaks")).otherwise(F.lit(0.0))), F.desc("votes"), "candidate"
    )
    return s.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("track_id", "rank", "candidate", "score")


def longer_lock(votes: DataFrame, lock: float = 2) -> DataFrame:
    """The best candidate, or a longer one that contains it and has enough peaks."""
    order = Window.partitionBy("track_id").orderBy(F.desc("votes"), "candidate")
    best = votes.withColumn("rank", F.row_number().over(order)).where("rank = 1").select("track_id", F.col("candidate").alias("best"))
    longer = (
        votes.join(best, "track_id")
        .where(F.contains("candidate", "best") & (F.length("candidate") > F.length("best")) & (F.col("peaks") >= lock))
        .withColumn("rank", F.row_number().over(Window.partitionBy("track_id").orderBy(F.desc("peaks"), F.desc("votes"), "candidate")))
        .where("rank = 1")
        .select("track_id", F.col("candidate").alias("longer"))
    )
    return best.join(longer, "track_id", "left").select("track_id", F.coalesce("longer", "best").alias("candidate"))


def weighted_distribution(obs: DataFrame) -> DataFrame:
    """track_id, candidate, prob (weighted share) and quality (mean over rows with evidence)."""
    track = Window.partitionBy("track_id")
    sums = obs.groupBy("track_id", "candidate").agg(F.sum(contribution()).alias("c"))
    quality = obs.groupBy("track_id").agg(F.avg("quality").alias("quality"))
    return (
        sums.withColumn("total", F.sum("c").over(track))
        .withColumn("prob", F.when(F.col("total") > 0, F.col("c") / F.col("total")).otherwise(F.lit(0.0)))
        .join(quality, "track_id")
        .select("track_id", "candidate", "prob", "quality")
    )


def merge_max(obs: DataFrame, key: list[str]) -> DataFrame:
    """Per group the maximum of each candidate's probability, renormalised."""
    group = Window.partitionBy(*key)
    top = obs.groupBy(*key, "candidate").agg(F.max("prob").alias("p"))
    return top.withColumn("total", F.sum("p").over(group)).select(
        *key, "candidate", F.when(F.col("total") > 0, F.col("p") / F.col("total")).otherwise(F.lit(0.0)).alias("prob")
    )


def weighted_merge(a: DataFrame, b: DataFrame, key: list[str], wa: float = 1.0, wb: float = 0.8) -> DataFrame:
    """Weighted sum of two long-form distributions."""
    part = lambda df, w: df.select(*key, "candidate", (F.col("prob") * w).alias("prob"))
    return part(a, wa).union(part(b, wb)).groupBy(*key, "candidate").agg(F.sum("prob").alias("prob"))


#: The digits that each digit is read as, and the leading digits that get lost.
CONFUSABLE = {
    "0": "89",
    "1": "74",
    "2": "73",
    "3": "852",
    "4": "196",
    "5": "683",
    "6": "5840",
    "7": "12",
    "8": "35906",
    "9": "84",
}
LOST_LEADS = "12"


def smooth_confusable(dist: DataFrame, key: list[str], strength: float = 0.6, expand: float = 0.6) -> DataFrame:
    """Adds probability to labels with one digit misread, and to those that lost a leading digit.

    ``dist`` has the keys, candidate (digits) and prob; the result is renormalised.
    """
    pair = lambda candidate, factor: F.struct(candidate.alias("candidate"), (F.col("prob") * factor).alias("prob"))
    reads = F.create_map(*[x for d, others in CONFUSABLE.items() for x in (F.lit(d), F.array(*[F.lit(o) for o in others]))])
    of_place = lambda i: F.transform(F.coalesce(reads[F.substring("candidate", i, F.lit(1))], F.array().cast("array<string>")), lambda o: pair(F.overlay("candidate", o, i, F.lit(1)), strength))
    swapped = F.flatten(F.transform(F.sequence(F.lit(1), F.length("candidate")), of_place))
    led = F.array(*[pair(F.concat(F.lit(d), "candidate"), expand) for d in LOST_LEADS])
    own = F.array(pair(F.col("candidate"), 1.0))
    every = F.when(F.length("candidate") == 1, F.concat(own, swapped, led)).when(F.length("candidate") > 1, F.concat(own, swapped)).otherwise(own)
    # dealt anew, as a row becomes several in the task that sums them up; twice the usual number, or the step would be left out and partitions put together by their size before
    parts = 2 * int(dist.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dist.select(*key, "candidate", "prob").repartition(parts, *key)
    summed = dealt.select(*key, F.inline(every)).groupBy(*key, "candidate").agg(F.sum("prob").alias("p"))
    total = F.sum("p").over(Window.partitionBy(*key))
    return summed.select(*key, "candidate", F.when(total > 0, F.col("p") / total).otherwise(F.lit(0.0)).alias("prob"))


def top_hits(ranked: DataFrame, truth: DataFrame, key: list[str]) -> DataFrame:
    """top-1 and top-3 accuracy of (key, rank, candidate) against (key, truth)."""
    seen = truth.join(ranked, key, "left").groupBy(*key).agg(
        F.max(F.when((F.col("candidate") == F.col("truth")) & (F.col("rank") <= 1), 1).otherwise(0)).alias("t1"),
        F.max(F.when((F.col("candidate") == F.col("truth")) & (F.col("rank") <= 3), 1).otherwise(0)).alias("t3"),
    )
    n = F.greatest(F.lit(1), F.count(F.lit(1)))
    return seen.agg(F.count(F.lit(1)).alias("n"), (F.sum("t1") / n).alias("top1"), (F.sum("t3") / n).alias("top3"))

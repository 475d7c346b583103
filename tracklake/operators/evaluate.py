"""Evaluation of events, readers, displays and runs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.operators import votes
from tracklake.operators.matching import optimal_pairs
from tracklake.operators.ranking import next_value


def interval_matches(predicted: DataFrame, truth: DataFrame, *, least: float = 0.3, clip: str | None = None) -> DataFrame:
    """(clip,) pred_id, true_id, iou: in the order of their ids the predictions take their best free interval of the label.

    Both: (clip,) id, label, start_s, end_s. The order is the meaning of the operator, so a label (of a clip) is one group: a task holds its
    intervals, three numbers each, and a prediction looks at the free ones whose start lets them reach ``least``. No pairs are written.
    """
    key = [*([clip] if clip else []), "label"]
    side = lambda df, n: df.dropna(subset=[*key, "start_s", "end_s"]).select(*[F.col(c).alias(f"{n}_{c}") for c in key], "id", F.col("start_s").cast("double").alias("s"), F.col("end_s").cast("double").alias("e"))
    kinds = {f.name: f.dataType.simpleString() for f in predicted.schema}
    true_kind = truth.schema["id"].dataType.simpleString()

    def match(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values("id"), b.sort_values(["s", "id"])
        (ids, s, e), (names, t0, t1) = ([df[c].to_numpy() for c in ("id", "s", "e")] for df in (a, b))
        free, taken, out = np.ones(len(b), bool), 0, []
        for i in range(len(a)):
            if taken * 2 > len(t0):  # what is taken goes, so later searches are shorter
                names, t0, t1 = names[free], t0[free], t1[free]
                free, taken = np.ones(len(t0), bool), 0
            size, lo, hi = e[i] - s[i], 0, len(t0)
            if least > 0:
                slack = 1e-3 + 1e-9 * abs(e[i])
                lo, hi = np.searchsorted(t0, [e[i] - size / least - slack, e[i] - size * least + slack])
            if lo >= hi:
                continue
            both = np.maximum(0.0, np.minimum(e[i], t1[lo:hi]) - np.maximum(s[i], t0[lo:hi]))
            hull = np.maximum(e[i], t1[lo:hi]) - np.minimum(s[i], t0[lo:hi])
            iou = np.divide(both, hull, out=np.zeros_like(both), where=(hull > 0) & free[lo:hi])
            best = iou.max()
            if best > 0 and best >= least:
                at = np.flatnonzero(iou == best) + lo
                j = int(at[names[at].argmin()])
                free[j] = False
                taken += 1
                out.append((*[a[f"p_{c}"].iloc[0] for c in key[:-1]], ids[i], names[j], float(best)))
        return pd.DataFrame(out, columns=[*key[:-1], "pred_id", "true_id", "iou"])

    schema = "".join(f"{c} {kinds[c]}, " for c in key[:-1]) + f"pred_id {kinds['id']}, true_id {true_kind}, iou double"
    group = lambda df, n: side(df, n).groupBy(*[f"{n}_{c}" for c in key])
    return group(predicted, "p").cogroup(group(truth, "t")).applyInPandas(match, schema)


def f1_scores(predicted: DataFrame, truth: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: tp, fp, fn, precision, recall, f1."""
    count = lambda df, n: df.agg(F.count(F.lit(1)).alias(n)).withColumn("one", F.lit(1))
    row = count(predicted, "n_p").join(count(truth, "n_t"), "one").join(count(matches, "tp"), "one")
    one = F.lit(1)
    row = row.withColumn("precision", F.col("tp") / F.greatest(one, F.col("n_p"))).withColumn("recall", F.col("tp") / F.greatest(one, F.col("n_t")))
    f1 = 2 * F.col("precision") * F.col("recall") / F.greatest(F.lit(1e-8), F.col("precision") + F.col("recall"))
    return row.select("tp", (F.col("n_p") - F.col("tp")).alias("fp"), (F.col("n_t") - F.col("tp")).alias("fn"), "precision", "recall", f1.alias("f1"))


NONE = "<none>"


def _share(dist: DataFrame) -> DataFrame:
    total = F.sum("prob").over(Window.partitionBy("item"))
    return dist.withColumn("prob", F.when(total > 0, F.col("prob") / total).otherwise(F.col("prob")))


def _known(dist: DataFrame, known: DataFrame | None) -> DataFrame:
    return dist if known is None else dist.join(known.select("candidate").distinct(), "candidate", "left_semi")


def read_distributions(reads: DataFrame, known: DataFrame | None = None, *, smooth: bool = False) -> DataFrame:
    """item, candidate, prob: the best of all regions of an item, smoothed and cut to the known labels if asked.

    reads: item, region, candidate, prob. An item whose labels are all unknown has no row.
    """
    merged = votes.merge_max(reads, ["item"])
    merged = votes.smooth_confusable(merged, ["item"]) if smooth else merged
    return merged if known is None else _share(_known(merged, known))


def ensemble(a: DataFrame, b: DataFrame, known: DataFrame | None = None, *, smooth: bool = True, wa: float = 1.0, wb: float = 0.8) -> DataFrame:
    """item, candidate, prob of two readers: each smoothed and cut, summed with weights, shared out."""
    ready = lambda df: _known(votes.smooth_confusable(df, ["item"]) if smooth else df, known)
    return _share(votes.weighted_merge(ready(a), ready(b), ["item"], wa, wb))


def judged_reads(dist: DataFrame, truth: DataFrame, *, substring: bool = False) -> DataFrame:
    """item, truth, found (the top candidate or <none>), right and top3 of every item of the truth.

    With ``substring`` a top candidate that contains the truth, or is contained in it, is right too.
    """
    order = Window.partitionBy("item").orderBy(F.desc("prob"), "candidate")
    ranked = dist.withColumn("rank", F.row_number().over(order)).where("rank <= 3")
    tops = ranked.groupBy("item").agg(F.min_by("candidate", "rank").alias("top"), F.collect_set("candidate").alias("three"))
    j = truth.join(tops, "item", "left")
    like: Column = F.col("top") == F.col("truth")
    if substring:
        like = like | F.contains("top", "truth") | F.contains("truth", "top")
    return j.select(
        "item", "truth", F.coalesce("top", F.lit(NONE)).alias("found"), F.coalesce(like, F.lit(False)).alias("right"), F.coalesce(F.array_contains("three", F.col("truth")), F.lit(False)).alias("top3")
    )


def reader_summary(judged: DataFrame) -> DataFrame:
    n = F.greatest(F.lit(1), F.count(F.lit(1)))
    pct = lambda c: 100.0 * F.count_if(c) / n
    return judged.agg(F.count(F.lit(1)).alias("total"), F.count_if("right").alias("correct"), F.count_if("top3").alias("top3_recall"), pct("right").alias("accuracy_pct"), pct("top3").alias("top3_pct"))


def reader_confusions(judged: DataFrame) -> DataFrame:
    """truth, found, n."""
    return judged.groupBy("truth", "found").agg(F.count(F.lit(1)).alias("n"))


def label_tallies(judged: DataFrame) -> DataFrame:
    """truth, correct, total: the report by label."""
    return judged.groupBy("truth").agg(F.count_if("right").alias("correct"), F.count(F.lit(1)).alias("total"))


def match_percentage(matched: DataFrame, column: str) -> DataFrame:
    """n, matched and 100 matched / max(1, n)."""
    hit, n = F.count(column), F.count(F.lit(1))
    return matched.agg(n.alias("n"), hit.alias("matched"), (100.0 * hit / F.greatest(F.lit(1), n)).alias("pct"))


def adjacent_assignment(appearance: DataFrame) -> DataFrame:
    """assignments, correct and accuracy_pct of the best one-to-one matching of each pair of neighbouring frames.

    Frames are matched alone, so a group is two frames. appearance: vec_id, frame, identity, embedding.
    """
    after = next_value(appearance.select("frame").distinct(), "frame", 4096, "next_frame").where("next_frame is not null")
    own = appearance.select("vec_id", "frame", "identity", "embedding")
    left = own.join(after, "frame").select(F.col("frame").alias("pair"), F.lit(0).alias("side"), "vec_id", "identity", "embedding")
    right = own.join(after.select(F.col("next_frame").alias("frame"), F.col("frame").alias("pair")), "frame").select("pair", F.lit(1).alias("side"), "vec_id", "identity", "embedding")

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = (rows[rows["side"] == s].sort_values("vec_id") for s in (0, 1))
        x, y = (np.array(df["embedding"].tolist(), float) for df in (a, b))
        x, y = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12) for v in (x, y))
        pairs = optimal_pairs(-(x @ y.T))
        ia, ib = a["identity"].tolist(), b["identity"].tolist()
        return pd.DataFrame({"n": [len(pairs)], "right": [sum(ia[r] == ib[c] for r, c in pairs)]})

    got = left.union(right).groupBy("pair").applyInPandas(match, "n long, right long")
    n, right_ = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("right"), F.lit(0))
    return got.agg(n.alias("assignments"), right_.alias("correct"), (100.0 * right_ / F.greatest(F.lit(1), n)).alias("accuracy_pct"))


def display_report(shown: DataFrame, expected: DataFrame, least_duration: float = 0.25) -> DataFrame:
    """name, expected, displayed, fragments and seconds (distinct whole seconds on screen) of every name of either side.

    shown: track_id, name (null: none), start_s, end_s, duration; tracks below the least duration never appear.
    """
    seen = shown.where((F.col("duration") >= least_duration) & F.col("name").isNotNull())
    seconds = F.sequence(F.floor("start_s"), F.floor("end_s"))
    covered = seen.withColumn("s", F.explode(seconds)).groupBy("name").agg(F.countDistinct("track_id").alias("fragments"), F.countDistinct("s").alias("seconds"))
    e = expected.select("name").distinct().withColumn("_e", F.lit(True))
    zero = F.lit(0).cast("long")
    return covered.join(e, "name", "full").select(
        "name", F.coalesce("_e", F.lit(False)).alias("expected"), F.col("fragments").isNotNull().alias("displayed"), F.coalesce("fragments", zero).alias("fragments"), F.coalesce("seconds", zero).alias("seconds")
    )


def display_scores(report: DataFrame) -> DataFrame:
    """One row: counts, recall, precision and sorted lists of the names hit, missed and extra."""
    e, d = F.col("expected"), F.col("displayed")
    names = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c, F.col("name")))), ",")
    hit = F.count_if(e & d)
    one = F.lit(1)
    return report.agg(
        F.count_if(e).alias("n_expected"), F.count_if(d).alias("n_displayed"), hit.alias("n_hit"),
        (hit / F.greatest(one, F.count_if(e))).alias("recall"), (hit / F.greatest(one, F.count_if(d))).alias("precision"),
        names(e & d).alias("hit"), names(e & ~d).alias("missed"), names(d & ~e).alias("extra"), F.sum(F.when(e, F.col("fragments")).otherwise(0)).alias("fragments"),
    )


def set_scores(shown: DataFrame, due: DataFrame, by: str, item: str) -> DataFrame:
    """by, precision, recall, missed and extra of the items shown against those due, as sets."""
    j = shown.select(by, item).distinct().withColumn("s", F.lit(1)).join(due.select(by, item).distinct().withColumn("e", F.lit(1)), [by, item], "full")
    hit, n_s, n_e = F.count_if(F.col("s").isNotNull() & F.col("e").isNotNull()), F.count("s"), F.count("e")
    one = F.lit(1)
    return j.groupBy(by).agg((hit / F.greatest(one, n_s)).alias("precision"), (hit / F.greatest(one, n_e)).alias("recall"), (n_e - hit).alias("missed"), (n_s - hit).alias("extra"))


def sequence_summary(boxes: DataFrame) -> DataFrame:
    """Boxes, tracks and frames of every sequence of a MOT table."""
    return boxes.groupBy("sequence").agg(F.count(F.lit(1)).alias("boxes"), F.countDistinct("track_id").alias("tracks"), F.countDistinct("frame").alias("frames"))


def best_run(runs: DataFrame, metric: str, name: str) -> DataFrame:
    """The run with the largest metric; of equal ones the first name."""
    return runs.orderBy(F.desc(metric), name).limit(1)


def report_text(df: DataFrame, order: list[Column | str], limit: int = 1000) -> str:
    """A result as lines of text in the given order; more rows than ``limit`` are an error, not a cut."""
    rows = df.orderBy(*order).take(limit + 1)
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows")
    wide = [max(len(str(r[c])) for r in [*rows, {c: c for c in df.columns}]) for c in df.columns]
    lines = [df.columns, *[[r[c] for c in df.columns] for r in rows]]
    return "\n".join("  ".join(str(v).ljust(w) for v, w in zip(x, wide)).rstrip() for x in lines)


def running_mean(batches: DataFrame) -> DataFrame:
    """Mean loss of an epoch from (epoch, loss, rows): batches weigh by their rows."""
    return batches.groupBy("epoch").agg((F.sum(F.col("loss") * F.col("rows")) / F.greatest(F.lit(1), F.sum("rows"))).alias("loss"))

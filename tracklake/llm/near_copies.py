"""Near copies by the Jaccard similarity of word shingles: every pair of texts at 0.8 or more.

A text is the set of its distinct five-word shingles (of all its words, if it has fewer). Covering SimHash comes first: texts whose fingerprints are within the radius are
candidates, and those of them that are links by their whole sets are groups. Its radius finds few pairs beyond the closest, so ``jaccard_join`` goes on from these groups
to the components of all links: no pair is missed and none is guessed.

Defined cases: texts without a word are copies of one another; an empty table gives an empty result; extra columns stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklake.llm.common import free_name, spool
from tracklake.llm.jaccard_join import Rule, grouped
from tracklake.llm.simhash import near_links

#: Five words, 4 / 5.
RULE = Rule(5, 4, 5)
#: Tables of up to so many rows are broadcast.
SMALL = 100_000


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SMALL else df


def keep_first(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of each group: the smallest id's (null last), of these the smallest text hash's.

    groups: doc_id, h (xxhash64 of the text) and root of every row. Rows that are equal in
    id and text are equal for every later stage, and any one of them stays. Only rows with
    such an equal are ranked; the others are kept or dropped by their key.
    """
    keys = spool(groups.groupBy("root", "doc_id", "h").agg(F.count(F.lit(1)).alias("c")))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("best")
    first = spool(keys.groupBy("root").agg(best, F.count(F.lit(1)).alias("k")).where("k > 1"))
    judged = keys.join(_small(first), "root", "left")
    stays = F.col("best").isNull() | (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("h") == F.col("best.h")))
    marked = spool(judged.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), stays.alias("_stays"), F.col("c").alias("_c")))
    h, rank = free_name(docs, "text_hash"), free_name(docs, "rank_of_copy")
    hashed = docs.withColumn(h, F.xxhash64(F.col(text_col)))
    on = hashed[id_col].eqNullSafe(F.col("_id")) & (hashed[h] == F.col("_h"))
    gone = marked.where("not _stays or _c > 1").select("_id", "_h")
    twice = marked.where("_stays and _c > 1").select("_id", "_h")
    order = Window.partitionBy(id_col, h).orderBy(h)
    ranked = hashed.join(_small(twice), on, "left_semi").withColumn(rank, F.row_number().over(order))
    return hashed.join(_small(gone), on, "left_anti").select(*docs.columns).union(ranked.where(F.col(rank) == 1).select(*docs.columns))


def covered(sets: DataFrame, radius: int = 2) -> DataFrame:
    """a, b and both (their sizes' sum): pairs of sets (unit, n, fp) that connect all whose SimHash is within the radius, by covering tables."""
    units = spool(sets.groupBy("unit").agg(F.min(F.struct("fp", "n")).alias("m")).select("unit", "m.*"))
    leads = spool(units.groupBy("fp").agg(F.min(F.struct("unit", "n")).alias("lead")))
    same = units.join(leads, "fp").where("unit <> lead.unit").select(F.col("lead").alias("x"), F.struct("unit", "n").alias("y"))
    x, y = (leads.select(F.col("fp").alias(c), F.col("lead").alias(s)) for c, s in ("ax", "by"))
    met = same.union(near_links(leads.select("fp"), radius).join(x, "a").select("b", "x").join(y, "b").select("x", "y"))
    pairs = met.select(F.least("x.unit", "y.unit").alias("a"), F.greatest("x.unit", "y.unit").alias("b"), (F.col("x.n") + F.col("y.n")).alias("both"))
    return pairs.distinct()


def groups_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h and root (the group's smallest unit) of every row."""
    return grouped(docs, RULE, id_col, text_col, covered).select("doc_id", "h", "root")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of near copies: that with the smallest id."""
    return keep_first(docs, groups_of(docs, id_col, text_col), id_col, text_col)

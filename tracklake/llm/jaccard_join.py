"""Links of texts whose sets of word shingles have a Jaccard similarity of at least a given share, by vertical partitioning.

All shingles stand in one global order: first those with a hash in the lowest ``LOW`` of all, by the number of sets that hold
them (counted over the whole corpus, so shingles of one text alone come first of all), then the others by hash. The order is cut
into fragments: the counted class, and equal ranges of the others. Every set is thereby cut into segments.

* Candidates come from the first fragment. With similarity s = num / den, two linked sets share a shingle among the first
  ``n (1 - s) + 1`` of each; the smaller one has its first common shingle among its first ``n (1 - s) / (1 + s) + 1`` (its *head*), so
  a shingle that heads no set joins nothing.
* Sizes, the places of the shared shingle, and the parities of the sets over ``PARITIES`` places (sets that differ in d shingles
  differ in at most d of them) drop pairs inside the join, before they are rows.
* The pairs that are left are counted fragment by fragment: segments meet by pair and fragment, each gives a partial overlap, and the sums per
  pair are held against the sizes. No task needs a whole set. No pair is missed and none is guessed.

Equal sets are one unit, so copies cost nothing, and shingles that the same units hold are one key. A key would give the square of its units in
pairs, so in the first rounds, and in more while these are very many, every key has a pivot, every unit is compared with one pivot that it meets, and units found
together are not compared again. The last round compares all pairs that are apart and possible, so the components
are those of all links; keys with many units are dealt in blocks. Statistics of keys are summed up and joined back, so a shingle of a third of all
texts is split like any other skewed key.

Defined cases: a text of fewer words is one shingle; a text without words has an empty set; shingles and sets are told apart by
64-bit hashes; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.llm.common import by_arrow, raw_texts, scratch, spool
from tracklake.llm.simhash import _LOWER, components, fingerprint
from tracklake.llm.suffix_dedup import stretch_hashes

#: The share of all hashes whose shingles are counted over the corpus.
LOW = 0.2
#: Segments of a set.
FRAGMENTS = 8
PARITIES = 512
#: Rows of 16 bytes that are broadcast at most.
SMALL = 500_000
#: Rows that a Python worker gets at once.
BATCH = 1024
#: Pivot rounds at least and at most, pairs a key entry beyond which there is another one, and units of a key in a block of the last round.
LEAST, ROUNDS, MANY, BLOCK = 4, 6, 3000, 2000
#: Pivots of a key from the second round on.
SOME = 8
_CUTS = np.array([LOW + (1 - LOW) * k / (FRAGMENTS - 1) for k in range(FRAGMENTS - 1)])
_CUTS = np.array([int(c * (1 << 64)) for c in _CUTS], np.uint64)


@dataclass(frozen=True)
class Rule:
    """Sets of shingles of ``width`` words are linked at a similarity of num / den."""

    width: int = 4
    num: int = 17
    den: int = 20

    def prefix(self, n):
        """Shingles of a set of n that its first common one is among. Takes numbers and columns' names."""
        return f"({n} * {self.den - self.num}L div {self.den}L + 1)" if isinstance(n, str) else n * (self.den - self.num) // self.den + 1

    def alone(self, n: int) -> bool:
        """Whether no other set can be similar to one of n."""
        return n * (self.den - self.num) < self.num

    def head(self, at: Column, n: Column) -> Column:
        return (self.den + self.num) * at <= (self.den - self.num) * n

    def enough(self, same: Column, both: Column) -> Column:
        """Whether so many common shingles of sets with ``both`` shingles together make a link."""
        return (self.den + self.num) * same >= self.num * both

    def possible(self, x: str, y: str) -> Column:
        """Whether the sizes, the places of a shared shingle and the parities leave room for a link."""
        nx, ny, px, py = (F.col(f"{s}.{c}").cast("long") for c in ("n", "at") for s in (x, y))
        sizes = self.den * F.least(nx, ny) >= self.num * F.greatest(nx, ny)
        return sizes & self.enough(F.least(nx - px, ny - py), nx + ny) & ((self.den + self.num) * odd(x, y) <= (self.den - self.num) * (nx + ny))


def odd(x: str, y: str) -> Column:
    """The places where the parities of two sets differ: at most as many as shingles of one alone."""
    return sum((F.bit_count(F.col(f"{x}.bits")[k].bitwiseXOR(F.col(f"{y}.bits")[k])) for k in range(PARITIES // 64)), F.lit(0))


def shingles(raw: bytes | None, width: int) -> np.ndarray:
    """The hashes of a text's distinct shingles, ascending."""
    words = (raw or b"").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    return np.unique(stretch_hashes(flat, starts[:n], ends[-n:]))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int32)
    values = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _unit(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes(), 7)


def sets(rows: DataFrame, rule: Rule, marked: bool = False) -> DataFrame:
    """doc_id, h, unit, n, bits, low and shingles of every row (doc_id, h, text).

    shingles: those of the counted class (``low`` of them), and more by hash if the prefix is longer. Sets that link with no
    other one, and sets that the task has met before, have none. With ``marked`` there is also fp, the SimHash of the text of a set that has shingles.
    """

    def make():
        seen: set[int] = set()

        def work(batch: pa.RecordBatch) -> dict:
            units, sizes, bits, lows, parts, fps = [], [], [], [], [], []
            for raw in raw_texts(batch.column("text")):
                s = shingles(raw, rule.width)
                units.append(_unit(s))
                sizes.append(len(s))
                odd = np.bincount((s % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1
                bits.append(np.packbits(odd.astype(np.uint8)).view(np.uint64))
                lows.append(int(np.searchsorted(s, _CUTS[0])))
                parts.append(s[:0] if rule.alone(len(s)) or units[-1] in seen else s[: max(lows[-1], rule.prefix(len(s)))])
                seen.add(units[-1])
                if marked:
                    fps.append(int(np.uint64(fingerprint(raw, rule.width)).view(np.int64)) if len(parts[-1]) else None)
            return {
                "doc_id": batch.column("doc_id"),
                "h": batch.column("h"),
                "unit": pa.array(np.array(units, np.uint64).view(np.int64)),
                "n": pa.array(np.array(sizes, np.int32)),
                "bits": _lists(bits),
                "low": pa.array(np.array(lows, np.int32)),
                "shingles": _lists(parts),
                **({"fp": pa.array(fps, pa.int64())} if marked else {}),
            }

        return work

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, h long, unit long, n int, bits array<long>, low int, shingles array<long>" + ", fp long" * marked
    return by_arrow(rows.select("doc_id", "h", "text"), schema, make, 256)


def segments(rows: DataFrame, width: int) -> DataFrame:
    """unit, fragment and shingles of the rows' sets: one row for each fragment that the set has a part in."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            units, fragments, parts = [], [], []
            for raw in raw_texts(batch.column("text")):
                s = shingles(raw, width)
                cuts = np.searchsorted(s, _CUTS)
                for k, part in enumerate(np.split(s, cuts)):
                    if len(part):
                        units.append(_unit(s))
                        fragments.append(k)
                        parts.append(part)
            return {"unit": pa.array(np.array(units, np.uint64).view(np.int64)), "fragment": pa.array(np.array(fragments, np.int32)), "shingles": _lists(parts)}

        return work

    return by_arrow(rows.select("text"), "unit long, fragment int, shingles array<long>", make, 64)


def entries(got: DataFrame, rule: Rule) -> DataFrame:
    """key, unit, n, at (the place in the order) and head of the prefixes' shingles that another unit has too; a key is all shingles with the same units."""
    posts = got.where(F.size("shingles") > 0).select("unit", "n", "low", F.posexplode("shingles").alias("at", "key"))
    counts = posts.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = posts.join(counts, "key").repartition("unit").dropDuplicates(["unit", "key"])
    # of the counted shingles those of one unit alone come first, then the shared ones by their count
    is_low = F.col("at") < F.col("low")
    of_unit = Window.partitionBy("unit", is_low)
    place = F.col("low") - F.count(F.lit(1)).over(of_unit) + F.row_number().over(of_unit.orderBy("df", "key")) - 1
    placed = shared.withColumn("at", F.when(is_low, place).otherwise(F.col("at")).cast("int")).where(f"at < {rule.prefix('n')}")
    placed = spool(placed.select("key", "unit", "n", "at", rule.head(F.col("at"), F.col("n")).alias("head")))
    mixed = [F.bit_xor(F.xxhash64("unit", F.lit(k))).alias(f"x{k}") for k in (1, 2)]
    held = placed.groupBy("key").agg(F.count(F.lit(1)).alias("c"), *mixed, F.max("head").alias("any"), F.min("unit").alias("lo"), F.max("unit").alias("hi"))
    alike = held.where("any and lo <> hi").select("key", F.xxhash64("c", "x1", "x2").alias("held"))
    return placed.join(alike, "key").groupBy(F.col("held").alias("key"), "unit", "n").agg(F.min("at").alias("at"), F.max("head").alias("head"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SMALL else df


def linked(pairs: DataFrame, units: DataFrame, rows: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b, both: their sizes' sum) of units that are links, by the sums of the partial overlaps of their fragments."""
    named = spool(pairs.select(F.col("a").alias("unit")).union(pairs.select(F.col("b").alias("unit"))).distinct().join(units, "unit").select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")))
    own = rows.join(_small(named), rows["doc_id"].eqNullSafe(F.col("_id")) & (rows["h"] == F.col("_h")), "left_semi")
    parts = spool(segments(own, rule.width).dropDuplicates(["unit", "fragment"]), batch=BATCH)
    a, b = (parts.select(F.col("unit").alias(s), "fragment", F.col("shingles").alias(f"s{s}")) for s in "ab")
    partial = pairs.join(a, "a").join(b, ["b", "fragment"]).select("a", "b", "both", F.size(F.array_intersect("sa", "sb")).alias("same"))
    return partial.groupBy("a", "b", "both").agg(F.sum("same").alias("same")).where(rule.enough(F.col("same"), F.col("both"))).select("a", "b")


def _blocks(rooted: DataFrame, live: DataFrame, rule: Rule) -> DataFrame:
    """All possible pairs of different roots that meet in a key, one of them with its head there; large keys in blocks of the one against all others."""
    cut = rooted.join(live.select("key", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks")), "key")
    x = cut.where("y.head").select("key", F.pmod(F.xxhash64("y.unit", F.lit(99)), "blocks").cast("int").alias("block"), F.col("y").alias("x"))
    y = cut.select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "y")
    met = x.join(y, ["key", "block"]).where(F.col("x.root") != F.col("y.root"))
    return met.where(~F.col("y.head") | (F.col("x.unit") < F.col("y.unit"))).where(rule.possible("x", "y"))


def _pivots(rooted: DataFrame, live: DataFrame, rule: Rule, nr: int) -> DataFrame:
    """For each unit the possible pair with a pivot of its keys whose parities differ least, as that is the likeliest link.

    The first pivots have the least of their own before the key. The others are any ``SOME`` of the key's largest group, which the rest are likely to belong to, and in
    every other round any at all.
    """
    mixed = lambda c: F.xxhash64(f"{c}.unit", F.lit(nr))
    orders = {0: lambda c: F.struct(~F.col(f"{c}.head"), F.col(f"{c}.at") / F.col(f"{c}.n"), mixed(c)), 1: lambda c: F.struct(F.col(f"{c}.root") != F.col("main"), ~F.col(f"{c}.head"), mixed(c))}
    central = orders[nr] if nr == 0 else orders[1] if nr % 2 else lambda c: F.struct(~F.col(f"{c}.head"), F.xxhash64(f"{c}.root", F.lit(nr)), mixed(c))
    open_ = rooted.join(live.select("key", "main"), "key")
    slot = F.pmod(F.xxhash64("y.unit", F.lit(-nr)), F.lit(SOME if nr else 1))
    picked = open_.groupBy("key", slot.alias("slot")).agg(F.min_by("y", central("y")).alias("x")).drop("slot")
    met = picked.join(open_, "key").where(F.col("x.root") != F.col("y.root")).where(rule.possible("x", "y"))
    near = F.struct(odd("x", "y") / (F.col("x.n") + F.col("y.n")), mixed("x"))
    return met.groupBy("y.unit").agg(F.min_by("x", near).alias("x"), F.first("y").alias("y")).select("x", "y")


def linked_components(got: DataFrame, rows: DataFrame, rule: Rule, likely: DataFrame | None = None) -> DataFrame:
    """node and root of every unit that is linked with another one, but the roots.

    likely: pairs (a, b, both) of units that another method has found; those that are links are groups before the first round.
    Two rounds with pivots come first, more of them while the pairs are very many for the number of entries, then all that is left. A
    round goes on with the keys that hold units of different groups.
    """
    spark = got.sparkSession
    with scratch(spark):
        posts = spool(entries(got, rule))
        # one row of each unit stands for it
        best = got.join(posts.select("unit").distinct(), "unit", "left_semi").groupBy("unit")
        units = spool(best.agg(F.min(F.struct("doc_id", "h")).alias("row"), F.first("bits").alias("bits")).select("unit", "row.*", "bits"))
        entry = F.struct("unit", "n", "at", "head", "bits", F.col("unit").alias("root"))
        rooted = spool(posts.join(units.select("unit", "bits"), "unit").select("key", entry.alias("y")))
        size = rooted.count()
        links, roots = None, spark.createDataFrame([], "node long, root long")
        moved_to = lambda held, roots: held.join(roots.withColumnRenamed("root", "to"), F.col("y.unit") == F.col("node"), "left").select("key", F.col("y").withField("root", F.coalesce("to", "y.unit")).alias("y"))
        if likely is not None:
            with scratch(spark):
                links = spool(linked(spool(likely), units, rows, rule), keep=True)
            roots = components(links)
            rooted = spool(moved_to(rooted, roots))
        for nr in range(ROUNDS + 1):
            # pairs of different roots, without those of two tails
            per = rooted.groupBy("key", "y.root").agg(F.count(F.lit(1)).alias("c"), F.count_if(~F.col("y.head")).alias("t"))
            square = lambda c: F.sum(F.col(c)).cast("double") * F.sum(F.col(c)) - F.sum(F.col(c).cast("double") * F.col(c))
            live = spool(per.groupBy("key").agg(((square("c") - square("t")) / 2).alias("pairs"), F.sum("c").alias("c"), F.max_by("root", F.struct("c", "root")).alias("main")).where("pairs > 0"))
            apart = live.agg(F.sum("pairs")).first()[0] or 0
            if not apart:
                break
            last = nr == ROUNDS or nr >= LEAST and apart <= MANY * size
            met = _blocks(rooted, live, rule) if last else _pivots(rooted, live, rule, nr)
            pairs = met.select(F.least("x.unit", "y.unit").alias("a"), F.greatest("x.unit", "y.unit").alias("b"), (F.col("x.n") + F.col("y.n")).alias("both"))
            with scratch(spark):
                found = spool(linked(spool(pairs.distinct()), units, rows, rule), keep=True)
            links = found if links is None else links.union(found)
            roots = components(links)
            if last:
                break
            rooted = spool(moved_to(rooted.join(live.select("key"), "key", "left_semi"), roots))
        return spool(roots, keep=True)


def grouped(docs: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text", likely: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """doc_id, h (the text's hash), n (the set's size), unit (the set) and root (the component's smallest unit) of every row.

    likely: pairs (a, b, both) of units to begin with, from unit, n and fp of the sets.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("h"))
    got = spool(sets(rows, rule, likely is not None), batch=BATCH)
    roots = linked_components(got, rows, rule, likely and likely(got.where("fp is not null").select("unit", "n", "fp")))
    return got.select("doc_id", "h", "n", "unit").join(roots, F.col("unit") == F.col("node"), "left").select("doc_id", "h", "n", "unit", F.coalesce("root", "unit").alias("root"))


def jaccard_components(docs: DataFrame, rule: Rule = Rule(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id that links reach) of every row; an empty set is linked with nothing."""
    rows = spool(grouped(docs, rule, id_col, text_col))
    lowest = rows.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    named = rows.join(lowest, "root", "left")
    return named.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))

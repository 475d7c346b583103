"""Removal of benchmark passages from training text (built-in functions only).

Benchmark texts are normalised and cut into windows of ten words. Every window sets
one flag in a small table, at a hash of its first four words. Each document is scanned
once, word by word, against the flags; only the places that pass are expanded to whole
windows and looked up in the table of benchmark windows, so a hit is an equal string and
not just an equal hash. The window table is broadcast while its number of windows is at
most ``broadcast_windows`` and joined by a shuffle beyond that. Both give the same rows.

A word of a document is hit if any occurrence of a window covers it. An item with fewer
than ten words, but not none, is one window of its own length.

Defined cases: a null text has no words; a null item id counts as an empty one; repeated
rows are told apart by counting, and each gets its row; equal windows of several items
count for each of them; empty tables give no hits; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklake.llm.common import let, lower_ascii

WINDOW = 10
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z only) words; separators are ASCII other than digits and letters."""
    return F.array_remove(F.split(F.coalesce(lower_ascii(text), F.lit("")), SEPARATORS), "")


def _paired(values: Column, gap: int) -> Column:
    """A hash of the values at i and i + gap, for every i that has both."""
    n = F.size(values) - gap
    return F.zip_with(F.slice(values, 1, n), F.slice(values, gap + 1, n), lambda a, b: F.xxhash64(a, b))


def _leads(words: Column, level: int, slots: int) -> Column:
    """For every place the slot (1 to ``slots``) of its first ``level`` (1, 2 or 4) words.

    The array is empty if there are too few words. Pairs are hashed, then pairs of pairs:
    two zips instead of an index lookup for every word of every place.
    """
    values = F.transform(words, lambda w: F.xxhash64(w))
    for gap in (1, 2)[: level // 2]:
        values = _level(values, gap)
    slot = F.transform(values, lambda x: (F.pmod(x, F.lit(slots).cast("long")) + 1).cast("int"))
    return F.when(F.size(words) >= level, slot).otherwise(F.array().cast("array<int>"))


def _level(values: Column, gap: int) -> Column:
    return let(values, lambda v: _paired(v, gap))


def _level_of(length: int) -> int:
    return 4 if length >= 4 else 2 if length >= 2 else 1


def benchmark_windows(bench: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows: gram, length, w (its words), items (sorted item ids as strings)."""
    words = (
        bench.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words_of(F.col(text_col)).alias("ws"))
        .where(F.size("ws") > 0)
        .withColumn("length", F.least(F.size("ws"), F.lit(WINDOW)))
        .select("item", "ws", "length", F.explode(F.sequence(F.lit(1), F.size("ws") - F.col("length") + 1)).alias("at"))
        .select("item", "length", F.slice("ws", F.col("at"), F.col("length")).alias("w"))
    )
    return (
        words.groupBy(F.array_join("w", " ").alias("gram"), "length", "w")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
        .select("gram", "length", "w", "items")
    )


_BYTES = [bytes(b >> k & 1 for k in range(8)) for b in range(256)]


def _flags(windows: DataFrame, lengths: list[int], slots: int) -> bytes:
    """One byte for each slot, 1 where a window's lead falls.

    The executors build bitmaps of 32,768 slots each; the driver gets at most ``slots`` / 32,768 of them, of 4 KB.
    """
    lead = F.coalesce(*[F.when(F.col("length") == n, F.get(_leads(F.col("w"), _level_of(n), slots), F.lit(0))) for n in lengths]).cast("long")
    parts = windows.select(lead.alias("k")).groupBy(F.bitmap_bucket_number("k").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("k")).alias("bits"))
    flags = bytearray(slots + (1 << 15))
    for row in parts.collect():
        at = (row["part"] - 1) << 15
        flags[at : at + (1 << 15)] = b"".join(map(_BYTES.__getitem__, row["bits"]))
    return bytes(flags[:slots])


def _packed(flags: bytes) -> bytes:
    """Four flags in a byte, so that it is an ASCII character. The table is part of the plan, whose text the driver keeps for every stage."""
    bits = np.frombuffer(flags + bytes(-len(flags) % 4), np.uint8).reshape(-1, 4)
    return (bits << np.arange(4, dtype=np.uint8)).sum(axis=1, dtype=np.uint8).tobytes()


def _is_set(packed: Column, slot: Column) -> Column:
    """Whether the flag of a slot (from 1) is set."""
    at = slot - 1
    byte = F.ascii(F.substring(packed, F.shiftright(at, 2) + 1, F.lit(1)).cast("string"))
    return F.getbit(byte, at.bitwiseAND(3)) == 1


def find_hits(
    docs: DataFrame,
    bench: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    broadcast_windows: int = 2_000_000,
) -> DataFrame:
    """A row per document: doc_id, h1, h2 (of its text), n_words, n_hit, items, spans."""
    windows = benchmark_windows(bench)
    known = windows.groupBy("length").count().collect()  # at most ten rows
    lengths, n = [r["length"] for r in known], sum(r["count"] for r in known)
    slots = 1 << 14
    while slots < 128 * n and slots < 1 << 22:
        slots *= 2
    flags = F.lit(_packed(_flags(windows, lengths, slots))) if n else None
    levels = sorted({_level_of(length) for length in lengths})
    none = F.array().cast("array<struct<at:int,len:int,gram:string>>")

    def places(x):
        def of(length):
            leads = x[f"l{_level_of(length)}"]
            starts = F.when(F.size(x["w"]) >= length, F.sequence(F.lit(0), F.size(x["w"]) - length))
            return F.transform(
                F.filter(F.coalesce(starts, F.array().cast("array<int>")), lambda i: _is_set(flags, F.get(leads, i))),
                lambda i: F.struct(
                    i.alias("at"), F.lit(length).alias("len"), F.array_join(F.slice(x["w"], i + 1, length), " ").alias("gram")
                ),
            )

        return F.concat(*[of(length) for length in lengths]) if lengths else none

    def scan(ws):
        leads = [_leads(ws, level, slots).alias(f"l{level}") for level in levels]
        found = let(F.struct(ws.alias("w"), *leads), places)
        return F.struct(F.size(ws).cast("long").alias("n_words"), found.alias("places"))

    text = F.col(text_col)
    scanned = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("h1"), F.hash(text).alias("h2"), let(words_of(text), scan).alias("s")
    ).select("doc_id", "h1", "h2", "s.n_words", F.posexplode_outer("s.places").alias("nr", "p"))
    small = F.broadcast(windows) if n <= broadcast_windows else windows
    hits = scanned.join(small.select(F.col("gram").alias("g"), "items"), F.col("p.gram") == F.col("g"), "left")
    covered = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(
            F.greatest(a["end"], x["at"] + x["len"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0), x["at"] + x["len"] - F.greatest(a["end"], x["at"]))).alias("n"),
        ),
        lambda a: a["n"],
    )
    return (
        hits.groupBy("doc_id", "h1", "h2", "n_words")
        .agg(
            F.sum(F.when(F.coalesce("nr", F.lit(0)) == 0, 1).otherwise(0)).cast("int").alias("_copies"),
            F.collect_set(F.when(F.col("items").isNotNull(), F.struct("p.at", "p.len"))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        )
        .withColumn("n_hit", covered)
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
        .select("doc_id", "h1", "h2", "n_words", "n_hit", "items", "spans")
    )


def remove_contaminated(docs: DataFrame, bench: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without any hit, with all their columns."""
    found = find_hits(docs, bench, id_col=id_col, text_col=text_col).where("n_hit > 0")
    bad = found.select(F.col("doc_id").alias("bad_id"), F.col("h1").alias("bad_h1"), F.col("h2").alias("bad_h2")).distinct()
    text = docs[text_col]
    same = docs[id_col].eqNullSafe(bad["bad_id"]) & (F.xxhash64(text) == bad["bad_h1"]) & (F.hash(text) == bad["bad_h2"])
    return docs.join(bad, same, "left_anti")

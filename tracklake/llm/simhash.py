"""SimHash near-duplicate groups by covering locality-sensitive hashing.

A fingerprint bit is the majority vote over the hashes of a text's word shingles. Two
fingerprints are linked if they differ in at most ``radius`` bits, and a group is a
connected component of links.

Every bit position is given a non-zero vector of ``radius + 1`` bits; table v keeps the
positions whose vector has an odd inner product with v. ``radius`` vectors never span
the whole space, so some v is orthogonal to all differing positions: a pair within the
radius agrees on that table's whole mask. The tables thus miss no pair.

Equal fingerprints are collapsed first, so copies cost nothing. Buckets with more than
``split`` different fingerprints are dealt again by a second covering family over the
bits their mask leaves free, which bounds any group by the number of values that the
last dozen free bits can take. A bucket yields a spanning forest of its links and never its pairs.
Components come from one task while the links are few, beyond that from alternating
large-star and small-star steps on the links.

Defined cases: a null or empty text has fingerprint zero and is linked like any other;
null ids take part but never name a component unless all its ids are null; repeated rows
each get a row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklake.llm.common import by_arrow, raw_texts, shared_dir, spool
from tracklake.operators.linking import stars

BITS = 64
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(raw: bytes | None, width: int = 3, seed: int = 42) -> int:
    """The SimHash of a text's bytes as an unsigned 64-bit number."""
    words = (raw or b"").translate(_LOWER).split()
    n = len(words) - width + 1
    if not words:
        return 0
    flat = b" ".join(words)
    if n <= 1:
        return xxhash.xxh64_intdigest(flat, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    stops = ends[width - 1 :].tolist()
    one = xxhash.xxh64_intdigest
    hashes = np.fromiter((one(flat[a:b], seed) for a, b in zip(starts, stops)), np.uint64, n)
    votes = np.zeros(BITS, np.int64)
    for k in range(0, n, 65536):
        part = hashes[k : k + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", longs: list[str] | None = None) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and the given long columns of every row."""
    longs = longs or []

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            got = np.fromiter((fingerprint(raw) for raw in raw_texts(batch.column("text"))), np.uint64, batch.num_rows)
            return {"doc_id": batch.column("doc_id"), "fp": pa.array(got.view(np.int64)), **{c: batch.column(c) for c in longs}}

        return work

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *longs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return by_arrow(rows, ", ".join([f"doc_id {kind}", "fp long", *(f"{c} long" for c in longs)]), make)


def covering_masks(positions: list[int], radius: int) -> list[int]:
    """Masks over the positions, of which every pair within the radius agrees on one."""
    vectors = [1 + k % ((1 << (radius + 1)) - 1) for k in range(len(positions))]
    masks = []
    for v in range(1, 1 << (radius + 1)):
        masks.append(sum(1 << p for p, x in zip(positions, vectors) if (x & v).bit_count() % 2))
    return masks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _dealt(fps: DataFrame, masks: list[int], keep: list[str]) -> DataFrame:
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)])
    return fps.select("fp", *keep, F.explode(tables).alias("x")).select("fp", *keep, "x.t", "x.key")


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the different fingerprints of one bucket."""
    n, out = len(fps), []
    parent = list(range(n))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    u = fps.view(np.uint64)
    for i in range(n - 1):
        near = np.flatnonzero(np.bitwise_count(u[i + 1 :] ^ u[i]) <= radius) + i + 1
        for j in near.tolist():
            a, b = top(i), top(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((int(fps[i]), int(fps[j])))
    return out


def _bucket_links(rows: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """Links of every bucket: a sorted partition is cut where the key changes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            k = b[keys].to_numpy()
            cuts = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
            last = int(cuts[-1]) if len(cuts) else 0
            yield _links(b["fp"].to_numpy()[:last], cuts, radius)
            rest = b.iloc[last:]
        if rest is not None:
            yield _links(rest["fp"].to_numpy(), np.array([], np.int64), radius)

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInPandas(run, "a long, b long").distinct()


def _links(fps: np.ndarray, cuts: np.ndarray, radius: int) -> pd.DataFrame:
    out = [e for part in np.split(fps, cuts[cuts < len(fps)]) if len(part) > 1 for e in _forest(np.unique(part), radius)]
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def near_links(fps: DataFrame, radius: int = 2, split: int = 2048) -> DataFrame:
    """Links (a, b) that connect exactly the fingerprints (column fp, distinct) within the radius."""
    masks = covering_masks(list(range(BITS)), radius)
    rows = _dealt(fps, masks, [])
    sizes = rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = spool(sizes)
    most = sizes.agg(F.max("n")).first()[0] or 0
    small = rows.join(sizes.where(F.col("n") <= split).select("t", "key"), ["t", "key"])
    links = _bucket_links(small, ["t", "key"], radius)
    if most > split:
        big = rows.join(sizes.where(F.col("n") > split).select("t", "key"), ["t", "key"])
        second = [covering_masks([p for p in range(BITS) if not mask >> p & 1], radius) for mask in masks]
        of_table = F.element_at(F.array(*[F.array(*[F.lit(_signed(m)) for m in family]) for family in second]), F.col("t") + 1)
        again = big.select("fp", "t", F.col("key").alias("outer"), F.posexplode(of_table).alias("t2", "mask")).select(
            "fp", "t", "outer", "t2", F.col("fp").bitwiseAND(F.col("mask")).alias("key")
        )
        links = links.union(_bucket_links(again, ["t", "outer", "t2", "key"], radius))
    return links


def settled(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(u):
        low, high = np.minimum(root[u], root[v]), np.maximum(root[u], root[v])
        open_ = low != high
        if not open_.any():
            break
        np.minimum.at(root, high[open_], low[open_])
        while (root != root[root]).any():
            root = root[root]
    return nodes, nodes[root]


def components(links: DataFrame, one_task: int = 1_000_000) -> DataFrame:
    """node and root (the component's smallest node) of every node that has a link, but the roots.

    Up to ``one_task`` links are settled by one task, more by star steps over the whole cluster;
    the result is the same.
    """
    spark = links.sparkSession
    shared_dir(spark)
    links = spool(links.select("a", "b").where("a <> b").distinct())
    if links.count() > one_task:
        return stars(links)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
        if parts:
            node, root = settled(*(np.concatenate(c) for c in zip(*parts)))
            inner = node != root
            yield pa.RecordBatch.from_pydict({"node": pa.array(node[inner]), "root": pa.array(root[inner])})

    return spool(links.coalesce(1).mapInArrow(run, "node long, root long"))


def near_duplicates(docs: DataFrame, *, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp and component_id of every row."""
    marked = spool(fingerprints(docs, id_col, text_col))
    firsts = marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = components(near_links(firsts.select("fp"), radius))
    named = firsts.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_fp = named.join(lowest, "root").select("fp", "component_id")
    return marked.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, *, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group: that with the smallest id, as in ``near_copies.keep_first``."""
    from tracklake.llm.near_copies import keep_first

    hashed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("h"))
    marked = spool(fingerprints(hashed, "doc_id", "text", ["h"]))
    roots = components(near_links(marked.select("fp").distinct(), radius))
    groups = marked.join(roots, F.col("fp") == F.col("node"), "left").select("doc_id", "h", F.coalesce("root", "fp").alias("root"))
    return keep_first(docs, groups, id_col, text_col)

"""The Merkle manifest against plain trees, and its query against SQL."""

import zlib
from hashlib import sha256

import duckdb
import pytest
from pyspark import cloudpickle
from tests_support import prose
from tracklake.llm import manifest
from tracklake.llm.oracles import SQL
from tracklake.llm.queries import QUERIES

NAMES = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, lower=False):
    text = row["text"] if not lower or row["text"] is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in row["text"])
    values = [row[c] for c in NAMES[:-1]] + [text]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k : k + 16]) for k in range(0, len(levels[-1]), 16)])
    return levels


def plain_path(levels, at):
    out = []
    for level in levels[:-1]:
        run = at // 16 * 16
        out.append((level[run:at], level[at + 1 : run + 16]))
        at //= 16
    return out


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    trees = {}
    for source, own in by.items():
        own.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r)))
        trees[source] = plain_tree([plain_leaf(r) for r in own])
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    top = plain_tree([trees[s][-1][0] for s in order])
    out = []
    for source, own in by.items():
        for at, r in enumerate(own):
            path = plain_path(trees[source], at) + plain_path(top, order.index(source))
            node = leaf = plain_leaf(r)
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0:
                node = plain_leaf(r, True)
            for left, right in path:
                node = h(*left, node, *right)
            out.append((r["doc_id"], leaf, trees[source][-1][0], top[-1][0], h(*(x for a, b in path for x in a + b)), node, node == top[-1][0]))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in manifest.merkle_manifest(df).collect()), key=repr)


@pytest.mark.parametrize("size", [1, 2, 15, 16, 17, 255, 256, 257, 4095, 4096])
def test_traversal(size):
    nodes = [str(k).encode() for k in range(size)]
    levels = plain_tree([str(k) for k in range(size)])
    climbed = manifest.height(0, size)
    assert manifest.treehash(nodes, climbed).decode() == levels[climbed][0]
    for at, path in enumerate(manifest.traverse(nodes, climbed)):
        assert [(a.decode(), b.decode()) for a, b in path] == [("".join(a), "".join(b)) for a, b in plain_path(levels, at)]


def test_stacks_stay_small():
    sizes = []

    class Watched(manifest.Stack):
        def push(self, node, level=0):
            super().push(node, level)
            sizes.append(sum(map(len, self.runs)))

    before, manifest.Stack = manifest.Stack, Watched
    try:
        assert sum(1 for _ in manifest.traverse([b"x"] * 4096, 3)) == 4096
    finally:
        manifest.Stack = before
    assert max(sizes) <= 3 * 16


@pytest.mark.parametrize("levels", [1, 3])
def test_equals_plain_trees(spark, docs, monkeypatch, levels):
    """With blocks of one level every source of some size is several blocks, and so are the sources."""
    monkeypatch.setattr(manifest, "LEVELS", levels)
    monkeypatch.setattr(manifest, "RANGE_ROWS", 150)
    cloudpickle.register_pickle_by_value(manifest)
    try:
        rows = [{"doc_id": k if k % 40 else None, "source": "hot" if k % 2 else f"s{k % 37}" if k % 6 else None, "lang": None if k % 7 == 0 else "ÄÖ", "n_chars": k, "text": None if k % 11 == 0 else prose(k, k % 30)} for k in range(700)]
        rows += rows[:50] + [{**rows[3], "text": "OTHER"}]
        df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(7)
        assert found(df) == plain(rows)
        assert found(docs) == plain([r.asDict() for r in docs.select(*NAMES).collect()])
    finally:
        cloudpickle.unregister_pickle_by_value(manifest)


def test_empty(empty):
    assert manifest.merkle_manifest(empty).count() == 0


def test_equals_sql(spark, small):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    want = con.sql(SQL["op13_manifest"])
    got = QUERIES["op13_manifest"](spark, small).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())

"""A Merkle manifest of a dataset: a digest of every row, a root, and each row's authentication path.

A tree has the leaves of one source in order of their ids; the trees' roots are the leaves of one more tree. Nodes have up to ``ARITY``
children, and a run of one child is hashed too as long as its level has more than one node.

* Leaves are hashed where the rows are read; only digests are moved from there on.
* Positions: the digests are dealt by range and sorted; a source's rows in a task are numbered by the task, and the
  rows before a task are summed up from one row a task.
* A tree is cut into aligned blocks of ``ARITY ** LEVELS`` leaves, so a source with a third of all rows is many blocks. A block's root comes from a treehash stack, which
  holds one run a level. The roots are the leaves of the same work one step up, until every tree has one node.
* Paths go down the same steps. A block's traversal keeps, level by level, the run that its leaf stands in and a treehash stack that makes the next
  run: one leaf enters every stack with each leaf that leaves, so a run is ready when the traversal enters it. What is held is
  logarithmic in the block. The path above a block is the same for all its leaves: it comes first among the block's rows and is appended to each.

Defined cases: a null source is the first tree; null ids come first; rows of one id are ordered by their digest, and equal rows are
interchangeable; a null id is never tampered with; an empty table has no tree; extra columns are no part of a leaf.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.llm.common import lower_ascii, spool

ARITY, LEVELS = 16, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Leaves that a task ranks.
RANGE_ROWS = 200_000
PATH = "array<struct<left:string,right:string>>"


def digest(parts: Iterator[bytes] | list[bytes]) -> bytes:
    return sha256(b"".join(parts)).hexdigest().encode()


def leaf_hash(columns: list[Column]) -> Column:
    """SHA-256 over the fields, each ``-`` if null, else its length in bytes, a colon and the value."""
    field = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*map(field, columns)).cast("binary"), 256)


def leaves(docs: DataFrame, every: int = 5) -> DataFrame:
    """doc_id, tree (the source), digest, and altered: the leaf of the tampered row where ``every`` divides the id's crc32, else null."""
    own = [docs[c] for c in FIELDS]
    hit = F.pmod(F.crc32(docs["doc_id"].cast("string").cast("binary")), F.lit(every)) == 0
    return docs.select(
        "doc_id", docs["source"].alias("tree"), leaf_hash(own).alias("digest"), F.when(hit, leaf_hash([*own[:-1], lower_ascii(own[-1])])).alias("altered"), F.monotonically_increasing_id().alias("row")
    )


def placed(rows: DataFrame, tree: str, order: list[str], n: int) -> DataFrame:
    """Adds pos: the place (from 0) within the tree, in the given order. Takes a written table of n rows."""
    keys = [tree, *order]
    parts = max(1, -(-n // RANGE_ROWS), min(n // 1000, 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, at = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            codes = batch.column(tree).dictionary_encode(null_encoding="encode")
            code, names = codes.indices.to_numpy(zero_copy_only=False), codes.dictionary.to_pylist()
            starts = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(code) else np.zeros(0, np.int64)
            places = np.arange(len(code)) - np.repeat(starts, np.diff(np.append(starts, len(code))))
            if len(code) and last is not None and names[code[0]] == last[0]:
                places[code == code[0]] += at  # sorted, so these come first
            if len(code):
                last, at = (names[code[-1]],), int(places[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(code), part, np.int32)), pa.array(places)], schema=batch.schema.append(pa.field("part", pa.int32())).append(pa.field("place", pa.int64())))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    numbered = spool(dealt.mapInArrow(number, f"{fields}, part int, place long"))
    counts = numbered.groupBy("part", tree).agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy(tree).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a part that does not begin a tree begins within one: at most one row for each part
    base = counts.select(F.col("part").alias("_part"), F.col(tree).alias("_tree"), F.sum("c").over(before).alias("_base")).where("_base > 0")
    joined = numbered.join(F.broadcast(base), (F.col("part") == F.col("_part")) & F.col(tree).eqNullSafe(F.col("_tree")), "left")
    return joined.select(*rows.columns, (F.col("place") + F.coalesce("_base", F.lit(0))).alias("pos"))


class Stack:
    """Treehash: takes nodes of one level, hashes full runs, and keeps one run a level."""

    def __init__(self, levels: int):
        self.runs: list[list[bytes]] = [[] for _ in range(levels + 1)]

    def push(self, node: bytes, level: int = 0) -> None:
        self.runs[level].append(node)
        while level + 1 < len(self.runs) and len(self.runs[level]) == ARITY:
            node, self.runs[level] = digest(self.runs[level]), []
            level += 1
            self.runs[level].append(node)

    def close(self) -> list[bytes]:
        """The nodes of the top level, the last runs of the others hashed as they are."""
        for level in range(len(self.runs) - 1):
            if self.runs[level]:
                node, self.runs[level] = digest(self.runs[level]), []
                self.push(node, level + 1)
        return self.runs[-1]


def height(block: int, size: int) -> int:
    """Levels that a block climbs: all of them, but for a tree that is no more than its only block."""
    if block or size == ARITY**LEVELS:
        return LEVELS
    return next(h for h in range(LEVELS + 1) if ARITY**h >= size)


def treehash(nodes: list[bytes], levels: int) -> bytes:
    stack = Stack(levels)
    for x in nodes:
        stack.push(x)
    return stack.close()[0]


def traverse(nodes: list[bytes], levels: int) -> Iterator[list[tuple[bytes, bytes]]]:
    """The path of every node, in order: for each level what stands left and right of it in its run."""
    current, ahead, entered = [], [], []
    for level in range(levels):
        stack = Stack(level)
        for x in nodes[: ARITY ** (level + 1)]:
            stack.push(x)
        current.append(stack.close())
        ahead.append(Stack(level))
        entered.append(ARITY ** (level + 1))
    for s in range(len(nodes)):
        for level in range(levels):
            span = ARITY ** (level + 1)
            if s and s % span == 0:  # the next run is ready
                current[level], ahead[level] = ahead[level].close(), Stack(level)
        path = []
        for level in range(levels):
            at, own = s // ARITY**level % ARITY, current[level]
            path.append((b"".join(own[:at]), b"".join(own[at + 1 :])))
            if entered[level] < len(nodes):
                ahead[level].push(nodes[entered[level]])
                entered[level] += 1
        yield path


def fold(node: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    for left, right in path:
        node = digest((left, node, right))
    return node


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """Rows of one tree and block each, from sorted batches; columns as lists."""
    held: dict[str, list] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        got = {n: batch.column(n).to_pylist() for n in batch.schema.names}
        cuts = [i for i in range(1, batch.num_rows) if got["block"][i] != got["block"][i - 1] or got["tree"][i] != got["tree"][i - 1]]
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
            part = {n: v[lo:hi] for n, v in got.items()}
            if held and (part["tree"][0], part["block"][0]) == (held["tree"][0], held["block"][0]):
                for n in held:
                    held[n] += part[n]
            else:
                if held:
                    yield held
                held = part
    if held:
        yield held


def _by_block(rows: DataFrame, above: DataFrame | None = None) -> DataFrame:
    """The rows dealt by tree and block, sorted by place; the row of the path above a block stands before the block's rows."""
    cut = rows.withColumn("block", F.expr(f"pos div {ARITY**LEVELS}L"))
    if above is not None:
        cut = cut.unionByName(above.withColumnRenamed("pos", "block").withColumn("pos", F.lit(-1).cast("long")), allowMissingColumns=True)
    return cut.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def _emit(kind: pa.DataType, **columns) -> pa.RecordBatch:
    """A batch of the given lists; ``tree`` and ``doc_id`` have the type ``kind``."""
    types = {"tree": kind, "doc_id": kind, "pos": pa.int64(), "path": _PATH, "verified": pa.bool_()}
    return pa.RecordBatch.from_pydict({n: pa.array(v, types.get(n, pa.string())) for n, v in columns.items()})


_PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def _types(rows: DataFrame, name: str) -> tuple[str, pa.DataType]:
    kind = rows.schema[name].dataType.simpleString()
    return kind, {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def block_roots(rows: DataFrame) -> DataFrame:
    """tree, pos (the block's number) and digest of every block of rows (tree, pos, digest)."""
    kind, own = _types(rows, "tree")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches):
            root = treehash([x.encode() for x in g["digest"]], height(g["block"][0], len(g["digest"])))
            yield _emit(own, tree=g["tree"][:1], pos=g["block"][:1], digest=[root.decode()])

    return _by_block(rows.select("tree", "pos", "digest")).mapInArrow(run, f"tree {kind}, pos long, digest string")


def climb(rows: DataFrame) -> list[DataFrame]:
    """Written tables of nodes (tree, pos, digest), each of the blocks of the one before; the last has one node a tree. rows is written, too."""
    steps = [rows]
    while True:
        steps.append(spool(block_roots(steps[-1])))
        if not (steps[-1].agg(F.max("pos")).first()[0] or 0):
            return steps


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[bytes], Iterator[list[tuple[bytes, bytes]]], list[tuple[bytes, bytes]]]]:
    """The groups without their first row, their nodes, the nodes' paths inside the block, and the path above it."""
    for g in _groups(batches):
        above = [(x["left"].encode(), x["right"].encode()) for x in g["path"][0] or []]
        nodes = [x.encode() for x in g["digest"][1:]]
        yield g, nodes, traverse(nodes, height(g["block"][0], len(nodes))), above


def descend(rows: DataFrame, above: DataFrame, step: int = 256) -> DataFrame:
    """tree, pos and path of every node of rows, from the paths (tree, pos, path) of their blocks."""
    kind, own = _types(rows, "tree")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, nodes, paths, top in _paths(batches):
            for k in range(0, len(nodes), step):
                some = [[{"left": a.decode(), "right": b.decode()} for a, b in [*p, *top]] for _, p in zip(nodes[k : k + step], paths)]
                yield _emit(own, tree=g["tree"][:1] * len(some), pos=g["pos"][1 + k : 1 + k + len(some)], path=some)

    return _by_block(rows.select("tree", "pos", "digest"), above.select("tree", "pos", "path")).mapInArrow(run, f"tree {kind}, pos long, path {PATH}")


def proofs(rows: DataFrame, above: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of the lowest step.

    rows: doc_id, tree, pos, digest, altered. above: tree, pos (the block), path, subroot, root.
    """
    kind, own = _types(rows, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, nodes, paths, top in _paths(batches):
            root, upper = g["root"][0], [x for pair in top for x in pair]
            proof, folded = [], []
            for leaf, altered, path in zip(nodes, g["altered"][1:], paths):
                proof.append(digest([*(x for pair in path for x in pair), *upper]).decode())
                folded.append(fold(altered.encode() if altered else leaf, [*path, *top]).decode())
            n = len(nodes)
            yield _emit(own, doc_id=g["doc_id"][1:], leaf=g["digest"][1:], subroot=g["subroot"][:1] * n, root=[root] * n, proof_sha256=proof, folded_root=folded, verified=[x == root for x in folded])

    dealt = _by_block(rows.select("doc_id", "tree", "pos", "digest", "altered"), above.select("tree", "pos", "path", "subroot", "root"))
    return dealt.mapInArrow(run, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def merkle_manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    folded_root is recomputed from the tampered leaf (``leaves``), or else the original one, with the original path.
    """
    base = spool(leaves(docs))
    rows = spool(placed(base, "tree", ["doc_id", "digest", "row"], base.count()))
    steps = climb(rows)
    tops = spool(steps[-1].select(F.lit(0).alias("tree"), F.col("tree").alias("source"), "digest"))
    tops = spool(placed(tops, "tree", ["source"], tops.count()))
    upper = climb(tops)
    top = upper[-1].first()  # the only node
    path = upper[-1].select("tree", "pos", F.lit(None).cast(PATH).alias("path"))
    for step in reversed(upper[:-1]):
        path = spool(descend(step, path))
    subroots = spool(tops.join(path.select("pos", "path"), "pos").select("source", "digest", "path"))
    of_tree = lambda df: df.join(subroots.select("source", F.col("digest").alias("subroot"), F.lit(top and top["digest"]).alias("root")), df["tree"].eqNullSafe(F.col("source")))
    path = steps[-1].join(subroots.select("source", "path"), steps[-1]["tree"].eqNullSafe(F.col("source"))).select("tree", "pos", "path")
    for step in reversed(steps[1:-1]):
        path = spool(descend(step, path))
    return proofs(rows, of_tree(path))

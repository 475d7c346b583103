"""Best-two-fit packing of tokenised documents into fixed-length sequences.

Documents longer than a sequence are cut into full pieces and a rest; no other document
is cut. A bin is opened with the longest piece left and filled greedily with the longest
piece that still fits. Then the smallest piece of the bin is taken out if two unpacked
pieces fill the larger gap more tightly; the piece returns to the unpacked ones.

Full pieces are sequences of their own. The others are counted and dealt by a hash into lots of about
``lot`` pieces; a lot is packed by itself
over counts of lengths, so its cost follows the bins and each lot wastes at most about one bin.
Only lengths, ids and checksums move; texts and token ids never leave their task.

If a tokenizer's own rules say that it drops white space and that no token reaches across it (``RULES``),
texts are tokenised by white-space separated chunks, with a bounded cache of chunks; texts with special
tokens or unusual separators go to it whole. With any other rules all texts do.

Defined cases: a null or empty text is one piece with the end token only; repeated rows
are packed once each; ties are broken by id, piece and checksum; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.llm.common import by_arrow, raw_texts, spool

#: Separators that only Python splits at, and special tokens.
UNUSUAL = re.compile("[\x1c-\x1f]|<\\|")
#: Beyond Latin letters (and dotted capital I) lower case is left to the tokenizer.
WIDE = re.compile("[^\x00-įı-ɏ]")
#: A mark that does not stand right after a letter or digit.
ODD_MARK = re.compile(r"[.,](?<=[^\w\s][.,]|_[.,])")
CACHE = 700_000
#: The normalizer and splitting of a tokenizer that works chunk by chunk.
RULES = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
)
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


class ChunkTokenizer:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.by_chunk = self._chunked(path)
        self.cache: dict[str, bytes] = {}
        self.limit = cache
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    @staticmethod
    def _chunked(path: str) -> bool:
        """Whether the file's rules are those that chunks are right for."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        split = (steps[0].get("pattern") or {}).get("Regex") if steps[0].get("type") == "Split" else None
        special = all(t["content"].startswith("<|") for t in spec.get("added_tokens") or ())
        return (spec.get("normalizer"), split) == RULES and bool(steps[0].get("invert")) and (spec.get("model") or {}).get("end_of_word_suffix") == "</w>" and special

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        return np.asarray(ids, "<u4").tobytes() if sys.byteorder == "big" else array("I", ids).tobytes()

    def _learn(self, chunks: list[str]) -> None:
        """Cache new chunks. Words of letters alone are encoded in one go and cut at the ends of words."""
        words = [c for c in chunks if c.isalpha()]
        if words:
            ids = np.asarray(self.tok.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
            cuts = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            if len(cuts) == len(words):
                raw = ids.tobytes()
                self.cache.update(zip(words, (raw[a:b] for a, b in zip([0, *cuts], cuts))))
            else:
                words = []
        known = set(words)
        rest = [c for c in chunks if c not in known]
        for c, e in zip(rest, self.tok.encode_batch_fast(rest, add_special_tokens=False) if rest else ()):
            self.cache[c] = self._bytes(e.ids)

    def encode(self, text: str) -> bytes:
        if not self.by_chunk or UNUSUAL.search(text):
            return self._bytes(self.tok.encode(text, add_special_tokens=False).ids)
        if not WIDE.search(text):
            text = text.lower()
        if not ODD_MARK.search(text):  # then each mark is a token of its own
            text = text.replace(". ", " . ").replace(", ", " , ").replace(".\n", " .\n").replace(",\n", " ,\n")
        chunks = text.split()
        known = self.cache
        new = [c for c in set(chunks) if c not in known]
        if new:
            if len(known) + 2 * len(new) > self.limit:
                known.clear()
                new = list(set(chunks))
            self._learn(new)
        return b"".join(map(known.__getitem__, chunks))


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ChunkTokenizer:
    """One tokenizer, with its cache, for all tasks of a Python worker."""
    return ChunkTokenizer(path)


def pieces(docs: DataFrame, tokenizer_path: str, *, length: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    end = np.asarray([end_id], "<u4").tobytes()

    def make():
        tok = tokenizer(tokenizer_path)

        def work(batch: pa.RecordBatch) -> dict:
            row, nr, size, crc = [], [], [], []
            for i, raw in enumerate(raw_texts(batch.column("text"))):
                ids = tok.encode((raw or b"").decode("utf-8", "surrogatepass")) + end
                for k, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    row.append(i)
                    nr.append(k)
                    size.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            nr = np.array(nr, np.int64)
            return {
                "doc_id": batch.column("doc_id").take(pa.array(row, pa.int64())),
                "piece": pa.array(nr.astype(np.int32)),
                "start": pa.array(nr * length),
                "length": pa.array(size, pa.int64()),
                "ids_crc32": pa.array(crc, pa.int64()),
            }

        return work

    return by_arrow(rows, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long", make, 512)


class _Stock:
    """Counts of unpacked pieces by length, with the largest length at most a bound."""

    def __init__(self, counts: np.ndarray):
        self.n = counts.tolist()
        self.bits = sum(1 << k for k, c in enumerate(self.n) if c)

    def at_most(self, bound: int) -> int:
        return (self.bits & ((1 << (bound + 1)) - 1)).bit_length() - 1 if bound >= 0 else -1

    def take(self, k: int) -> None:
        self.n[k] -= 1
        if not self.n[k]:
            self.bits &= ~(1 << k)

    def put(self, k: int) -> None:
        self.n[k] += 1
        self.bits |= 1 << k


def best_two_fit(counts: np.ndarray, length: int) -> list[list[int]]:
    """Bins, as lists of lengths, that hold every counted piece once."""
    stock, bins = _Stock(counts), []
    while stock.bits:
        top = stock.at_most(length)
        stock.take(top)
        held, gap = [top], length - top
        while gap and (k := stock.at_most(gap)) > 0:
            stock.take(k)
            held.append(k)
            gap -= k
        if gap and len(held) > 1:
            least = min(held)
            room, best = gap + least, (least, 0, 0)
            a = stock.at_most(room - 1)
            while a > 0 and 2 * a > best[0]:
                stock.take(a)
                b = stock.at_most(min(a, room - a))
                stock.put(a)
                if b > 0 and a + b > best[0]:
                    best = (a + b, a, b)
                    if a + b == room:
                        break
                a = stock.at_most(a - 1)
            if best[1]:
                held.remove(least)
                stock.put(least)
                for k in best[1:]:
                    stock.take(k)
                    held.append(k)
        bins.append(held)
    return bins


def _pack_lot(lot: pd.DataFrame, length: int) -> pd.DataFrame:
    lot = lot.sort_values(["length", "doc_id", "piece", "ids_crc32"], kind="stable", na_position="first").reset_index(drop=True)
    sizes = lot["length"].to_numpy()
    bins = best_two_fit(np.bincount(sizes, minlength=length + 1), length)
    first = np.searchsorted(sizes, np.arange(length + 2)).tolist()
    sequence, offset = np.zeros(len(lot), np.int64), np.zeros(len(lot), np.int64)
    base = int(lot["lot"].iloc[0]) << 32
    for nr, held in enumerate(bins):
        at = 0
        for k in held:
            row = first[k]
            first[k] += 1
            sequence[row], offset[row] = base + nr, at
            at += k
    return lot.assign(sequence_id=sequence, offset=offset).drop(columns="lot")


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    length: int = 2048,
    end_id: int = 0,
    lot: int = 50_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece with its sequence and its offset there."""
    cut = spool(pieces(docs, tokenizer_path, length=length, end_id=end_id, id_col=id_col, text_col=text_col))
    part = cut.where(F.col("length") < length)
    lots = max(1, part.count() // lot)
    schema = f"doc_id {cut.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    # by place in the written table, so equal rows are dealt like any others
    dealt = part.withColumn("lot", F.pmod(F.monotonically_increasing_id(), F.lit(lots)))
    packed = dealt.groupBy("lot").applyInPandas(lambda x: _pack_lot(x, length), schema)
    # of the written table, so the numbers are the same whenever a task runs again
    whole = cut.where(F.col("length") == length).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(whole)

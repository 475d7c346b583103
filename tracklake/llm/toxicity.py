"""Toxicity scores from a learnt lexicon, fuzzy matching and context windows.

The lexicon (whole words and stems) is learnt from a bounded, documented sample of
labelled rows: a term enters if its share of toxic documents is beyond chance, with at most 5 % of
the terms expected to be false; near copies in the sample count once. Terms
stand in a trie; a text's words are matched by intersecting the trie with each word's
Levenshtein automaton (distance one; the automaton's states are its sparse edit rows),
so misspelt terms are caught as well. Each match is scored in a window of words:
other matches and a direct address strengthen it, quotation marks and reporting verbs weaken it. A
logistic model, fitted on the same sample, turns the sums into a score.

Labels are only read for training rows; scores see nothing but the text.

Defined cases: a null or empty text has no match and gets the score of such texts; with
no usable label the lexicon is empty and every score is the same; a word between quotes
counts as quoted; ties in the sample are ordered by hash and id; repeated rows each get a
row; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklake.llm.common import crc_fold, learn

WORD = re.compile(r"[^\W_]+")
#: Words of reported speech and of direct address.
REPORTING = frozenset("said says wrote writes called calls quoted quote reported sagte schrieb dit écrit dijo escribió".split())
ADDRESS = frozenset("you your yours du dich dein euch tu toi vous tú usted eres".split())
QUOTES = "\"“”„«»"
STEM = 3  # shortest stem


class LexiconTrie:
    """Terms as a trie; match() intersects it with a word's Levenshtein automaton."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], fuzzy_from: int = 5):
        self.children: list[dict[str, int]] = [{}]
        self.word: list[float | None] = [None]
        self.stem: list[float | None] = [None]
        self.size: list[int] = [0]
        self.fuzzy_from = fuzzy_from
        for terms, mark in ((words, self.word), (stems, self.stem)):
            for term, weight in terms.items():
                at = 0
                for c in term:
                    nxt = self.children[at].get(c)
                    if nxt is None:
                        nxt = self.children[at][c] = len(self.children)
                        self.children.append({})
                        self.word.append(None)
                        self.stem.append(None)
                        self.size.append(self.size[at] + 1)
                    at = nxt
                mark[at] = weight

    def _step(self, row: dict[int, int], c: str, word: str) -> dict[int, int]:
        """The automaton's next state: edits (0 or 1) by how much of the word is read."""
        out: dict[int, int] = {}
        for i, e in row.items():
            if i < len(word) and word[i] == c:
                out[i + 1] = min(e, out.get(i + 1, 2))
            if e == 0:
                out[i] = min(1, out.get(i, 2))
                if i < len(word):
                    out[i + 1] = min(1, out.get(i + 1, 2))
                if i + 1 < len(word) and word[i + 1] == c:
                    out[i + 2] = min(1, out.get(i + 2, 2))
        return out

    def match(self, word: str) -> tuple[float, int] | None:
        """The best weight and its edits, or None."""
        best: tuple[float, int] | None = None
        stack = [(0, {0: 0})]
        n = len(word)
        while stack:
            at, row = stack.pop()
            long_enough = self.size[at] >= self.fuzzy_from
            if self.word[at] is not None:
                e = min(row.get(n, 2), row.get(n - 1, 1) + 1)
                if e == 0 or (e == 1 and long_enough):
                    best = max(best or (-1e9, 0), (self.word[at], -e))
            if self.stem[at] is not None:
                e = min(row.values(), default=2)
                if e == 0 or (e == 1 and self.size[at] > self.fuzzy_from):
                    best = max(best or (-1e9, 0), (self.stem[at], -e))
            for c, nxt in self.children[at].items():
                if after := self._step(row, c, word):
                    stack.append((nxt, after))
        return None if best is None else (best[0], -best[1])

    def reachable(self, start: str) -> bool:
        """Can a word with this start match? Some path must survive the start, or end within it."""
        stack = [(0, {0: 0})]
        n = len(start)
        while stack:
            at, row = stack.pop()
            if any(i >= n - 1 for i in row) or self.word[at] is not None or self.stem[at] is not None:
                return True
            for c, nxt in self.children[at].items():
                if after := self._step(row, c, start):
                    stack.append((nxt, after))
        return False


@dataclass
class ToxicityModel:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    innocent: frozenset[str] = frozenset()
    coef: np.ndarray = field(default_factory=lambda: np.zeros(6))

    def scorer(self) -> "ToxicityScorer":
        return ToxicityScorer(self)


class ToxicityScorer:
    def __init__(self, model: ToxicityModel, cache: int = 200_000):
        self.model, self.limit = model, cache
        self.trie = LexiconTrie(model.words, model.stems)
        self.starts: dict[str, bool] = {}
        self.found: dict[str, tuple[float, int] | None] = {}
        self.chunks: dict[str, tuple[str, ...]] = {}

    def _match(self, word: str) -> tuple[float, int] | None:
        if word in self.found:
            return self.found[word]
        if len(self.found) >= self.limit:
            self.found.clear()
        got = None if word in self.model.innocent else self.trie.match(word)
        self.found[word] = got
        return got

    def _of_chunk(self, chunk: str) -> tuple[str, ...]:
        """The matching words of a white-space separated chunk."""
        out = []
        for w in WORD.findall(chunk):
            s = w[:4]
            ok = self.starts.get(s)
            if ok is None:
                if len(self.starts) >= self.limit:
                    self.starts.clear()
                ok = self.starts[s] = self.trie.reachable(s)
            if ok and self._match(w):
                out.append(w)
        return tuple(out)

    def matches(self, text: str) -> dict[str, tuple[float, int]]:
        """The matching words of a lower-cased text."""
        out = {}
        known = self.chunks
        for chunk in set(text.split()):
            got = known.get(chunk)
            if got is None:
                if len(known) >= self.limit:
                    known.clear()
                got = known[chunk] = self._of_chunk(chunk)
            for w in got:
                out[w] = self._match(w)
        return out

    def features(self, text: str | None) -> np.ndarray:
        """Constant, any match, log of summed window scores, best window score, log of fuzzy matches, density."""
        out = np.zeros(6)
        out[0] = 1
        low = (text or "").lower()
        hits = self.matches(low) if self.model.words or self.model.stems else {}
        if not hits:
            return out
        tokens = [(m.start(), m.end(), m.group()) for m in WORD.finditer(low)]
        at = [i for i, t in enumerate(tokens) if t[2] in hits]
        total, best, fuzzy = 0.0, 0.0, 0
        for nr, i in enumerate(at):
            weight, edits = hits[tokens[i][2]]
            near = sum(1 for k in (nr - 2, nr - 1, nr + 1, nr + 2) if 0 <= k < len(at) and abs(at[k] - i) <= 5)
            window = tokens[max(0, i - 5) : i + 6]
            s, e, _ = tokens[i]
            left, right = low[max(0, s - 40) : s], low[e : e + 40]
            quoted = (sum(map(left.count, QUOTES)) % 2 == 1 and any(q in right for q in QUOTES)) or any(w in REPORTING for _, _, w in window)
            direct = any(w in ADDRESS for _, _, w in window)
            score = weight * (0.6 if edits else 1.0) * (1 + 0.2 * near + 0.2 * direct) * (0.4 if quoted else 1.0)
            total, best, fuzzy = total + score, max(best, score), fuzzy + bool(edits)
        out[1:] = 1, math.log1p(total), best, math.log1p(fuzzy), len(at) / len(tokens)
        return out

    def score(self, text: str | None) -> float:
        z = float(self.features(text) @ self.model.coef)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _distinct_texts(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """One of each set of near copies (two of three least shingle hashes equal)."""
    seen: set[tuple[int, int]] = set()
    out = []
    for text, label in rows:
        words = WORD.findall(text)
        grams = [" ".join(words[i : i + 3]).encode() for i in range(max(1, len(words) - 2))]
        least = [min(xxhash.xxh64_intdigest(g, s) for g in grams) for s in (1, 2, 3)]
        keys = [(s, least[s]) for s in range(3)]
        if sum(k in seen for k in keys) < 2:
            out.append((text, label))
        seen.update(keys)
    return out


def _significant(tox: Counter, clean: Counter, base: float, n_tests: int, rate: float = 0.05) -> dict[str, float]:
    """Terms whose share of toxic documents is beyond chance, and their log odds.

    Chernoff's bound on the chance of each, and of these the largest set of least chances that
    keeps the expected share of false terms below ``rate`` (Benjamini and Hochberg).
    """
    found = []
    for term, k in tox.items():
        n = k + clean[term]
        p = k / n
        if k < 3 or p < 0.4 or p <= 2 * base:
            continue
        kl = p * math.log(p / base) + ((1 - p) * math.log((1 - p) / (1 - base)) if p < 1 else 0)
        found.append((-n * kl, term))
    found.sort()
    ok = [i for i, (chance, _) in enumerate(found, 1) if chance <= math.log(rate * i / max(1, n_tests))]
    return {term: math.log((tox[term] + 0.5) / (clean[term] + 0.5)) - math.log(base / (1 - base)) for _, term in found[: ok[-1] if ok else 0]}


def fit(rows: list[tuple[str, int]]) -> ToxicityModel:
    """Learn the lexicon and the logistic model from (text, label) pairs."""
    rows = _distinct_texts([(t.lower(), y) for t, y in rows])
    n_tox = sum(y for _, y in rows)
    if not rows or not n_tox or n_tox == len(rows):
        share = (n_tox + 0.5) / (len(rows) + 1)
        return ToxicityModel(coef=np.array([math.log(share / (1 - share)), 0, 0, 0, 0, 0]))
    base = n_tox / len(rows)
    df = {0: Counter(), 1: Counter()}
    dp = {0: Counter(), 1: Counter()}
    for text, y in rows:
        words = set(WORD.findall(text))
        df[y].update(words)
        dp[y].update({w[:k] for w in words for k in range(STEM, min(len(w), 10))})
    tests = len(df[0] | df[1]) + len(dp[0] | dp[1])
    words = _significant(df[1], df[0], base, tests)
    stems = _significant(dp[1], dp[0], base, tests)
    # a stem stands only if it says more than the one longer or shorter term that explains it
    kept: dict[str, float] = {}
    for s in sorted(stems, key=lambda s: (-dp[1][s], -len(s))):
        if any(s.startswith(k) for k in kept) or any(k.startswith(s) and dp[1][k] >= 0.9 * dp[1][s] for k in kept):
            continue
        if any(w.startswith(s) and df[1][w] >= 0.9 * dp[1][s] for w in words):
            continue
        kept[s] = stems[s]
    # a word stands beside its stem only if it is most of what the stem finds
    words = {w: v for w, v in words.items() if not any(w.startswith(s) and df[1][w] < 0.5 * dp[1][s] for s in kept)}
    model = ToxicityModel(words, kept)
    probe = model.scorer()
    fuzzy = {w for text, y in rows if y == 0 for w, (_, e) in probe.matches(text).items() if e}
    model = ToxicityModel(words, kept, frozenset(fuzzy))
    probe = model.scorer()
    x = np.array([probe.features(t) for t, _ in rows])
    y = np.array([v for _, v in rows], float)
    coef = np.zeros(x.shape[1])
    ridge = np.diag([1e-3] + [0.05] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ coef, -30, 30)))
        grad = x.T @ (p - y) + ridge @ coef
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(hess, grad)
        coef -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    model.coef = coef
    return model


def training_table(
    docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, sample: int, max_bytes: int = 1 << 26, max_text: int = 1 << 22
) -> DataFrame:
    """text and label of labelled rows outside the held-out fold, in the order of a hash of the id.

    Three documented bounds: a text of more than ``max_text`` bytes is no training row; of the others at most ``sample`` are taken,
    and of these as many of the first as have ``max_bytes`` bytes of text together. They are chosen by their sizes, before any text is moved.
    """
    usable = labels.where(F.col(label).isNotNull() & (crc_fold(F.col("doc_id"), folds) != held_out)).select("doc_id", F.col(label).cast("int").alias("label"))
    chosen = F.broadcast(usable.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample))  # at most ``sample`` rows
    rows = docs.where("text is not null").select("doc_id", "text", F.xxhash64("text").alias("_h"), F.octet_length("text").alias("_n")).where(F.col("_n") <= max_text)
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("_h"), F.col("label")]
    first = rows.select("doc_id", "_h", "_n").join(chosen, "doc_id").orderBy(*order).limit(sample)
    so_far = F.sum("_n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    kept = first.withColumn("bytes", so_far).where(F.col("bytes") <= max_bytes)
    keys = kept.groupBy("doc_id", "_h", "label").agg(F.min("bytes").alias("bytes"), F.count(F.lit(1)).alias("_c"))
    texts = rows.join(F.broadcast(keys), ["doc_id", "_h"]).groupBy("doc_id", "_h", "label", "bytes", "_c").agg(F.first("text").alias("text"))
    return texts.select(F.explode(F.array_repeat("bytes", F.col("_c").cast("int"))).alias("bytes"), "text", "label")


def pairs_of(table: pd.DataFrame) -> list[tuple[str, int]]:
    """(text, label) pairs of a training table, in its order."""
    rows = table.sort_values("bytes", kind="stable")
    return [(t, int(y)) for t, y in zip(rows["text"], rows["label"])]


def fit_on(table: DataFrame) -> ToxicityModel:
    """The model of a training table, fitted by one task on an executor."""
    return learn(table, lambda rows: fit(pairs_of(rows)))


def score_documents(docs: DataFrame, model: ToxicityModel, *, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and predicted of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = model.scorer()
        for b in batches:
            score = np.fromiter((scorer.score(t) for t in b["text"]), float, len(b))
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": score, "predicted": (score >= threshold).astype("int32")})

    return rows.mapInPandas(run, f"doc_id {kind}, score double, predicted int")


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """The documents below the threshold, with all their columns."""

    def verdict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = model.scorer()
        for texts in batches:
            yield pd.Series([scorer.score(t) < threshold for t in texts], dtype=bool)

    keep = F.pandas_udf(verdict, "boolean")
    return docs.where(keep(F.col("text")))

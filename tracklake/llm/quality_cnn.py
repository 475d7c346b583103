"""Quality classifier: a byte-level convolutional network in numpy.

Filters of ``WIDTH`` bytes slide over the whole text. As the input is one-hot, a filter
is a table of weights by offset and byte, and a convolution a sum of table lookups.
Responses are max-pooled over overlapping chunks that cover the whole document; an
extra channel per chunk is its strongest self-similarity at small lags, which shows looping text.
The chunks' values are combined by their mean and maximum and a logistic layer gives one
probability. Filters and layer are trained together by Adam; the gradient of a maximum flows
only to the window that gave it.

Defined cases: a null or empty text, or one shorter than a filter, is padded with zero
bytes; with no usable label or only one class the score is the (smoothed) share of that
class; repeated rows each get a row; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.llm.common import by_arrow, learn, raw_texts
from tracklake.llm.toxicity import pairs_of

FILTERS, WIDTH, BLOCK = 12, 5, 256  # a chunk is two blocks, so chunks overlap by half
LAGS = range(2, 25)
SEGMENT = 1 << 15  # bytes convolved at once, a multiple of BLOCK


def _bytes(text: str | bytes | None) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b"", np.uint8)
    return np.concatenate([raw, np.zeros(WIDTH, np.uint8)]) if len(raw) < WIDTH else raw


class ByteCNN:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.head = rng.normal(0, 0.1, 2 * FILTERS + 2).astype(np.float64)
        self.bias = 0.0

    def blocks(self, b: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Maximum response of every filter in every block, and the place that gave it."""
        n = len(b) - WIDTH + 1
        tops, places = [], []
        for s in range(0, n, SEGMENT):
            m = min(SEGMENT, n - s)
            r = self.table[0][b[s : s + m]]
            for k in range(1, WIDTH):
                r += self.table[k][b[s + k : s + k + m]]
            starts = np.arange(0, m, BLOCK)
            tops.append(np.maximum.reduceat(r, starts, axis=0))
            if where:
                for a in starts.tolist():
                    places.append(r[a : a + BLOCK].argmax(axis=0) + (s + a))
        return np.concatenate(tops), np.array(places) if where else None

    @staticmethod
    def loops(b: np.ndarray, n_blocks: int) -> np.ndarray:
        """The strongest self-similarity of every block over all lags."""
        best = np.zeros(n_blocks)
        size = np.full(n_blocks, BLOCK, float)
        size[-1] = max(1, len(b) - (n_blocks - 1) * BLOCK)
        for lag in LAGS:
            if len(b) <= lag:
                break
            same = np.zeros(n_blocks * BLOCK + BLOCK, np.uint8)
            same[lag : len(b)] = b[lag:] == b[:-lag]
            share = same[: n_blocks * BLOCK].reshape(n_blocks, BLOCK).sum(axis=1, dtype=np.int64) / size
            np.maximum(best, share, out=best)
        return np.minimum(best, 1.0)

    def features(self, b: np.ndarray, where: bool = False):
        tops, places = self.blocks(b, where)
        rep = self.loops(b, len(tops))
        if len(tops) > 1:
            chunk = np.maximum(tops[:-1], tops[1:])
            rep = (rep[:-1] + rep[1:]) / 2
        else:
            chunk = tops
        act = np.tanh(chunk)
        f = np.concatenate([act.mean(axis=0), act.max(axis=0), [rep.mean(), rep.max()]])
        return f, (tops, places, chunk, act)

    def score(self, text: str | bytes | None) -> float:
        f, _ = self.features(_bytes(text))
        z = float(f @ self.head + self.bias)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def _back(self, b: np.ndarray, state, up: np.ndarray, grad: np.ndarray) -> None:
        """Add the filters' gradient for one document; ``up`` is that of the features."""
        tops, places, chunk, act = state
        slope = 1 - act**2
        g = slope * up[:FILTERS] / len(chunk)
        which = act.argmax(axis=0)
        cols = np.arange(FILTERS)
        g[which, cols] += slope[which, cols] * up[FILTERS : 2 * FILTERS]
        rows = np.arange(len(chunk))[:, None]
        block = rows + (tops[1:] > tops[:-1]) if len(tops) > 1 else np.zeros((1, FILTERS), int)
        at = places[block, cols]
        for k in range(WIDTH):
            np.add.at(grad[k], (b[at + k], np.broadcast_to(cols, at.shape)), g)

    def fit(self, rows: list[tuple[str, int]], epochs: int = 5, batch: int = 32, rate: float = 0.02, seed: int = 3) -> "ByteCNN":
        rng = np.random.default_rng(seed)
        data = [(_bytes(t), y) for t, y in rows]
        y = np.array([v for _, v in data], float)
        if not len(y) or y.min() == y.max():
            share = (y.sum() + 0.5) / (len(y) + 1)
            self.head[:] = 0
            self.bias = float(np.log(share / (1 - share)))
            return self
        weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
        m1, m2 = np.zeros_like(self.table), np.zeros_like(self.table)
        h1, h2 = np.zeros(len(self.head) + 1), np.zeros(len(self.head) + 1)
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(data))
            for s in range(0, len(order), batch):
                step += 1
                gt, gh = np.zeros_like(self.table), np.zeros(len(self.head) + 1)
                for i in order[s : s + batch].tolist():
                    b = data[i][0]
                    f, state = self.features(b, True)
                    p = 1 / (1 + np.exp(-np.clip(f @ self.head + self.bias, -30, 30)))
                    d = weight[i] * (p - y[i]) / batch
                    gh += d * np.append(f, 1.0)
                    self._back(b, state, d * self.head, gt)
                gt += 1e-4 * self.table
                gh[:-1] += 1e-3 * self.head
                fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                m1, m2 = 0.9 * m1 + 0.1 * gt, 0.999 * m2 + 0.001 * gt * gt
                h1, h2 = 0.9 * h1 + 0.1 * gh, 0.999 * h2 + 0.001 * gh * gh
                self.table -= (rate * fix * m1 / (np.sqrt(m2) + 1e-8)).astype(np.float32)
                move = 2 * rate * fix * h1 / (np.sqrt(h2) + 1e-8)
                self.head -= move[:-1]
                self.bias -= float(move[-1])
        # the training weighted both classes alike: shift the bias back to their real odds
        self.bias += float(np.log(y.mean() / (1 - y.mean())))
        return self


def balanced(rows: list[tuple[str, int]], most: int) -> list[tuple[str, int]]:
    """At most ``most`` rows of each class, copies once, in the given order."""
    out, seen, count = [], set(), {0: 0, 1: 0}
    for text, y in rows:
        if count[y] < most and text not in seen:
            seen.add(text)
            count[y] += 1
            out.append((text, y))
    return out


def fit_on(table: DataFrame, most: int) -> ByteCNN:
    """The network of a training table, trained by one task on an executor."""
    return learn(table, lambda rows: ByteCNN().fit(balanced(pairs_of(rows), most)))


def score_documents(docs: DataFrame, model: ByteCNN, *, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and predicted of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            score = np.fromiter((model.score(raw) for raw in raw_texts(batch.column("text"))), float, batch.num_rows)
            return {"doc_id": batch.column("doc_id"), "score": pa.array(score), "predicted": pa.array((score >= threshold).astype("int32"))}

        return work

    return by_arrow(rows, f"doc_id {kind}, score double, predicted int", make)

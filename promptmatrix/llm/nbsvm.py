"""Quality classifier: naive Bayes log-count ratios under a linear hinge-loss model.

A text is the set of its hashed byte n-grams (1 to 4 bytes) word n-grams
(one and two words) and echo n-grams (up to four consecutive words that each
equal the word one to four places before), as indicators.  Each indicator is scaled by the log ratio
of its smoothed class frequencies; dual coordinate descent fits the hinge-loss
weights; a logistic curve over the margins gives scores from 0 to 1.

The model is fitted on at most ``rows`` labelled documents (a bounded sample by
a hash of the id); scoring is one narrow pass over whole texts.  Defined
results: a null or empty text has the score of the bias alone; repeated rows
are scored each; other columns are ignored; with one class or no labels every
score is the smoothed share of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptmatrix.llm import textkit as tk
from promptmatrix.llm.session import bounded_batches, bounded_sample, labelled, lean, sampled_texts

#: Labelled documents that the model is fitted on and bytes of their texts, at most, and the places that n-grams are hashed to.
SAMPLE_ROWS, SAMPLE_BYTES, BUCKETS = 4096, 24 << 20, 1 << 18


@dataclass
class Model:
    weight: np.ndarray
    ratio: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, sets: list[np.ndarray]) -> np.ndarray:
        out = np.empty(len(sets))
        for i, s in enumerate(sets):
            norm = np.sqrt(np.dot(self.ratio[s], self.ratio[s]))
            out[i] = self.bias + (self.weight[s].sum() / norm if norm else 0.0)
        return 1 / (1 + np.exp(-np.clip(self.slope * out + self.shift, -40, 40)))


def indicators(c: tk.Chunk) -> list[np.ndarray]:
    """Of each document in the chunk, the sorted buckets of its n-grams."""
    mask = np.uint32(BUCKETS - 1)
    d = c.data.astype(np.uint32) + np.uint32(1)
    orders = []
    code = np.zeros(len(d), np.uint32)
    for k in range(1, 5):
        if len(d) >= k:
            code = code[: len(d) - k + 1] * np.uint32(0x01000193) + d[k - 1 :]
            orders.append(((code * np.uint32(0x9E3779B1)) ^ np.uint32(k * 0x51ED27)) >> np.uint32(14) & mask)
    w = tk.find_words(c)
    h = tk.word_hashes(c.data, w.start, w.end)
    one, two = (h >> np.uint64(20)).astype(np.uint32) & mask, (tk.grams(h, 2) >> np.uint64(20)).astype(np.uint32) & mask
    echoes = []
    for lag in range(1, 5):
        same = np.zeros(len(h), bool)
        same[lag:] = (h[lag:] == h[:-lag]) & (w.doc[lag:] == w.doc[:-lag])
        run = same.copy()
        for length in range(1, 5):
            echoes.append((int(tk.mix64(np.array([lag * 8 + length], np.uint64))[0] & np.uint64(mask)), np.concatenate([[0], np.cumsum(run)])))
            run = same & np.concatenate([[False], run[:-1]])
    mark, out = np.zeros(BUCKETS, bool), []
    for i in range(c.n):
        a, b = c.off[i], c.off[i + 1]
        for k, codes in enumerate(orders):
            mark[codes[a : max(a, b - k)]] = True
        a, b = w.cut[i], w.cut[i + 1]
        mark[one[a:b]] = True
        mark[two[a : max(a, b - 1)]] = True
        for bucket, total in echoes:
            if total[b] > total[a]:
                mark[bucket] = True
        s = np.flatnonzero(mark).astype(np.int32)
        mark[s] = False
        out.append(s)
    return out


def descend(sets: list[np.ndarray], ratio: np.ndarray, y: np.ndarray, cost: float = 1.0, rounds: int = 12) -> tuple[np.ndarray, float, np.ndarray]:
    """Dual coordinate descent for the L2-regularised hinge loss; returns weights over scaled indicators, bias and margins."""
    w, bias, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(sets))
    scale = [ratio[s] / max(np.linalg.norm(ratio[s]), 1e-12) for s in sets]
    square = np.array([np.dot(x, x) + 1.0 for x in scale])
    random = np.random.default_rng(7)
    for _ in range(rounds):
        moved = 0.0
        for i in random.permutation(len(sets)):
            s, x = sets[i], scale[i]
            gradient = y[i] * (np.dot(w[s], x) + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost)
            step = (new - alpha[i]) * y[i]
            if step:
                w[s] += step * x
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias, np.array([np.dot(w[s], x) + bias for s, x in zip(sets, scale, strict=True)])


def train(sets: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> Model:
    share = (y.sum() + 0.5) / (len(y) + 1)
    flat = Model(np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0, float(np.log(share / (1 - share))))
    if not 0 < y.sum() < len(y):
        return flat
    good, bad = np.full(BUCKETS, smooth), np.full(BUCKETS, smooth)
    for s, label in zip(sets, y, strict=True):
        (good if label else bad)[s] += 1
    ratio = np.log(good / (y.sum() + 2 * smooth)) - np.log(bad / (len(y) - y.sum() + 2 * smooth))
    ratio[(good == smooth) & (bad == smooth)] = 0.0
    w, bias, margin = descend(sets, ratio, np.where(y > 0, 1.0, -1.0))
    a, b = 1.0, 0.0
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40)))
        g = np.array([np.dot(target - p, margin), (target - p).sum()])
        v = p * (1 - p) + 1e-9
        hess = np.array([[np.dot(v, margin**2) + 1e-6, np.dot(v, margin)], [np.dot(v, margin), v.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(hess, g), -2, 2)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-6:
            break
    return Model(w * ratio, ratio, bias, a, b)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> Model:
    """Fits on labelled documents for which ``learn`` (over the label rows) holds, ``rows`` at most; their indicator sets come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in tk.chunks(b.column(2)):
                yield pa.RecordBatch.from_arrays([b.column(0)[c.first : c.first + c.n], b.column(1)[c.first : c.first + c.n], pa.array([s.tobytes() for s in indicators(c)], pa.binary())], ["id", "y", "s"])

    chosen = bounded_sample(labelled(labels.where(learn), label, id_col), rows)
    texts = sampled_texts(docs, chosen, SAMPLE_BYTES, id_col, text_col).select("id", "y", F.col("t").cast("string").alias("t"))
    got = texts.mapInArrow(lean(run), "id long, y int, s binary").toArrow()
    order = np.argsort(got["id"].to_numpy(), kind="stable")
    sets = [np.frombuffer(s, np.int32) for s in got["s"].to_pylist()]
    return train([sets[i] for i in order], got["y"].to_numpy()[order].astype(float))


def apply(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``score`` (0 to 1) and ``predicted`` of every document."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in tk.chunks(b.column(1)):
                p = shared.value.score(indicators(c))
                yield pa.RecordBatch.from_arrays([b.column(0)[c.first : c.first + c.n], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [id_col, "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    return rows.mapInArrow(lean(run), f"`{id_col}` long, score double, predicted int")

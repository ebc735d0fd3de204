"""Toxicity by compression distance: two zstandard dictionaries, one for each class.

A dictionary is trained on words of toxic texts (those that are, or hold a
prefix, far more frequent in toxic than in ordinary texts) and one on words of
ordinary texts.  Each window of a text is compressed with both; the difference of the
lengths is the window's distance.  A window is one lower-cased word between
boundary marks, behind a fixed carrier that both dictionaries end with: the
carrier keeps every block compressible, so the difference is what the word
alone gains.  (Windows of 3 to 12 words were tried; neighbouring words drown
the gain.)  Logistic thresholds over a text's distances, fitted on the same
bounded sample, give the score.

Defined results: a null or empty text has the score of a text whose only
window has distance 0; repeated rows are scored each; other columns are
ignored; with one class or no labels every score is the smoothed share of
label 1.
"""

from __future__ import annotations

import gc
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptmatrix.llm import textkit as tk
from promptmatrix.llm.session import bounded_batches, bounded_sample, labelled, lean, sampled_texts

#: Labelled documents that dictionaries and thresholds are fitted on, and bytes of their texts, at most.
SAMPLE_ROWS, SAMPLE_BYTES = 8192, 64 << 20
ORDINARY_BYTES, TOXIC_BYTES, LEVEL = 32 << 10, 4 << 10, 19
#: Prefixes of 4 to 11 bytes and whole words count; toxic words hold or are one that is found in so many toxic texts (a whole word, in so many) and whose log odds exceed this.
PREFIXES, LEAST_TEXTS, LEAST_WHOLE, LEAST_ODDS = range(4, 12), 4, 16, 3.0

_MARK = b" \x01\x02"
_END = b" "
_CARRIER = bytes(range(3, 9)) + bytes(range(14, 32))
_LOW, _HIGH = -12, 20
_CACHE_WORDS = 1 << 19


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    center: np.ndarray
    scale: np.ndarray
    weight: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.center) / self.scale) @ self.weight[:-1] + self.weight[-1]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Distances:
    """Distances of words, remembered by hash (nine bytes a word) up to a fixed number of words."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.tools = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d + _CARRIER, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False) for d in (ordinary, toxic)]
        self.names, self.known = np.zeros(0, np.uint64), np.zeros(0, np.int8)

    def of(self, word: bytes) -> int:
        window = _CARRIER + _MARK + word + _MARK
        a, b = (len(t.compress(window)) for t in self.tools)
        return max(_LOW, min(_HIGH, a - b))

    def histograms(self, c: tk.Chunk) -> np.ndarray:
        """For each document, how many of its windows have each distance."""
        data = tk.LOWER[c.data]
        w = tk.find_words(c)
        h = tk.word_hashes(data, w.start, w.end)
        keys, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.names) > _CACHE_WORDS:
            self.names, self.known = self.names[:0], self.known[:0]
        new = np.flatnonzero(~np.isin(keys, self.names, assume_unique=True))
        if len(new):
            raw, at = data.tobytes(), first[new]
            fresh = np.array([self.of(raw[a:b]) for a, b in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)], np.int8)
            place = np.searchsorted(self.names, keys[new])
            self.names, self.known = np.insert(self.names, place, keys[new]), np.insert(self.known, place, fresh)
        got = self.known[np.searchsorted(self.names, keys)].astype(np.int64)
        width = _HIGH - _LOW + 1
        out = np.bincount(w.doc * width + got[inverse] - _LOW, minlength=c.n * width).reshape(c.n, width)
        out[np.diff(w.cut) == 0, -_LOW] = 1
        return out


def features(hist: np.ndarray) -> np.ndarray:
    """Of each text: its largest distances, how many and which share of its windows reach each distance, and its length."""
    levels = np.arange(_LOW, _HIGH + 1)
    n = np.maximum(hist.sum(1), 1)
    above = hist[:, ::-1].cumsum(1)[:, ::-1]
    top = [levels[len(levels) - 1 - np.argmax(hist[:, ::-1].cumsum(1) >= k, 1)].astype(float) for k in (1, 2, 3)]
    top = [np.where(n >= k, t, 0.0) for k, t in zip((1, 2, 3), top, strict=True)]
    x = [top[0], (top[0] + top[1] + top[2]) / 3]
    x += [np.log1p(above[:, k - _LOW]) for k in range(2, 11)]
    x += [np.log(above[:, k - _LOW] / n + 1e-3) for k in range(2, 9)]
    x += [np.log((hist * np.exp(0.5 * levels)).sum(1) / n + 1e-9), np.log(n)]
    return np.stack(x, 1)


def _dictionary(words: Counter, size: int) -> bytes:
    spelled = [_MARK + w + _MARK for w in sorted(words)]
    times = np.minimum(np.array([words[w] for w in sorted(words)], np.int64), 300)
    samples = [spelled[i] for i in np.random.default_rng(1).permutation(np.repeat(np.arange(len(spelled)), times))[:400_000]]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: the most frequent words as they are, the best last
        return b"".join(_MARK + w for w, _ in sorted(words.items(), key=lambda x: (x[1], x[0])))[-size:]


def train(texts: list[bytes], y: np.ndarray) -> Model:
    share = (y.sum() + 0.5) / (len(y) + 1)
    k = features(np.zeros((1, _HIGH - _LOW + 1))).shape[1]
    flat = Model(b"", b"", np.zeros(k), np.ones(k), np.append(np.zeros(k), np.log(share / (1 - share))))
    if not 0 < y.sum() < len(y):
        return flat
    low = tk.LOWER.tobytes()
    bags = lambda label: (set(t.translate(low).split()) for t, x in zip(texts, y, strict=True) if x == label)
    prefix = lambda bag: {w[:p] for w in bag for p in PREFIXES if len(w) > p} | {w + _END for w in bag}
    toxic: Counter = Counter()
    for bag in bags(1):
        toxic.update(prefix(bag))
    toxic = Counter({g: n for g, n in toxic.items() if n >= (LEAST_WHOLE if g.endswith(_END) else LEAST_TEXTS)})
    plain: Counter = Counter()
    seen = np.zeros(1 << 22, np.uint8)  # texts by a hash of the word, two at most: words of one text only are most of all, and not needed
    for bag in bags(0):
        plain.update(prefix(bag) & toxic.keys())
        at = np.fromiter({zlib.crc32(w) & len(seen) - 1 for w in bag}, np.int64)
        seen[at] = np.minimum(seen[at] + 1, 2)
    odds = lambda g: np.log((toxic[g] + 0.5) / (y.sum() + 1)) - np.log((plain[g] + 0.5) / (len(y) - y.sum() + 1))
    marked = {g for g in toxic if odds(g) > LEAST_ODDS}
    words: tuple[Counter, Counter] = (Counter(), Counter())
    for bag in bags(1):
        words[1].update(w for w in bag if w + _END in marked or any(w[:p] in marked for p in PREFIXES if len(w) > p))
    for bag in bags(0):
        words[0].update(w for w in bag if seen[zlib.crc32(w) & len(seen) - 1] > 1)
    model = Model(_dictionary(Counter({w: n for w, n in words[0].items() if n > 1}), ORDINARY_BYTES), _dictionary(words[1], TOXIC_BYTES), flat.center, flat.scale, flat.weight)
    tool = Distances(model.ordinary, model.toxic)
    x = features(np.concatenate([tool.histograms(c) for c in tk.chunks(pa.array(texts, pa.binary()).cast(pa.large_binary()))]))
    model.center, model.scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - model.center) / model.scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve((z.T * (p * (1 - p))) @ z + np.eye(len(w)), z.T @ (y - p) - w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    model.weight = w
    return model


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> Model:
    """Fits on at most ``rows`` labelled documents for which ``learn`` (over the label rows) holds; their texts, SAMPLE_BYTES at most, come to the driver."""
    chosen = bounded_sample(labelled(labels.where(learn), label, id_col), rows)
    got = sampled_texts(docs, chosen, SAMPLE_BYTES, id_col, text_col).toArrow()
    order = np.argsort(got["id"].to_numpy(), kind="stable")
    texts, y = got["t"].to_pylist(), got["y"].to_numpy()[order].astype(float)
    del got
    model = train([texts[i] for i in order], y)
    del texts
    gc.collect()
    pa.default_memory_pool().release_unused()
    return model


def scorer(docs: DataFrame, model: Model):
    """A function from a string column of a batch to the scores of its texts; what it knows of words lasts for the task."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        tool = Distances(shared.value.ordinary, shared.value.toxic)
        return lambda column: np.concatenate([shared.value.score(features(tool.histograms(c))) for c in tk.chunks(column)] or [np.zeros(0)])

    return make


def apply(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``score`` (0 to 1) and ``predicted`` of every document."""
    make = scorer(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make()
        for b in batches:
            p = score(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [id_col, "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    return rows.mapInArrow(lean(run), f"`{id_col}` long, score double, predicted int")


def keep_ordinary(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text is not predicted toxic."""
    make, place = scorer(docs, model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make()
        for b in batches:
            yield b.filter(pa.array(score(b.column(place).cast(pa.string())) < 0.5))

    return docs.mapInArrow(lean(run), docs.schema)

"""Quality rules: document statistics judged by fixed limits and by boosted trees.

``statistics`` computes the statistics of whole texts in one narrow pass,
``fit`` grows monotonically constrained trees on a bounded sample of labelled
rows, and ``apply`` gives every document its statistics and verdict.

Defined results: a null or empty text has no words and fails the base rule;
repeated rows are judged each; columns other than the id and the text are
ignored, so clashing names do no harm; without usable labels the trees are a
constant that keeps what passes the base rule.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptmatrix.llm import gbt
from promptmatrix.llm import textkit as tk
from promptmatrix.llm.session import bounded_batches, bounded_sample, labelled, lean

#: Labelled rows that the trees are fitted on, at most.
SAMPLE_ROWS = 8192
#: A text with fewer words fails, as does one with a larger share (in hundredths) of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "upper", "bars", "shouts", "lines", "distinct", "digits", "stops")
#: The score must not rise with symbols, duplicate lines or repeated windows, nor fall with length.
MONOTONE = np.array([1, 0, -1, -1, -1, 0, 0, 0, 0, 0, 0, 0])

_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_UPPER = np.isin(np.arange(256), np.arange(65, 91))
_DIGIT = np.isin(np.arange(256), np.arange(48, 58))
_BAR = np.arange(256) == ord("|")
_SHOUT = np.arange(256) == ord("!")


def _per_doc(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def _repeated(key: np.ndarray) -> np.ndarray:
    """True where a key occurs twice or more."""
    if not len(key):
        return np.zeros(0, bool)
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = k[1:] == k[:-1]
    twice = np.zeros(len(k), bool)
    twice[1:] |= same
    twice[:-1] |= same
    out = np.empty(len(k), bool)
    out[order] = twice
    return out


def measure(c: tk.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """The five base counts and the features of each document of a chunk."""
    w = tk.find_words(c)
    h = tk.word_hashes(c.data, w.start, w.end)
    n_words = np.diff(w.cut)
    word_chars = _per_doc(tk.LEAD[c.data] & ~tk.WHITE[c.data], c.off)
    n_symbols = _per_doc(_SYMBOL[c.data], c.off)

    brk = np.union1d(np.flatnonzero(c.data == 10) + 1, c.off[:-1])
    brk = brk[brk < len(c.data)]
    stop = np.append(brk[1:], len(c.data))
    stop = np.where((stop > 0) & (c.data[np.maximum(stop - 1, 0)] == 10), stop - 1, stop) if len(brk) else stop
    holds = np.searchsorted(w.start, stop) > np.searchsorted(w.start, brk)
    brk, stop = brk[holds], stop[holds]
    line_doc = np.searchsorted(c.off, brk, "right") - 1
    line = tk.mix64(tk.word_hashes(c.data, brk, stop) + line_doc.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    n_lines = np.bincount(line_doc, minlength=c.n)
    _, first = np.unique(line, return_index=True)
    n_dup_lines = n_lines - np.bincount(line_doc[first], minlength=c.n)

    salt = w.doc.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    at = np.flatnonzero(tk.spans(w.cut, 3))
    twice = at[_repeated(tk.mix64(tk.grams(h, 3)[at] + salt[at]))]
    covered = np.zeros(len(h), bool)
    for i in range(3):
        covered[twice + i] = True
    n_repeat = np.bincount(w.doc[covered], minlength=c.n)

    _, first = np.unique(tk.mix64(h + salt), return_index=True)
    distinct = np.bincount(w.doc[first], minlength=c.n)
    stops = np.bincount(w.doc[np.isin(c.data[w.end - 1], list(b".?!"))], minlength=c.n) if len(h) else np.zeros(c.n)
    base = np.stack([n_words, word_chars, n_symbols, n_dup_lines, n_repeat], 1).astype(np.int64)
    words, chars = np.maximum(n_words, 1), np.maximum(word_chars, 1)
    x = [np.log1p(n_words), word_chars / words, n_symbols / words, n_dup_lines / np.maximum(n_lines, 1), n_repeat / words, _per_doc(_UPPER[c.data], c.off) / chars, _per_doc(_BAR[c.data], c.off) / words, _per_doc(_SHOUT[c.data], c.off) / words, n_lines / words, distinct / words, _per_doc(_DIGIT[c.data], c.off) / chars, stops / words]
    return base, np.stack(x, 1)


def _features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in tk.chunks(b.column(2)):
                _, x = measure(c)
                yield pa.RecordBatch.from_arrays([b.column(0)[c.first : c.first + c.n], b.column(1)[c.first : c.first + c.n], pa.array(list(x), pa.list_(pa.float64()))], ["id", "y", "x"])

    return docs.select("id", "y", F.col(text_col).cast("string").alias("t")).mapInArrow(lean(run), "id long, y int, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> gbt.Forest:
    """Trees fitted on at most ``rows`` labelled documents, whose features (not texts) come to the driver."""
    chosen = bounded_sample(labelled(labels, label), rows)
    joined = docs.select(F.col(id_col).alias("id"), text_col).join(F.broadcast(chosen), "id")
    got = _features(joined, id_col, text_col).groupBy("id").agg(F.first("y").alias("y"), F.min("x").alias("x")).toArrow()  # an id with several texts: one of them
    order = np.argsort(got["id"].to_numpy(), kind="stable")
    x = np.array(got["x"].to_pylist(), float).reshape(-1, len(FEATURES))[order]
    return gbt.fit(x, got["y"].to_numpy()[order].astype(float), MONOTONE)


def apply(docs: DataFrame, forest: gbt.Forest, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """Each document's base counts, ``base_failed``, the trees' ``score`` and ``kept``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in tk.chunks(b.column(1)):
                base, x = measure(c)
                failed = (base[:, 0] < LEAST_WORDS) | (100 * base[:, 4] > MOST_REPEATED * base[:, 0])
                score = forest.probability(x)
                yield pa.RecordBatch.from_arrays([b.column(0)[c.first : c.first + c.n], *(pa.array(base[:, i]) for i in range(5)), pa.array(failed), pa.array(score), pa.array(~failed & (score >= least))], [id_col, *BASE, "base_failed", "score", "kept"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    return rows.mapInArrow(lean(run), f"`{id_col}` long, {', '.join(f'{b} long' for b in BASE)}, base_failed boolean, score double, kept boolean")

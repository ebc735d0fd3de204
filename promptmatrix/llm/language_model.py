"""Language-model scoring: corpus counts and a log-bilinear model trained by noise-contrastive estimation.

Tokens are words with A-Z lower-cased and one end a document.  Spark counts
every word of all learning documents.  The model has two levels.  The outputs
of the first are the end, the most frequent words and 128 word shapes; the
score of an output after (x, y) is (r_x * c_1 + r_y * c_2) . u + b.  A rarer
word has the probability of its shape times that of the word among the words of
its shape after x, scored by s_x . v + a over the next most frequent words and
one place for all that are rarer still; there it has its share of the counts,
add-one smoothed.

Training is numpy alone: minibatches with shared noise words, AdaGrad, every
task over its part of the learning documents.  In each of four rounds, one
over each of four slices, the tasks go on from the averages of parameters and
of AdaGrad's sums, so every learning document trains the model once.  The
normalisers, of all pairs of context outputs and of all shapes after a context
output, are batches of matrix products on the driver; scoring is then table
lookups and one short product a rare word, and probabilities add up to one
exactly.

Counts of the most frequent words (a fixed number) are broadcast; the rest are
joined, so nothing that grows with the corpus comes to the driver.

Defined results: a null or empty text is its end alone; repeated rows are
scored and counted each; rows with a null id are learned from; with nothing to
learn from all words are unknown; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptmatrix.llm import textkit as tk
from promptmatrix.llm.session import bounded_batches, checkpointed, lean

#: Words that are outputs of the first level, dimensions of its vectors, words whose counts are broadcast.
WORDS, WIDTH, HEAD = 511, 24, 1 << 18
#: Words that the second level tells apart within their shapes, at most, and dimensions of its vectors.
INNER, INNER_WIDTH = 16384, 12
#: Learning documents are cut into so many slices by a hash of the id; each round learns from one, and there are as many rounds as slices.
SLICES = 4
#: Packed models that one task averages, about.
FAN = 16
_BATCH, _NOISE, _INNER_NOISE, _RATE = 4096, 48, 4, 0.08
_END = np.uint64(0x5851F42D4C957F2D)
_SHAPES = 128

# Last bytes of Latin letters that set languages apart, and signs that words end with.
_GERMAN, _SPANISH = np.isin(np.arange(256), [0xA4, 0xB6, 0xBC, 0x9F]), np.isin(np.arange(256), [0xB1, 0xAD, 0xB3, 0xA1, 0xBA])
_WIDE = np.arange(256) == 0xC3
_LAST = np.full(256, 7)
_LAST[np.arange(97, 123)] = 0
_LAST[np.arange(128, 256)] = 1
for _byte, _kind in zip(b".,!|", (2, 3, 4, 5), strict=True):
    _LAST[_byte] = _kind
_LAST[list(b"#$%&*")] = 6


def tokens(c: tk.Chunk) -> tuple[tk.Words, np.ndarray, np.ndarray]:
    """Words of a chunk, their lower-case hashes and shapes."""
    data = tk.LOWER[c.data]
    w = tk.find_words(c)
    h = tk.word_hashes(data, w.start, w.end)

    def holds(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int32)])
        return total[w.end] > total[w.start]

    after = np.zeros(len(data), bool)
    after[1:] = _WIDE[data[:-1]]
    tongue = np.where(holds(after & _GERMAN[data]), 1, np.where(holds(after & _SPANISH[data]), 2, np.where(holds(_WIDE[data]), 3, 0)))
    size = np.searchsorted([4, 7, 11], w.end - w.start, "right")
    return w, h, ((_LAST[data[w.end - 1]] * 4 + tongue) * 4 + size).astype(np.int64) if len(h) else np.zeros(0, np.int64)


def count(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """How often each word (and the end) occurs, with its shape: name, shape, c."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, n = [], 0
            for c in tk.chunks(b.column(0)):
                _, h, shape = tokens(c)
                names, first, times = np.unique(h, return_index=True, return_counts=True)
                parts.append((names, shape[first], times))
                n += c.n
            if not parts:
                continue
            names, shape, times = (np.concatenate(x) for x in zip(*parts, strict=True))
            names, first, which = np.unique(names, return_index=True, return_inverse=True)
            total = np.bincount(which, times, len(names)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(names, _END).view(np.int64)), pa.array(np.append(shape[first], -1).astype(np.int32)), pa.array(np.append(total, n))], ["name", "shape", "c"])

    return docs.select(F.col(text_col).cast("string")).mapInArrow(lean(run), "name long, shape int, c long").groupBy("name").agg(F.min("shape").alias("shape"), F.sum("c").alias("c"))


@dataclass
class Lexicon:
    """The most frequent words in order of name: their counts and outputs.

    Output 0 is the end, then words, then shapes.  The words of the second
    level lie in order of their shapes, ``inner_cut[s]`` to ``inner_cut[s + 1]``
    of shape s, the last of each for all rarer words; ``inner`` is a word's
    place there, or -1, and ``inner_freq`` its count, smoothed.
    """

    names: np.ndarray
    counts: np.ndarray
    output: np.ndarray
    inner: np.ndarray
    inner_cut: np.ndarray
    inner_freq: np.ndarray
    ends: int
    total: int
    distinct: int
    words: int

    @property
    def size(self) -> int:
        return 1 + self.words + _SHAPES

    def look(self, h: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Outputs, places in the second level (of no meaning for words of the first) and counts of words; -1 for words whose count is not here."""
        rest = self.inner_cut[shape + 1] - 1
        if not len(self.names):
            return 1 + self.words + shape, rest, np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.names, h), len(self.names) - 1)
        here = self.names[at] == h
        out, place = np.where(here, self.output[at], -1), np.where(here, self.inner[at], -1)
        return np.where(out >= 0, out, 1 + self.words + shape), np.where(place >= 0, place, rest), np.where(here, self.counts[at], -1)


def lexicon(counts: DataFrame, words: int = WORDS, inner_words: int = INNER) -> Lexicon:
    """The words of the highest sixteenths of an octave of counts that hold HEAD words at most together."""
    word = F.col("shape") >= 0
    step = F.floor(F.log2("c") * 16).cast("int")
    least, held = None, 0
    for at, n in sorted(counts.where(word).groupBy(step.alias("at")).agg(F.count("*").alias("n")).collect(), reverse=True):
        if held + n > HEAD:
            break
        least, held = at, held + n
    frequent = counts.where(word & (step >= least)) if least is not None else counts.where(word).orderBy(F.desc("c"), "name").limit(words)
    head = frequent.toArrow()
    names, c, shape = head["name"].to_numpy().view(np.uint64), head["c"].to_numpy(), head["shape"].to_numpy()
    total, distinct, ends = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(~word, F.col("c"))), F.lit(0))).first()
    rest = np.ones(_SHAPES)  # of the words that neither level names: counts, one more for each, and one for all words never seen
    for s, n, k in counts.where(word).groupBy("shape").agg(F.sum("c"), F.count("*")).collect():
        rest[s] += n + k
    rank = np.lexsort((names, -c))
    output, inner = np.full(len(names), -1), np.full(len(names), -1)
    top, next_ = rank[:words], rank[words : words + inner_words]
    output[top] = 1 + np.arange(len(top))
    named = rank[: words + inner_words]
    np.subtract.at(rest, shape[named], c[named] + 1.0)
    # the second level: words by shape, then the place for the rest of the shape
    place_shape = np.concatenate([shape[next_], np.arange(_SHAPES)])
    order = np.lexsort((np.arange(len(place_shape)), place_shape))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    inner[next_] = place[: len(next_)]
    inner_cut = np.searchsorted(place_shape[order], np.arange(_SHAPES + 1))
    inner_freq = np.concatenate([c[next_] + 1.0, rest])[order]
    by_name = np.argsort(names)
    return Lexicon(names[by_name], c[by_name], output[by_name], inner[by_name], inner_cut, inner_freq, int(ends), int(total), int(distinct), words)


@dataclass
class Parameters:
    """First level: context, scale, target, bias.  Second: inner_context, inner, inner_bias."""

    context: np.ndarray
    scale: np.ndarray
    target: np.ndarray
    bias: np.ndarray
    inner_context: np.ndarray
    inner: np.ndarray
    inner_bias: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [self.context, self.scale, self.target, self.bias, self.inner_context, self.inner, self.inner_bias]

    def pack(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.arrays()]).astype(np.float32)

    @staticmethod
    def unpack(flat: np.ndarray, lex: Lexicon) -> Parameters:
        n, m = lex.size, len(lex.inner_freq)
        shapes = [(n, WIDTH), (2, WIDTH), (n, WIDTH), (n,), (n, INNER_WIDTH), (m, INNER_WIDTH), (m,)]
        ends = np.cumsum([int(np.prod(x)) for x in shapes])
        return Parameters(*(part.reshape(x).copy() for part, x in zip(np.split(flat, ends[:-1]), shapes, strict=True)))


def start(lex: Lexicon) -> Parameters:
    """Small vectors and the log frequencies of outputs, and of words within their shapes, as biases: the unigram model."""
    random = np.random.default_rng(3)
    small = lambda *shape: (random.standard_normal(shape) * 0.1).astype(np.float32)
    return Parameters(small(lex.size, WIDTH), np.ones((2, WIDTH), np.float32), small(lex.size, WIDTH), np.log(noise(lex)).astype(np.float32), small(lex.size, INNER_WIDTH), small(len(lex.inner_freq), INNER_WIDTH), np.log(inner_noise(lex)).astype(np.float32))


def noise(lex: Lexicon) -> np.ndarray:
    """The distribution of outputs in the learning documents, each with one added."""
    freq = np.ones(lex.size)
    freq[0] += lex.ends
    known = lex.output >= 0
    freq[lex.output[known]] += lex.counts[known]
    freq[1 + lex.words :] += np.add.reduceat(lex.inner_freq, lex.inner_cut[:-1]) - 1
    return freq / freq.sum()


def inner_noise(lex: Lexicon) -> np.ndarray:
    """The distribution of words within each shape."""
    size = np.diff(lex.inner_cut)
    return lex.inner_freq / np.repeat(np.add.reduceat(lex.inner_freq, lex.inner_cut[:-1]), size)


def _sums(ids: np.ndarray, gradient: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids and the sums of their gradients."""
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    cut = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    return ids[cut], np.add.reduceat(gradient[order], cut, axis=0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Trainer:
    """Noise-contrastive estimation over minibatches: a token against noise words shared by the batch, a rare word against noise of its shape."""

    def __init__(self, p: Parameters, sums: Parameters, lex: Lexicon, seed: int):
        freq, inner = noise(lex), inner_noise(lex)
        self.p, self.log_noise, self.inner_log_noise = p, np.log(freq * _NOISE).astype(np.float32), np.log(inner * _INNER_NOISE).astype(np.float32)
        self.draw, self.random = np.cumsum(freq), np.random.default_rng(seed)
        self.inner_draw, self.inner_low, self.inner_cut = np.cumsum(inner), np.arange(_SHAPES), lex.inner_cut  # each shape's words add up to one
        self.sums, self.arrays = sums.arrays(), p.arrays()
        self.words, self.seen = lex.words, 0

    def _move(self, which: int, rows, gradient: np.ndarray) -> None:
        moved = self.sums[which][rows] + gradient**2
        self.sums[which][rows] = moved
        self.arrays[which][rows] += _RATE * gradient / np.sqrt(moved)

    def step(self, w: np.ndarray, x: np.ndarray, y: np.ndarray, place: np.ndarray) -> None:
        p, root = self.p, np.sqrt(np.float32(len(w)))
        self.seen += len(w)
        other = np.minimum(np.searchsorted(self.draw, self.random.random(_NOISE)), len(self.draw) - 1)
        rx, ry, u, v = p.context[x], p.context[y], p.target[w], p.target[other]
        q = rx * p.scale[0] + ry * p.scale[1]
        good = 1 - _sigmoid((q * u).sum(1) + p.bias[w] - self.log_noise[w])
        bad = -_sigmoid(q @ v.T + p.bias[other] - self.log_noise[other])
        dq = good[:, None] * u + bad @ v
        both = np.concatenate([x, y])
        moves = [(2, *_sums(w, good[:, None] * q)), (3, *_sums(w, good)), (0, *_sums(both, np.concatenate([dq * p.scale[0], dq * p.scale[1]]))), (2, *_sums(other, bad.T @ q)), (3, *_sums(other, bad.sum(0)))]
        rare = np.flatnonzero(w > self.words)
        if len(rare):
            shape, x2, i = w[rare] - 1 - self.words, x[rare], place[rare]
            drawn = np.searchsorted(self.inner_draw, self.inner_low[:, None] + self.random.random((_SHAPES, _INNER_NOISE)))
            drawn = np.clip(drawn, self.inner_cut[:-1, None], self.inner_cut[1:, None] - 1)  # noise of each shape, shared by the batch
            d = drawn[shape]
            r, t, n = p.inner_context[x2], p.inner[i], p.inner[drawn][shape]
            up = 1 - _sigmoid((r * t).sum(1) + p.inner_bias[i] - self.inner_log_noise[i])
            down = -_sigmoid(np.einsum("ij,ikj->ik", r, n) + p.inner_bias[d] - self.inner_log_noise[d])
            dr = up[:, None] * t + np.einsum("ik,ikj->ij", down, n)
            which, far = _sums(shape, np.concatenate([(down[:, :, None] * r[:, None, :]).reshape(len(r), -1), down], axis=1))
            ids = drawn[which].ravel()
            vectors, flat = far[:, : _INNER_NOISE * INNER_WIDTH].reshape(-1, INNER_WIDTH), far[:, _INNER_NOISE * INNER_WIDTH :].ravel()
            near, mine = _sums(i, np.concatenate([up[:, None] * r, up[:, None]], axis=1))
            moves += [(4, *_sums(x2, dr)), (5, near, mine[:, :-1]), (6, near, mine[:, -1]), (5, *_sums(ids, vectors)), (6, *_sums(ids, flat))]
        scale = np.stack([(dq * rx).sum(0), (dq * ry).sum(0)])
        for array, rows, gradient in [*moves, (1, slice(None), scale)]:
            self._move(array, rows, gradient / root)


@dataclass
class Sequence:
    """Of all tokens of a chunk, ends included: output, the two outputs before, place in the second level, count (-1: not here), and where documents begin."""

    w: np.ndarray
    x: np.ndarray
    y: np.ndarray
    place: np.ndarray
    times: np.ndarray
    cut: np.ndarray
    words: tk.Words
    names: np.ndarray


def sequences(c: tk.Chunk, lex: Lexicon) -> Sequence:
    w, h, shape = tokens(c)
    out, inner, times = lex.look(h, shape)
    cut = w.cut + np.arange(c.n + 1)
    seq, place, known = np.zeros(len(h) + c.n, np.int64), np.zeros(len(h) + c.n, np.int64), np.full(len(h) + c.n, lex.ends)
    at = np.arange(len(h)) + w.doc
    seq[at], place[at], known[at] = out, inner, times
    one, two = np.zeros_like(seq), np.zeros_like(seq)
    one[1:] = seq[:-1]
    two[2:] = np.where(seq[1:-1] == 0, 0, seq[:-2])
    return Sequence(seq, one, two, place, known, cut, w, h)


def _mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The weighted mean of packed parameters."""
    total, weight = None, 0.0
    for b in batches:
        for blob, n in zip(b.column(0), b.column(1).to_pylist(), strict=True):
            part = np.frombuffer(blob.as_buffer(), np.float32) * np.float64(n)
            total, weight = part if total is None else np.add(total, part, out=total), weight + n
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([(total / weight).astype(np.float32).tobytes()], pa.binary()), pa.array([weight])], ["p", "n"])


def train(docs: DataFrame, lex: Lexicon, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> Parameters:
    sc = docs.sparkSession.sparkContext
    shared, current = sc.broadcast(lex), start(lex).pack()
    half = len(current)
    current = np.append(current, np.full(half, 1e-2, np.float32))  # parameters, then AdaGrad's sums: steps go on shrinking from round to round
    slice_of = F.pmod(F.xxhash64(F.lit("slice"), F.col(id_col), F.octet_length(F.col(text_col).cast("string"))), F.lit(SLICES))
    for turn in range(SLICES):
        sent = sc.broadcast(current)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, turn=turn) -> Iterator[pa.RecordBatch]:
            flat, lex = sent.value, shared.value
            trainer = Trainer(Parameters.unpack(flat[:half], lex), Parameters.unpack(flat[half:], lex), lex, 11 + turn)
            for b in batches:
                for c in tk.chunks(b.column(0)):
                    s = sequences(c, lex)
                    order = trainer.random.permutation(len(s.w))
                    for i in range(0, len(order), _BATCH):
                        at = order[i : i + _BATCH]
                        trainer.step(s.w[at], s.x[at], s.y[at], s.place[at])
            if trainer.seen:
                sums = np.concatenate([x.ravel() for x in trainer.sums])
                yield pa.RecordBatch.from_arrays([pa.array([np.append(trainer.p.pack(), sums).astype(np.float32).tobytes()], pa.binary()), pa.array([float(trainer.seen)])], ["p", "n"])

        parts = docs.where(learn & (slice_of == turn)).select(F.col(text_col).cast("string")).mapInArrow(lean(run), "p binary, n double")
        n = parts.rdd.getNumPartitions()
        while n > 1:  # a tree of means: a task reads about FAN of them, however many tasks train
            n = -(-n // FAN)
            parts = parts.repartition(n).mapInArrow(lean(_mean), "p binary, n double")
        got = parts.toArrow()
        if got.num_rows:
            current = np.frombuffer(got["p"][0].as_py(), np.float32).copy()
        sent.unpersist()
    return Parameters.unpack(current[:half], lex)


@dataclass
class Tables:
    """Log10 scores of an output after each context, and the log10 normaliser of each pair of contexts; the same of the second level, by shape and context."""

    near: np.ndarray
    far: np.ndarray
    bias: np.ndarray
    normal: np.ndarray
    inner_context: np.ndarray
    inner: np.ndarray
    inner_bias: np.ndarray
    inner_normal: np.ndarray

    def inner_score(self, place: np.ndarray, shape: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The log10 probabilities of words of the second level within their shapes."""
        return np.einsum("ij,ij->i", self.inner_context[x], self.inner[place]) + self.inner_bias[place] - self.inner_normal[shape, x]


def tables(p: Parameters, lex: Lexicon) -> Tables:
    near, far = (p.context * p.scale[0]) @ p.target.T, (p.context * p.scale[1]) @ p.target.T
    normal = np.empty_like(near)
    for i in range(len(near)):
        z = far + (near[i] + p.bias)
        top = z.max(1)
        normal[i] = top + np.log(np.exp(z - top[:, None]).sum(1))
    inner_normal = np.empty((_SHAPES, len(near)), np.float32)
    for s, (a, b) in enumerate(zip(lex.inner_cut[:-1], lex.inner_cut[1:], strict=True)):
        z = p.inner_context @ p.inner[a:b].T + p.inner_bias[a:b]
        top = z.max(1)
        inner_normal[s] = top + np.log(np.exp(z - top[:, None]).sum(1))
    k = np.float32(np.log10(np.e))
    return Tables(near * k, far * k, p.bias * k, normal * k, p.inner_context * k, p.inner, p.inner_bias * k, inner_normal * k)


def score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, inner_words: int = INNER) -> DataFrame:
    """Counts, trains and scores: n_tokens, n_known, train_tokens, base_score and score of every document."""
    bounded_batches(docs.sparkSession)
    counts = checkpointed(count(docs.where(learn), text_col))
    lex = lexicon(counts, words, inner_words)
    t = tables(train(docs, lex, learn, id_col, text_col), lex)
    shared = docs.sparkSession.sparkContext.broadcast((lex, t))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, t = shared.value
        rest_place = lex.inner_cut[1:] - 1
        inside = np.log10(lex.inner_freq[rest_place])
        for b in batches:
            for c in tk.chunks(b.column(2)):
                q = sequences(c, lex)
                w, x, y, times, cut, word, h = q.w, q.x, q.y, q.times, q.cut, q.words, q.names
                model = t.near[x, w].astype(float) + t.far[y, w] + t.bias[w] - t.normal[x, y]
                plain = np.where(times >= 0, np.log10(times.clip(0) + 1.0), 0.0)
                rare = np.flatnonzero(w > lex.words)
                shape, place = w[rare] - 1 - lex.words, q.place[rare]
                model[rare] += t.inner_score(place, shape, x[rare])
                last = place == rest_place[shape]
                model[rare[last]] += plain[rare[last]] - inside[shape[last]]
                add = lambda v: np.add.reduceat(v, cut[:-1])  # noqa: B023, E731
                missing = np.flatnonzero(times[np.arange(len(h)) + word.doc] < 0)
                key = np.lexsort((h[missing], word.doc[missing]))
                names, owner = h[missing][key], word.doc[missing][key]
                first = np.ones(len(names), bool)
                first[1:] = (names[1:] != names[:-1]) | (owner[1:] != owner[:-1])
                at = np.flatnonzero(first)
                ends = pa.array(np.searchsorted(owner[at], np.arange(c.n + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[c.first : c.first + c.n], b.column(1)[c.first : c.first + c.n], pa.array(np.diff(cut)), pa.array(add((times > 0).astype(np.int64))), pa.array(add(plain)), pa.array(add(model)),
                     pa.ListArray.from_arrays(ends, pa.array(names[at].view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(np.diff(np.append(at, len(names))).astype(np.int32)))],
                    ["row", "id", "n", "known", "plain", "model", "names", "times"],
                )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    scored = checkpointed(rows.mapInArrow(lean(run), "row long, id long, n long, known long, plain double, model double, names array<long>, times array<int>"))
    tail = scored.select("row", F.explode(F.arrays_zip("names", "times")).alias("z")).select("row", F.col("z.names").alias("name"), F.col("z.times").alias("k"))
    found = tail.join(counts.select("name", "c"), "name").groupBy("row").agg(F.sum("k").alias("more"), F.sum(F.col("k") * F.log10(F.col("c") + F.lit(1.0))).alias("rest"))
    rest = F.coalesce("rest", F.lit(0.0))
    floor = float(np.log10(lex.total + lex.distinct + 1.0))
    return scored.join(found, "row", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(lex.total).cast("long").alias("train_tokens"),
        (F.col("plain") + rest - F.col("n") * F.lit(floor)).alias("base_score"), (F.col("model") + rest).alias("score"),
    )

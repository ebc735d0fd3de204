"""Alignment of two tokenizers over the same bytes.

Every document is encoded by both: A over space and text, B over the text, to
which it adds the space itself.  The byte places where tokens end are marked in
packed bitsets; the bitwise AND of the two has a bit where both end.  Popcounts
give rank and select: select lists the shared places, rank turns each into the
number of tokens of either side that end before it.  So the shared places cut
both sequences into groups that cover the same bytes.  A link is a pair of
tokens, one of each side, whose byte ranges end together: the last of A and the
last of B in each group.

How often each pair of ids is linked in the whole corpus is counted from the
distinct pairs of each document.  A document then needs the counts of its own
pairs.  The most frequent pairs, at most HOT of them whatever the corpus, are
broadcast; all others, none of which is frequent any more, are joined by
shuffling.

Texts are worked on a slice at a time, cut at single spaces between other
characters, where tokens of both sides begin.

Defined results: null and empty texts, and those whose bytes one side does not
give back (as a text with U+2581, which B reads as a space), have no tokens:
zeros and an empty string.  Strings of special tokens are plain text.  Repeated
rows and ids count and are returned each; null ids too; columns of other names
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptmatrix.llm.byte_bpe import FOLDER, PATTERN, slices
from promptmatrix.llm.session import bounded_batches, lean, stored

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
MARK = "▁"
#: Characters of text aligned at once, and pairs whose counts are broadcast at most.
BLOCK, HOT = 1 << 20, 1 << 18


@dataclass
class Tokens:
    """The bytes of each id of one side, laid end to end."""

    raw: list[bytes]

    def __post_init__(self) -> None:
        self.size = np.array([len(r) for r in self.raw], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(self.raw), np.uint8)

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        end = np.cumsum(size)
        return self.flat[np.repeat(self.at[ids] - end + size, size) + np.arange(end[-1] if len(end) else 0)]


def byte_of_character() -> dict[str, int]:
    """The characters that stand for bytes in files of byte-level vocabularies: printable ones for themselves, the others in order from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteSide:
    """Side A: a byte-level BPE file whose ids are the ranks of its merges."""

    def __init__(self, file: str):
        import tiktoken

        with open(file, encoding="utf-8") as f:
            model = json.load(f)["model"]
        of = byte_of_character()
        ranks = {bytes(of[c] for c in token): n for token, n in model["vocab"].items() if all(c in of for c in token)}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        order = [model["vocab"]["".join(m)] for m in merges]
        if order != sorted(order):
            raise ValueError(f"{file}: ids do not follow the order of the merges")
        raw = [b""] * (max(ranks.values()) + 1)
        for token, n in ranks.items():
            raw[n] = token
        self.tokens = Tokens(raw)
        self.encode = tiktoken.Encoding("side-a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class PieceSide:
    """Side B: a sentence-piece model that adds a space before a text."""

    def __init__(self, file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=file)
        raw = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if MARK in piece.lstrip(MARK):
                raise ValueError(f"{file}: {piece!r} crosses the beginning of a word")
            raw.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else piece.replace(MARK, " ").encode())
        self.tokens = Tokens(raw)
        self.encode = lambda texts: model.encode(texts, num_threads=1)


class Ends:
    """Places in a run of bytes as packed bits, with counts of the bits before each word."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def at(cls, places: np.ndarray, size: int) -> Ends:
        marks = np.zeros(-(-(size + 1) // 64) * 64, bool)
        marks[places] = True
        return cls(np.packbits(marks, bitorder="little").view(np.uint64))

    def __and__(self, other: Ends) -> Ends:
        return Ends(self.words & other.words)

    def select(self) -> np.ndarray:
        """The places, in order."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))

    def rank(self, places: np.ndarray) -> np.ndarray:
        """How many bits are at or before each place."""
        word, bit = places >> 6, (places & 63).astype(np.uint64)
        below = self.words[word] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(63) - bit))
        return self.before[word] + np.bitwise_count(below)


class Aligner:
    """Both sides, and the alignment of whole blocks of texts."""

    def __init__(self, a: ByteSide, b: PieceSide):
        self.a, self.b = a, b
        self.n_a, self.n_b = len(a.tokens.raw), len(b.tokens.raw)
        self.signs = Tokens([b"%d%c" % (i, s) for s in b",|" for i in range(self.n_a)] + [b"%d%c" % (i, s) for s in b",;" for i in range(self.n_b)])

    def block(self, parts: list[str]) -> Iterator[tuple[int, int, np.ndarray, bytes] | None]:
        """For each part (a text, or a slice without the space before it): tokens of A and of B, its links as numbers, its groups as text, each ending in a semicolon; None if the bytes differ."""
        ids_a = [self.a.encode(" " + p) for p in parts]
        ids_b = self.b.encode(parts)
        n_a, n_b = (np.array([len(x) for x in side], np.int64) for side in (ids_a, ids_b))
        a, b = (np.fromiter((i for x in side for i in x), np.int64, int(n.sum())) for side, n in ((ids_a, n_a), (ids_b, n_b)))
        raw_a, raw_b = self.a.tokens.spelled(a), self.b.tokens.spelled(b)
        cut_a, cut_b = (np.concatenate([[0], np.cumsum(n)]) for n in (n_a, n_b))
        end_a, end_b = (np.concatenate([[0], np.cumsum(t.size[x])]) for t, x in ((self.a.tokens, a), (self.b.tokens, b)))
        wanted = [b" " + p.encode() for p in parts]
        if raw_a.tobytes() != (whole := b"".join(wanted)) or raw_b.tobytes() != whole or (end_a[cut_a] != end_b[cut_b]).any():
            if len(parts) == 1:
                yield None
                return
            for p in parts:  # one of them differs: each alone
                yield from self.block([p])
            return
        ends_a, ends_b = Ends.at(end_a[1:] - 1, len(raw_a)), Ends.at(end_b[1:] - 1, len(raw_b))
        shared = (ends_a & ends_b).select()
        last_a, last_b = ends_a.rank(shared), ends_b.rank(shared)  # tokens that end up to each shared place
        links = a[last_a - 1] * self.n_b + b[last_b - 1]
        sign_a, sign_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        sign_a[last_a - 1], sign_b[last_b - 1] = 1, 1
        # In the text the tokens of A of a group come before those of B: behind a token of A stand the groups of B before its own.
        size_a, size_b = np.diff(last_a, prepend=0), np.diff(last_b, prepend=0)
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.repeat(last_b - size_b, size_a)] = sign_a * self.n_a + a
        order[np.arange(len(b)) + np.repeat(last_a, size_b)] = 2 * self.n_a + sign_b * self.n_b + b
        text = self.signs.spelled(order).tobytes()
        at = np.concatenate([[0], np.cumsum(self.signs.size[order])])[cut_a + cut_b]
        group = np.searchsorted(last_a, cut_a, "right")  # every part ends at a shared place
        for i in range(len(parts)):
            yield int(n_a[i]), int(n_b[i]), links[group[i] : group[i + 1]], text[at[i] : at[i + 1]]

    def documents(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, str, np.ndarray, np.ndarray]]:
        """For each text: tokens of A, of B, groups, the hash of the groups, distinct links and how often each."""
        pending: list[tuple[int, str]] = []
        size, state = 0, _Open()
        none = (0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))
        for i, text in enumerate([*texts, None]):
            last = i == len(texts)
            parts = [p if n == 0 else p[1:] for n, p in enumerate(slices(text, BLOCK, spaces=True))] if text else []
            for p in [*parts, None]:
                if p is not None:
                    pending.append((i, p))
                    size += len(p)
                if (size >= BLOCK or (last and p is None)) and pending:
                    for (j, _), found in zip(pending, self.block([p for _, p in pending]), strict=True):
                        yield from state.moved(j, none)
                        state.add(found)
                    pending, size = [], 0
        yield from state.moved(len(texts), none)


class _Open:
    """The document whose parts are being added up."""

    def __init__(self) -> None:
        self.at, self.parts = 0, []

    def add(self, part: tuple[int, int, np.ndarray, bytes] | None) -> None:
        self.parts.append(part)

    def moved(self, to: int, none: tuple) -> Iterator[tuple]:
        """The documents before ``to``: the one that was open, and those without parts."""
        if to > self.at:
            yield self._done() if self.parts and all(p is not None for p in self.parts) else none
            yield from (none for _ in range(self.at + 1, to))
            self.at, self.parts = to, []

    def _done(self) -> tuple:
        digest = hashlib.sha256()
        for k, (_, _, _, text) in enumerate(self.parts):
            digest.update(text[:-1] if k == len(self.parts) - 1 else text)
        pairs, times = np.unique(np.concatenate([p[2] for p in self.parts]), return_counts=True)
        return sum(p[0] for p in self.parts), sum(p[1] for p in self.parts), int(times.sum()), digest.hexdigest(), pairs, times


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = FOLDER) -> DataFrame:
    """``row`` (a number of its own), the id, n_a, n_b, n_groups, groups_sha256, and the distinct linked pairs of ids with how often each."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(ByteSide(os.path.join(folder, A_FILE)), PieceSide(os.path.join(folder, B_FILE)))
        for b in batches:
            rows = list(aligner.documents(b.column(1).to_pylist()))
            n_a, n_b, groups, sha, pairs, times = zip(*rows, strict=True) if rows else ([],) * 6
            cut = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in pairs])]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cut, pa.array(np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64))) for x in (pairs, times)]
            counts = [pa.array(x, pa.int64()) for x in (n_a, n_b, groups)]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array(sha, pa.string()), *lists], [id_col, "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times"])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    out = rows.mapInArrow(lean(run), f"`{id_col}` long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<long>")
    return out.withColumn("row", F.monotonically_increasing_id())


def pair_counts(links: DataFrame, n_b: int) -> tuple[DataFrame, Callable[[], None]]:
    """Of every linked pair of ids (pair, n): how often it is linked (count), and whether no other link of its B id is more frequent (best)."""
    counts = links.groupBy("pair").agg(F.sum("n").alias("count"))
    counts, drop = stored(counts)
    most = counts.groupBy((F.col("pair") % n_b).alias("b")).agg(F.max("count").alias("most"))  # a row an id of B
    out = counts.withColumn("b", F.col("pair") % n_b).join(F.broadcast(most), "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    found = stored(out)
    drop()
    return found


def least_of_hot(counts: DataFrame, limit: int) -> int:
    """The least count whose pairs, with all more frequent ones, are no more than ``limit``: from a histogram of counts, eight steps a doubling."""
    step = F.floor(F.log2("count") * 8).cast("int")
    sizes = dict(counts.groupBy(step.alias("step")).agg(F.struct(F.count("*").alias("n"), F.min("count").alias("least")).alias("s")).collect())
    least, total = 1 << 62, 0
    for _, s in sorted(sizes.items(), reverse=True):
        total += s["n"]
        if total > limit:
            break
        least = s["least"]
    return least


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = FOLDER, hot: int = HOT) -> DataFrame:
    """Per document its tokens, groups and links, and how its links stand in the whole corpus."""
    rows, drop_rows = stored(aligned(docs, id_col, text_col, folder))
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("row", F.col("l.pairs").alias("pair"), F.col("l.times").alias("n"))
    counts, drop_counts = pair_counts(links, len(PieceSide(os.path.join(folder, B_FILE)).tokens.raw))
    least = least_of_hot(counts, hot)
    sums = (F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    frequent, rare = counts.where(F.col("count") >= least), counts.where(F.col("count") < least)
    of_frequent = links.join(F.broadcast(frequent), "pair").groupBy("row").agg(*sums)
    of_rare = links.join(F.broadcast(frequent.select("pair")), "pair", "left_anti").join(rare, "pair").groupBy("row").agg(*sums)
    whole = of_frequent.unionByName(of_rare).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    none = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_best", "count_sum")}
    joined = rows.drop("pairs", "times").join(whole, "row", "left").withColumns(none)
    out, _ = stored(joined.select(id_col, "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256"))
    drop_rows()
    drop_counts()
    return out

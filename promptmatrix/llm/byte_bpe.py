"""Byte-level BPE encoding and decoding by dynamic programming over byte prefixes.

A text is cut into pieces by the pattern of its vocabulary, and each piece is
encoded alone.  For every byte prefix of a piece there is exactly one token
that can end its encoding: the one that ends there, whose own bytes the merges
join, and that can stand behind the last token of the prefix before it without
the merges having joined across the seam.  ``Prefixes`` keeps that token for
every prefix.  Walking back from the end gives the encoding; appending bytes
only adds prefixes, so the new pieces of a block are taken in order and each
goes on from the prefix that it shares with the one before; an edit goes back to the prefixes before it and stops as
soon as the new last tokens meet the old ones again, for as many bytes as the
longest token has.  A piece that is itself a token is that token, whatever the
merges say, as in the library.

Pieces that a task has seen are kept up to KNOWN_PIECES.  A text is cut into
slices at white space that follows other characters, where a piece always
begins, so a text of any length costs memory of a slice besides its ids.

Defined results: null and empty texts have no ids; texts are encoded each,
repeated or not; bytes that are no UTF-8 read as U+FFFD; other columns are
ignored; ids outside the vocabulary decode to nothing; a null array decodes to
no bytes.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptmatrix.llm.session import bounded_batches, lean

FOLDER = "/opt/tokenizers"
RANKS = "byte_bpe_multi_50k.tiktoken"
#: The pattern that cuts a text before merges (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces whose ids a task keeps, the longest of them in characters, pairs of tokens it keeps, and characters of a slice and of the slices worked on at once.
KNOWN_PIECES, KNOWN_LENGTH, KNOWN_PAIRS, SLICE, BLOCK = 1 << 19, 64, 1 << 20, 1 << 18, 1 << 21
_NEVER = 1 << 60
#: Bytes at the end of a prefix that say how long the tokens ending there can be.
ENDS = 4


@dataclass
class Vocabulary:
    """Tokens as strings of bytes (one character a byte) with their ranks, which are their ids, and the halves of each by its last merge."""

    rank: dict[str, int]
    halves: dict[int, tuple[int, int] | None] = field(default_factory=dict)  # None: a single byte; missing: the merges do not make it
    pattern: str = PATTERN

    def __post_init__(self) -> None:
        self.raw = {n: t.encode("latin-1") for t, n in self.rank.items()}
        if not self.halves:
            for token, n in self.rank.items():
                parts, last = merged(token, self.rank)
                if len(parts) == 1:
                    self.halves[n] = (self.rank[last[0]], self.rank[last[1]]) if last else None


def merged(piece: str, rank: dict[str, int]) -> tuple[list[str], tuple[str, str] | None]:
    """The merges themselves, lowest rank first and leftmost among equals, and the last of them."""
    parts, n = list(piece), len(piece)
    before, after, last = list(range(-1, n - 1)), list(range(1, n + 1)), None
    waiting = [(rank[p], i, len(p)) for i in range(n - 1) if (p := piece[i : i + 2]) in rank]
    heapq.heapify(waiting)
    while waiting:
        _, i, size = heapq.heappop(waiting)
        j = after[i]
        if not parts[i] or j >= n or len(parts[i]) + len(parts[j]) != size:
            continue  # one of the two has been merged since
        last = (parts[i], parts[j])
        parts[i], parts[j] = parts[i] + parts[j], ""
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and (whole := parts[a] + parts[b]) in rank:
                heapq.heappush(waiting, (rank[whole], a, len(whole)))
    return [p for p in parts if p], last


def load(name: str = RANKS, folder: str = FOLDER) -> Vocabulary:
    """Reads a file of ranks on the driver: a bounded table that is sent to the executors."""
    with open(os.path.join(folder, name), "rb") as lines:
        pairs = (line.split() for line in lines if line.strip())
        return Vocabulary({base64.b64decode(token).decode("latin-1"): int(rank) for token, rank in pairs})


class Coder:
    """What a task knows of a vocabulary: which tokens may follow each other, and the ids of the pieces it has met."""

    def __init__(self, words: Vocabulary):
        self.rank, self.halves, self.raw = words.rank, words.halves, words.raw
        self.split = regex.compile(words.pattern).findall
        self.size = max(self.rank.values(), default=0) + 1
        self.longest = max(map(len, self.rank), default=1)
        self.reach: dict[str, int] = {}  # the longest token with this end of ENDS bytes; without one, none is as long as that
        self.made = {t: n for t, n in self.rank.items() if n in self.halves}
        for t in self.made:
            if len(t) >= ENDS:
                self.reach[t[-ENDS:]] = max(len(t), self.reach.get(t[-ENDS:], 0))
        self.fits: dict[int, bool] = {}
        self.ends: dict[tuple[int, int], tuple[list[int], list[str]]] = {}
        self.known: dict[str, list[int]] = {}

    def _edge(self, token: int, side: int) -> tuple[list[int], list[str]]:
        """What stands at the left (0) or right (1) end of a token as its merges go on: a byte first, the token last; ids (and what never comes), and texts."""
        found = self.ends.get((token, side))
        if found is None:
            ids = [token]
            while (halves := self.halves[ids[-1]]) is not None:
                ids.append(halves[side])
            ids.reverse()
            found = self.ends[token, side] = ([*ids, _NEVER], [self.raw[i].decode("latin-1") for i in ids])
        return found

    def may_follow(self, one: int, two: int) -> bool:
        """Whether the merges over the bytes of two tokens end with just these two.

        A merge across the seam happens if it ranks before the next growth of
        both forms at the seam; on equal rank the one further left is first.
        """
        (left, left_text), (right, right_text), rank = self._edge(one, 1), self._edge(two, 0), self.rank
        i = j = 0
        known = True
        while True:
            grow, own = left[i + 1], right[j + 1]
            across = rank.get(left_text[i] + right_text[j])
            if across is not None and across < grow and across <= own:
                known = False
                break
            if grow <= own:
                if grow == _NEVER:
                    break
                i += 1
            else:
                j += 1
        if len(self.fits) >= KNOWN_PAIRS:
            self.fits.clear()
        self.fits[one * self.size + two] = known
        return known

    def last_token(self, piece: str, end: int, last: list[int | None]) -> int | None:
        """The one token that ends the encoding of ``piece[:end]``, given those of all shorter prefixes."""
        made, fits, size, follow = self.made, self.fits, self.size, self.may_follow
        most = self.reach.get(piece[end - ENDS : end], ENDS - 1) if end >= ENDS else end
        for start in range(end - most if end > most else 0, end):
            token = made.get(piece[start:end])
            if token is None:
                continue
            if not start:
                return token
            prior = last[start]
            if prior is None:
                continue
            fit = fits.get(prior * size + token)
            if follow(prior, token) if fit is None else fit:
                return token
        return None

    def learn(self, pieces: Iterable[str]) -> None:
        """Finds the ids of pieces, in the order of their bytes: a piece goes on from the prefix that it shares with the one before."""
        known, rank, open_ = self.known, self.rank, Prefixes(self)
        for raw, p in sorted((p.encode("utf-8", "replace").decode("latin-1"), p) for p in pieces):
            whole = rank.get(raw)
            if whole is not None:
                known[p] = [whole]
                continue
            same, most = 0, min(len(raw), len(open_.piece))
            while same < most and raw[same] == open_.piece[same]:
                same += 1
            known[p] = open_.cut(same).append(raw[same:]).ids()

    def block(self, parts: list[str]) -> list[list[int]]:
        """The ids of each of some slices of texts."""
        cut, known = [self.split(p) for p in parts], self.known
        new = {p for p in set().union(*cut) if p not in known}
        if len(known) + len(new) > KNOWN_PIECES:
            known.clear()
            new = set().union(*cut)
        self.learn(new)
        out = [[i for p in pieces for i in known[p]] for pieces in cut]
        for p in new:
            if len(p) > KNOWN_LENGTH:
                del known[p]
        return out

    def ids(self, text: str) -> Iterator[list[int]]:
        """The ids of a text, a slice at a time."""
        for part in slices(text):
            yield self.block([part])[0]


class Prefixes:
    """A piece with the last token of each of its byte prefixes; it can grow and be edited."""

    def __init__(self, coder: Coder, piece: str = ""):
        self.coder, self.piece = coder, ""
        self.last: list[int | None] = [None]
        self.append(piece)

    def cut(self, size: int) -> Prefixes:
        """Keeps the first bytes."""
        self.piece = self.piece[:size]
        del self.last[size + 1 :]
        return self

    def append(self, more: str) -> Prefixes:
        """Adds bytes at the end; what is known of the prefixes stays."""
        self.piece += more
        for end in range(len(self.last), len(self.piece) + 1):
            self.last.append(self.coder.last_token(self.piece, end, self.last))
        return self

    def edit(self, at: int, removed: int, put: str) -> int:
        """Replaces ``removed`` bytes at a place; returns how many prefixes had to be found anew.

        A last token depends on the bytes and last tokens of the longest
        token's length before it: once that many in a row are the old ones, so
        are all behind them.
        """
        old, tail = self.last, len(self.piece) - at - removed
        self.piece = self.piece[:at] + put + self.piece[at + removed :]
        self.last = old[: at + 1]
        same = done = 0
        while len(self.last) <= len(self.piece):
            end = len(self.last)
            behind = end - at - len(put)  # bytes of the old tail that this prefix holds
            if behind > self.coder.longest and same >= self.coder.longest:
                self.last += old[len(old) - tail - 1 + behind :]
                break
            token = self.coder.last_token(self.piece, end, self.last)
            same = same + 1 if behind > 0 and token == old[len(old) - tail - 1 + behind] else 0
            self.last.append(token)
            done += 1
        return done

    def ids(self) -> list[int]:
        out, at = [], len(self.piece)
        while at:
            token = self.last[at]
            if token is None:  # a vocabulary in which a token ranks before its own halves: the merges decide
                return [self.coder.rank[p] for p in merged(self.piece, self.coder.rank)[0]]
            out.append(token)
            at -= len(self.coder.raw[token])
        out.reverse()
        return out


def slices(text: str, size: int = SLICE, spaces: bool = False) -> Iterator[str]:
    """Cuts a text before a single white space (``spaces``: a space) between other characters: a piece begins there in any case."""
    found = _SPACE if spaces else _BREAK
    at = 0
    while len(text) - at > size:
        cut = next((m.start() for m in found.finditer(text, at + size)), len(text))
        yield text[at:cut]
        at = cut
    if at < len(text):
        yield text[at:]


_BREAK, _SPACE = regex.compile(r"(?<=[^\s])[ \n](?=[^\s])"), regex.compile(r"(?<=[^\s▁]) (?=[^\s▁])")


def blocks(texts: pa.Array) -> Iterator[tuple[list[int], list[str]]]:
    """Slices of texts, a block of about BLOCK characters at a time, each with the row of its text."""
    rows: list[int] = []
    parts: list[str] = []
    size = 0
    for row, text in enumerate(texts):
        for part in slices(text.as_py() or ""):
            rows.append(row)
            parts.append(part)
            size += len(part)
            if size >= BLOCK:
                yield rows, parts
                rows, parts, size = [], [], 0
    if parts:
        yield rows, parts


class Speller:
    """Bytes of ids, of many texts at once."""

    def __init__(self, words: Vocabulary):
        n = max(words.raw, default=-1) + 1
        spelled = [words.raw.get(i, b"") for i in range(n)] + [b""]
        self.size = np.array([len(s) for s in spelled], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)

    def block(self, ids: np.ndarray) -> bytes:
        own = np.where((ids >= 0) & (ids < len(self.size) - 1), ids, len(self.size) - 1)
        size = self.size[own]
        end = np.cumsum(size)
        return self.bytes[np.repeat(self.at[own] - end + size, size) + np.arange(end[-1] if len(end) else 0)].tobytes()

    def text(self, ids: Iterable[int | None] | None) -> bytes:
        known = [i for i in ids if i is not None] if ids is not None else []
        return b"".join(self.block(np.array(known[x : x + (1 << 17)], np.int64)) for x in range(0, len(known), 1 << 17))


def encode(docs: DataFrame, words: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, ``ids`` and ``n_tokens`` of every document."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for b in batches:
            flat, count = [np.zeros(0, np.int32)], np.zeros(b.num_rows, np.int64)
            for rows, parts in blocks(b.column(1)):
                for row, ids in zip(rows, coder.block(parts), strict=True):
                    flat.append(np.array(ids, np.int32))
                    count[row] += len(ids)
            cut = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count), pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate(flat)))], [id_col, "n_tokens", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    return rows.mapInArrow(lean(run), f"`{id_col}` long, n_tokens long, ids array<int>")


def decode(coded: DataFrame, words: Vocabulary, ids_col: str = "ids", as_col: str = "decoded") -> DataFrame:
    """The same rows with the bytes of their ids."""
    bounded_batches(coded.sparkSession)
    shared = coded.sparkSession.sparkContext.broadcast(words)
    kept = [c for c in coded.columns if c != as_col]
    place = kept.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = Speller(shared.value)
        for b in batches:
            lists = b.column(place)
            flat = np.asarray(lists.values.fill_null(-1)) if len(lists) else np.zeros(0, np.int32)
            at = lists.offsets.to_numpy()
            full = lists.is_valid().to_numpy(zero_copy_only=False)
            texts = [b"".join(speller.block(flat[x : min(x + (1 << 17), j)]) for x in range(i, j, 1 << 17)) if ok else b"" for i, j, ok in zip(at[:-1].tolist(), at[1:].tolist(), full.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.binary())], [*b.schema.names, as_col])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.select(*kept).schema.fields)
    return coded.select(*kept).mapInArrow(lean(run), f"{fields}, `{as_col}` binary")


def digests(docs: DataFrame, words: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What tells two encodings apart: tokens, and SHA-256 of the decimal ids and of the bytes they decode to."""
    coded = decode(encode(docs, words, id_col, text_col), words)
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return coded.select(id_col, "n_tokens", F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


__all__ = ["PATTERN", "Coder", "Prefixes", "Speller", "Vocabulary", "decode", "digests", "encode", "load", "slices"]

"""Vectorised text primitives over Arrow string buffers.

Every function works on the UTF-8 bytes of many documents at once, so the cost
of a document is a few numpy passes over its bytes and no Python object per
word.  A *word* is a maximal run of characters other than space, tab, line
feed, vertical tab, form feed and carriage return; those six are single bytes
in UTF-8, so splitting bytes is splitting characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 20
_SEGMENT = 1 << 18

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: True for bytes that begin a code point.
LEAD = np.array([(b & 0xC0) != 0x80 for b in range(256)])

_M = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A random code for each byte at each of 64 places of a word.
_CODES = mix64(np.arange(1, 64 * 256 + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


@dataclass
class Chunk:
    """Documents ``first``..``first + len(off) - 2`` of a batch: their bytes and where each begins."""

    first: int
    data: np.ndarray
    off: np.ndarray

    @property
    def n(self) -> int:
        return len(self.off) - 1

    def text(self, i: int) -> str:
        return self.data[self.off[i] : self.off[i + 1]].tobytes().decode("utf-8", "replace")


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cuts a string column into runs of whole documents; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if len(column) == 0:
        return
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, values = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        j = min(j, len(column))
        yield Chunk(i, data[off[i] : off[j]], off[i : j + 1] - off[i])
        i = j


@dataclass
class Words:
    """Where the words of a chunk are: byte ranges, and for document i the words cut[i]..cut[i+1]."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    cut: np.ndarray


def find_words(c: Chunk) -> Words:
    inside = ~WHITE[c.data]
    first, last = inside.copy(), inside.copy()
    if len(inside) > 1:
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
    if len(inside):
        at = c.off[:-1][c.off[:-1] < len(inside)]
        first[at] = inside[at]
        at = c.off[1:][c.off[1:] > 0] - 1
        last[at] = inside[at]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    cut = np.searchsorted(start, c.off)
    return Words(start, end, np.repeat(np.arange(c.n), np.diff(cut)), cut)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range (in order, not overlapping): a sum of random codes of byte and place, scrambled with the length."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + _SEGMENT, "right")))
        a, b = int(start[i]), int(end[j - 1])
        total = np.zeros(b - a + 1, np.uint64)
        for x in range(a, b, _SEGMENT):  # one long word is many segments
            y = min(b, x + _SEGMENT)
            if x == a:
                first = np.append(start[i:j], b)
                place = np.arange(x, y) - np.repeat(first[:-1], np.diff(first))[: y - x]
            else:
                place = np.arange(x, y) - start[j - 1]
            code = _CODES[(place & 63) << 8 | data[x:y]]
            far = np.flatnonzero(place > 63)
            if len(far):
                code[far] = mix64(code[far] + (place[far] >> 6).astype(np.uint64) * np.uint64(_BASE))
            np.cumsum(code, out=total[x - a + 1 : y - a + 1])
            total[x - a + 1 : y - a + 1] += total[x - a]
        out[i:j] = total[end[i:j] - a] - total[start[i:j] - a]
        i = j
    return mix64(out + (end - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def grams(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of the k consecutive symbols that start at each place; the last k - 1 places are left out."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factor = np.uint64((0x9FB21C651E98DF25 + 2 * seed * 0x632BE59BD9B4E019) & _M | 1)
    out = np.full(n, np.uint64(seed + k))
    for i in range(k):
        out *= factor
        out += h[i : i + n]
        if i & 3 == 3:
            out = mix64(out)
    return mix64(out)


def spans(cut: np.ndarray, k: int) -> np.ndarray:
    """Among all places of concatenated documents, those where k symbols of one document start."""
    keep = np.ones(max(0, int(cut[-1]) - k + 1), bool)
    for back in range(1, k):
        at = cut[1:-1] - back
        at = at[(at >= 0) & (at < len(keep))]
        keep[at] = False
    return keep


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))

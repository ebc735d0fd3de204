"""SentencePiece encoding and decoding by one forward pass over a trie of marked words.

A text becomes marked words: a mark for every space (and one before the text),
each run of marks starting a word, each line feed standing alone if no piece
holds one.  No piece crosses such a boundary.  The distinct words of a block of
documents are sorted, which is a depth-first walk of their trie; what the
forward pass knows of a prefix is kept on a stack and used again by every word
that shares it, so only the new characters of a word cost anything.

For a unigram model the forward score of a prefix is the best sum of piece
scores.  For a merge (BPE) model it is zero or minus infinity: of the pieces
that end at a place, exactly one can follow the last piece of its prefix
without the merges having joined across the seam, and that one is kept.  Both
give the segmentation that the model's library gives.  Characters without a
piece become byte pieces.

Defined results: null and empty texts have no ids; the mark itself in a text
reads as a space (as in the library); repeated rows are encoded each; other
columns are ignored.  ``round_trip`` says that decoding gave the text back.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptmatrix.llm import textkit as tk
from promptmatrix.llm.session import bounded_batches, lean

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Bytes of text whose distinct new words are sorted together, and ids that are spelled at once: they decide the memory of a task.
BLOCK_BYTES, SPELLED_IDS = 4 << 20, 1 << 17
#: Words whose ids a task keeps, about, besides those of its block.
KNOWN_WORDS, KNOWN_PAIRS = 1 << 20, 1 << 18
_NEVER = 1 << 60


@dataclass
class Model:
    """Ordinary pieces with scores, the byte pieces, and every id's bytes for decoding."""

    score: dict[str, float]
    number: dict[str, int]
    byte: list[int]
    raw: list[bytes]
    unknown: int
    merges: bool
    prefix: bool = True


def load(path: str = MODEL) -> Model:
    """Reads a model file on the driver; the result is a bounded table that is sent to the executors."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    size, byte = p.get_piece_size(), [0] * 256
    score, number, raw = {}, {}, []
    for i in range(size):
        piece = p.id_to_piece(i)
        if p.is_byte(i):
            byte[int(piece[3:5], 16)] = i
            raw.append(bytes([int(piece[3:5], 16)]))
        elif p.is_control(i) or p.is_unknown(i) or p.is_unused(i):
            raw.append(b"")
        else:
            score[piece], number[piece] = p.get_score(i), i
            raw.append(piece.replace(MARK, " ").encode())
    merges = len({s for s in score.values() if s == int(s)}) > 0.9 * len(score)
    return Model(score, number, byte, raw, p.unk_id(), merges, p.encode("a", out_type=str)[0].startswith(MARK))


class Encoder:
    """The forward pass; made once a task from the table."""

    def __init__(self, model: Model):
        self.model, self.number = model, model.number
        self.reach: dict[str, int] = {}  # the longest piece with this end of two characters
        for piece in model.number:
            self.reach[piece[-2:]] = max(len(piece), self.reach.get(piece[-2:], 0))
        self.spelled = {n: p for p, n in model.number.items()}
        self.size_of_table = max(self.spelled, default=0) + 1
        self.names, self.at, self.size, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.alone = all("\n" not in p for p in model.number)
        self.rank, self.parts, self.good, self.fits = {}, {}, {}, {}
        if model.merges:
            self.rank = {p: -s for p, s in model.score.items()}
            for p in model.number:
                self._split(p)

    # Merge models -------------------------------------------------------

    def merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """The merges themselves, best rank first and leftmost among equals, and the last of them.

        Pairs wait in a heap and parts are chained, so n characters cost n log n.
        """
        parts, rank = list(text), self.rank
        n = len(parts)
        before, after, last = list(range(-1, n - 1)), list(range(1, n + 1)), None
        heap = [(rank[p], i, p) for i, p in enumerate(map("".join, zip(parts, parts[1:], strict=False))) if p in rank]
        heapq.heapify(heap)
        while heap:
            _, i, whole = heapq.heappop(heap)
            j = after[i] if parts[i] else n
            if j >= n or parts[i] + parts[j] != whole:
                continue  # one of the two has been merged since
            last = (parts[i], parts[j])
            parts[i], parts[j] = whole, ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (pair := parts[a] + parts[b]) in rank:
                    heapq.heappush(heap, (rank[pair], a, pair))
        return [p for p in parts if p], last

    def _split(self, piece: str) -> None:
        """The two pieces that the last merge of ``piece`` joins, and whether the merges make the piece at all."""
        parts, last = self.merge(piece)
        self.good[piece] = len(parts) == 1
        self.parts[piece] = last if len(parts) == 1 else None

    def _edge(self, piece: str, side: int) -> list[str]:
        """What stands at the right (1) or left (0) end of the piece as its merges go on: from a character to the piece."""
        out = [piece]
        while self.parts.get(out[-1]):
            out.append(self.parts[out[-1]][side])
        return out[::-1]

    def follows(self, one: int, two: int) -> bool:
        """Whether the merges over the text of two pieces, given by number, end with exactly these two.

        Both pieces grow at the seam, each to its next form at that form's
        rank.  While two forms stand side by side, a merge of them that comes
        before the next growth of either would join them.
        """
        key = one * self.size_of_table + two
        known = self.fits.get(key)
        if known is None:
            a, b = self.spelled[one], self.spelled[two]
            left, right, rank = self._edge(a, 1), self._edge(b, 0), self.rank
            i = j = 0
            known = True
            while True:
                grow_a = rank[left[i + 1]] if i + 1 < len(left) else _NEVER
                grow_b = rank[right[j + 1]] if j + 1 < len(right) else _NEVER
                joined = rank.get(left[i] + right[j], _NEVER)
                if joined < grow_a and joined <= grow_b and joined < _NEVER:
                    known = False
                    break
                if grow_a == grow_b == _NEVER:
                    break
                if grow_a <= grow_b:
                    i += 1
                else:
                    j += 1
            known = known and self.good[b]
            if len(self.fits) > KNOWN_PAIRS:
                self.fits.clear()
            self.fits[key] = known
        return known

    # The walk -----------------------------------------------------------

    def words(self, distinct: list[str]) -> list[list[int]]:
        """The ids of distinct words given in sorted order."""
        number, reach, follows, good, merges, fits, table = self.number, self.reach, self.follows, self.good, self.model.merges, self.fits, self.size_of_table
        score, byte, spelled = self.model.score, self.model.byte, self.spelled
        last: list = [None]  # the number of the piece that ends the best segmentation of each prefix; None: the beginning, or a character without a piece
        best = [0.0]
        out, before = [], ""
        for word in distinct:
            if merges and word.startswith(MARK * 2):  # equal ranks among runs of marks: the merges decide
                ids: list[int] = []
                for p in self.merge(word)[0]:
                    n = number.get(p)
                    ids.extend([n] if n is not None else [byte[x] for x in p.encode()])
                out.append(ids)
                continue
            same, most = 0, min(len(word), len(before))
            while same < most and word[same] == before[same]:
                same += 1
            del last[same + 1 :], best[same + 1 :]
            before = word
            for end in range(same + 1, len(word) + 1):
                pick, top = None, -1e30
                most = reach.get(word[end - 2 : end], 1) if end > 1 else 1
                for start in range(end - most if end > most else 0, end):
                    piece = word[start:end]
                    n = number.get(piece)
                    if n is None:
                        continue
                    if merges:
                        prior = last[start]
                        if prior is None:
                            if good[piece]:
                                pick = n
                                break
                        else:
                            fit = fits.get(prior * table + n)
                            if follows(prior, n) if fit is None else fit:
                                pick = n
                                break
                    elif best[start] + score[piece] > top:
                        pick, top = n, best[start] + score[piece]
                if pick is None and not merges:
                    top = best[end - 1] - 1e6
                last.append(pick)
                best.append(top)
            ids, at = [], len(word)
            while at:
                piece = last[at]
                if piece is None:
                    at -= 1
                    ids.extend(byte[x] for x in reversed(word[at].encode()))
                else:
                    ids.append(piece)
                    at -= len(spelled[piece])
            out.append(ids[::-1])
        return out

    def block(self, c: tk.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all documents of a chunk, end to end, and where each document begins."""
        data, off = c.data, c.off
        if b"\xe2\x96\x81" in data.tobytes():
            texts = [c.text(i).replace(MARK, " ").encode() for i in range(c.n)]
            off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
            data = np.frombuffer(b"".join(texts), np.uint8)
        if len(self.names) > KNOWN_WORDS:
            self.names, self.at, self.size, self.flat = self.names[:0], self.at[:0], self.size[:0], self.flat[:0]
        full = np.flatnonzero(np.diff(off) > 0)
        if not len(full):
            return np.zeros(0, np.int32), np.zeros(c.n + 1, np.int64)
        if self.model.prefix:
            data = np.insert(data, off[full], 32)
            grown = np.zeros(c.n + 1, np.int64)
            grown[full + 1] = 1
            off = off + grown.cumsum()
        space = data == 32
        start = space.copy()
        start[1:] &= ~space[:-1]
        if self.alone:
            feed = data == 10
            start |= feed
            start[1:] |= feed[:-1]
        start[off[full]] = True
        begin = np.flatnonzero(start)
        end = np.append(begin[1:], len(data))
        names, first, which = np.unique(tk.word_hashes(data, begin, end), return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.names, names), max(0, len(self.names) - 1))
        new = self.names[place] != names if len(self.names) else np.ones(len(names), bool)
        self._learn(data, begin, end, names[new], first[new])
        place = np.searchsorted(self.names, names)
        at, size = self.at[place], self.size[place]
        n = size[which]
        to = np.concatenate([[0], np.cumsum(n)])
        ids = self.flat[np.repeat(at[which] - to[:-1], n) + np.arange(to[-1])]
        return ids, to[np.searchsorted(begin, off)]

    def _learn(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, names: np.ndarray, first: np.ndarray) -> None:
        """Encodes the new words of a block; what was known before is kept beside them up to a fixed number of words."""
        raw = data.tobytes()
        distinct = [raw[a:b].decode("utf-8", "replace").replace(" ", MARK) for a, b in zip(begin[first].tolist(), end[first].tolist(), strict=True)]
        order = sorted(range(len(distinct)), key=distinct.__getitem__)
        coded: list = [None] * len(distinct)
        for i, ids in zip(order, self.words([distinct[i] for i in order]), strict=True):
            coded[i] = ids
        size = np.array([len(x) for x in coded], np.int64)
        flat = np.fromiter((x for ids in coded for x in ids), np.int32, int(size.sum()))
        at = len(self.flat) + np.cumsum(size) - size
        self.flat = np.concatenate([self.flat, flat])
        place = np.searchsorted(self.names, names)
        self.names, self.at, self.size = np.insert(self.names, place, names), np.insert(self.at, place, at), np.insert(self.size, place, size)


class Decoder:
    def __init__(self, model: Model):
        self.size = np.array([len(r) for r in model.raw], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.bytes = np.frombuffer(b"".join(model.raw), np.uint8)
        self.prefix = model.prefix

    def block(self, ids: np.ndarray, cut: np.ndarray) -> list[bytes]:
        """The texts of id sequences laid end to end."""
        to, parts = np.zeros(len(ids) + 1, np.int64), []
        for x in range(0, len(ids), SPELLED_IDS):
            own = ids[x : x + SPELLED_IDS]
            n = self.size[own]
            end = np.cumsum(n)
            to[x + 1 : x + 1 + len(own)] = to[x] + end
            parts.append(self.bytes[np.repeat(self.at[own] - end + n, n) + np.arange(end[-1])].tobytes())
        raw, out = b"".join(parts), []
        for a, b in zip(to[cut[:-1]].tolist(), to[cut[1:]].tolist(), strict=True):
            out.append(raw[a + 1 : b] if self.prefix and raw[a : a + 1] == b" " and b > a else raw[a:b])
        return out


def encode(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, ``ids``, ``n_tokens`` and ``round_trip`` of every document."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(shared.value), Decoder(shared.value)
        for b in batches:
            for c in tk.chunks(b.column(1), BLOCK_BYTES):
                ids, cut = encoder.block(c)
                raw = c.data.tobytes()
                back = [t == raw[x:y] or t == raw[x:y].replace(MARK.encode(), b" ") for t, x, y in zip(decoder.block(ids, cut), c.off[:-1].tolist(), c.off[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0)[c.first : c.first + c.n], pa.array(np.diff(cut)), pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(ids)), pa.array(back)], [id_col, "n_tokens", "ids", "round_trip"])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    return rows.mapInArrow(lean(run), f"`{id_col}` long, n_tokens long, ids array<int>, round_trip boolean")


def decode(coded: DataFrame, model: Model, id_col: str = "doc_id", ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """The texts of id arrays; a null array is an empty text, ids outside the table read as nothing."""
    shared = coded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for b in batches:
            lists = [np.array([i for i in x or () if i is not None and 0 <= i < len(decoder.size)], np.int64) for x in b.column(1).to_pylist()]
            cut = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            texts = decoder.block(np.concatenate([*lists, np.zeros(0, np.int64)]), cut)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())], [id_col, text_col])

    return coded.select(F.col(id_col).cast("long").alias(id_col), F.col(ids_col).alias(ids_col)).mapInArrow(lean(run), f"`{id_col}` long, `{text_col}` string")

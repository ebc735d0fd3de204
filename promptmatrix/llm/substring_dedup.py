"""Substring dedup by recompression.

A window is 35 consecutive words of one document; every word of a window whose
word sequence also starts anywhere else is removed.

1. Words get names; two rounds of recompression follow.  In a round every name
   has a side, left or right, drawn from the name alone, and each left name
   followed by a right one becomes one name for the pair.  Names are 64-bit
   hashes of what they stand for, so they are global without a dictionary, and
   equal substrings get equal symbols but for three words at either end.
   Consecutive symbols that cover eight words have one high-level name; a run
   of equal symbols has the same high-level name all along.
2. Of the high-level symbols in the part of a window that no neighbour can
   change, the one with the least name is the window's witness.  Equal windows
   have equal witnesses, so a window whose witness is found once only is
   unique.  Spark counts the witnesses of all documents (one document stands
   for its exact copies).
3. Windows with a shared witness are verified: their own names, 96 bits over
   all 35 words, are counted.  Words under a window that is found twice are
   removed; a document that has exact copies and at least one window is removed
   whole.

Nothing is collected but the witnesses and window starts of one document, and
every count is pre-aggregated before its shuffle.  A witness or window that
holds more than a 4096th of all rows is one of less than 4096; these few are
broadcast, so no task gets more than that share of the rows by one key.

Defined results: null and empty texts have no words and are left as they are;
documents under 35 words lose nothing; repeated rows are copies of each other;
rows with a null id are told apart by their text; other columns are untouched.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptmatrix.llm import textkit as tk
from promptmatrix.llm.session import bounded_batches, checkpointed, lean, stored

WINDOW = 35
_ROUNDS, _COVER = 2, 8
#: Words at either end of a window whose symbols its neighbours can change; the longest high-level symbol; the witnesses' places.
_EDGE, _LONGEST = 3, _COVER - 1 + 2**_ROUNDS
_PLACES = WINDOW - 2 * _EDGE - _LONGEST + 1
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_GOLD, _OTHER = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_HOT = 4096


def recompress(names: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols after two rounds of pair naming, where each begins, and its document."""
    start, doc = np.arange(len(names)), np.repeat(np.arange(len(cut) - 1), np.diff(cut))
    for turn in range(1, _ROUNDS + 1):
        left = (tk.mix64(names + np.uint64(turn * _GOLD & (1 << 64) - 1)) & np.uint64(1)).astype(bool)
        at = np.flatnonzero(left[:-1] & ~left[1:] & (doc[:-1] == doc[1:]))
        names = names.copy()
        names[at] = tk.mix64(names[at] * _OTHER + names[at + 1])
        keep = np.ones(len(names), bool)
        keep[at + 1] = False
        names, start, doc = names[keep], start[keep], doc[keep]
    return names, start, doc


def witnesses(names: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place, the witness of the window that begins there (all ones: none, as at windows that leave the document), and where it stands."""
    n = len(names)
    value = np.full(n + WINDOW, _NONE)
    if n >= WINDOW:
        symbol, start, doc = recompress(names, cut)
        end = cut[1:][doc]
        end[:-1] = np.where(doc[:-1] == doc[1:], start[1:], end[:-1])
        high, done = np.full(len(symbol), _NONE), np.zeros(len(symbol), bool)
        for k in range(2, _COVER + 1):
            size = len(symbol) - k + 1
            if size <= 0:
                break
            covers = ~done[:size] & (doc[k - 1 :] == doc[:size]) & (end[k - 1 :] - start[:size] >= _COVER)
            high[:size][covers] = tk.grams(symbol, k)[covers] if covers.any() else 0
            done[:size] |= covers
        value[start[done]] = high[done] & np.uint64(0x7FFFFFFFFFFFFFFF)
    place = np.arange(_EDGE, _EDGE + n) + sliding_window_view(value, _PLACES)[_EDGE : _EDGE + n].argmin(1)
    least = value[place]
    least[~_whole(cut, n)] = _NONE
    return least, place


def _whole(cut: np.ndarray, n: int) -> np.ndarray:
    """True at the places where a window of one document begins."""
    out = np.zeros(n, bool)
    ok = tk.spans(cut, WINDOW)
    out[: len(ok)] = ok
    return out


def window_names(names: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hashes of the windows, by doubling: 35 = 32 + 2 + 1."""
    n = len(names) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if salt:
        names = tk.mix64(names + np.uint64(salt * _GOLD & (1 << 64) - 1))
    parts, at, g = names[WINDOW - 1 :][:n].copy(), 32, names
    for size in (1, 2, 4, 8, 16):
        if size == 2:
            parts = tk.mix64(parts * _OTHER + g[at : at + n])
        g = tk.mix64(g[: len(g) - size] * np.uint64(_GOLD) + g[size:] + np.uint64(size))
    return tk.mix64(parts * _OTHER + g[:n])


def _whole_hash(names: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(cut)
    place = np.arange(len(names), dtype=np.uint64) - np.repeat(cut[:-1], n).astype(np.uint64)
    out = []
    for salt in (np.uint64(_GOLD), _OTHER):
        total = np.zeros(len(names) + 1, np.uint64)
        np.cumsum(tk.mix64(names * salt + place * _OTHER), out=total[1:])
        out.append(tk.mix64(total[cut[1:]] - total[cut[:-1]] + n.astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def _named(c: tk.Chunk) -> tuple[tk.Words, np.ndarray]:
    w = tk.find_words(c)
    return w, tk.word_hashes(c.data, w.start, w.end)


def _release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove shuffle files of finished steps, which a checkpoint has replaced."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _survey(rows: DataFrame) -> DataFrame:
    """key, h1, h2, n and, for texts with a window, the distinct witnesses; those found twice in the text come first (``twice`` many)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in tk.chunks(b.column(1)):
                w, h = _named(c)
                h1, h2 = _whole_hash(h, w.cut)
                seen, place = witnesses(h, w.cut)
                found, twice = [], []
                for x, y in zip(w.cut[:-1], w.cut[1:], strict=True):
                    own, at = seen[x:y][seen[x:y] != _NONE], place[x:y][seen[x:y] != _NONE]
                    if len(own):
                        own, times = np.unique(own[np.append(True, at[1:] != at[:-1])], return_counts=True)
                        own = np.concatenate([own[times > 1], own[times == 1]])
                        twice.append(int((times > 1).sum()))
                    else:
                        twice.append(0)
                    found.append(own.view(np.int64))
                flat = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(f) for f in found])]), pa.int32()), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0)[c.first : c.first + c.n], pa.array(h1), pa.array(h2), pa.array(np.diff(w.cut)), flat, pa.array(twice, pa.int32())], ["key", "h1", "h2", "n", "found", "twice"])

    return rows.mapInArrow(lean(run), "key long, h1 long, h2 long, n long, found array<long>, twice int")


def _candidates(rows: DataFrame) -> DataFrame:
    """From key, t, h1, h2, shared: name (two hashes), key and start of every window with a shared witness."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            want1, want2, shared = b.column(2).to_numpy(), b.column(3).to_numpy(), b.column(4)
            ends, names = shared.offsets.to_numpy(), shared.values.to_numpy()
            for c in tk.chunks(b.column(1)):
                w, h = _named(c)
                h1, h2 = _whole_hash(h, w.cut)
                (seen, _), whole, other = witnesses(h, w.cut), window_names(h), window_names(h, 1)
                keys, starts, hashes, others = [], [], [], []
                for i in range(c.n):
                    row = c.first + i
                    if h1[i] != want1[row] or h2[i] != want2[row]:
                        continue
                    x, y = w.cut[i], w.cut[i + 1]
                    at = np.flatnonzero(np.isin(seen[x:y].view(np.int64), names[ends[row] : ends[row + 1]]) & (seen[x:y] != _NONE))
                    keys.append(np.full(len(at), row))
                    starts.append(at)
                    hashes.append(whole[x + at])
                    others.append(other[x + at])
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes).view(np.int64)), pa.array((np.concatenate(others) >> np.uint64(32)).astype(np.uint32).view(np.int32)), b.column(0).take(pa.array(np.concatenate(keys))), pa.array(np.concatenate(starts).astype(np.int32))], ["window", "other", "key", "start"])

    return rows.mapInArrow(lean(run), "window long, other int, key long, start int")


def _among(rows: DataFrame, names: DataFrame, by: list[str]) -> DataFrame:
    """The rows whose name is among ``names`` (with their number of ``rows``); the fewer than _HOT names that hold over a _HOT-th of them are broadcast."""
    total = names.agg(F.sum("rows")).first()[0] or 0
    heavy = F.col("rows") > total / _HOT
    hot = F.broadcast(names.where(heavy).select(*by))
    return rows.join(hot, by, "left_semi").unionAll(rows.join(hot, by, "left_anti").join(names.where(~heavy).select(*by), by, "left_semi"))


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` as a struct ``doc``, and n_words, n_removed and kept, the words left joined by one space."""
    spark = docs.sparkSession
    bounded_batches(spark)
    text = F.col(text_col).cast("string")
    key = F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text))
    rows = docs.select(key.alias("key"), text.alias("t"))
    surveyed, drop_surveyed = stored(_survey(rows))
    full, drop_full = stored(surveyed.where(f"n >= {WINDOW}").groupBy("h1", "h2").agg(F.min("key").alias("key"), F.count("*").alias("copies"), F.first("found").alias("found"), F.first("twice").alias("twice")))
    single = checkpointed(full.select("key", "h1", "h2", "copies"))
    copies = checkpointed(surveyed.select("key", "h1", "h2").join(single.where("copies > 1").select("h1", "h2"), ["h1", "h2"]).select("key", "h1", F.lit(True).alias("copy"), F.lit(None).cast("array<int>").alias("starts")).distinct())
    drop_surveyed()
    seen = full.select("key", "h1", F.posexplode("found").alias("i", "name"), "twice").select("key", "h1", "name", F.when(F.col("i") < F.col("twice"), 2).otherwise(1).alias("times"))
    often = checkpointed(seen.groupBy("name").agg(F.sum("times").alias("c"), F.count("*").alias("rows")).where("c > 1").select("name", "rows"))
    _release(spark)
    shared = checkpointed(_among(seen, often, ["name"]).groupBy("key", "h1").agg(F.collect_list("name").alias("shared")))
    drop_full()
    _release(spark)
    suspects = single.select("key", "h1", "h2").join(shared, ["key", "h1"])
    windows, drop_windows = stored(_candidates(rows.join(suspects, "key").select("key", "t", "h1", "h2", "shared")))
    _release(spark)
    again = checkpointed(windows.groupBy("window", "other").agg(F.count("*").alias("rows")).where("rows > 1"))
    _release(spark)
    starts = _among(windows, again, ["window", "other"]).groupBy("key").agg(F.collect_list("start").alias("starts"))
    found = starts.join(single.where("copies = 1").select("key", "h1"), "key").select("key", "h1", F.lit(False).alias("copy"), "starts")
    judged = checkpointed(found.unionByName(copies).groupBy("key").agg(F.collect_list(F.struct("h1", "copy", "starts")).alias("judged")))
    drop_windows()
    _release(spark)
    joined = docs.select(F.struct("*").alias("doc"), text.alias("t"), key.alias("key")).join(judged, "key", "left").select("doc", "t", "judged")
    schema = T.StructType([T.StructField("doc", docs.schema), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, kept = [], [], []
            verdicts = b.column(2)
            for c in tk.chunks(b.column(1)):
                w, h = _named(c)
                h1, _ = _whole_hash(h, w.cut)
                raw = c.data.tobytes()
                for i in range(c.n):
                    x, y = w.cut[i], w.cut[i + 1]
                    gone = np.zeros(y - x, bool)
                    for v in verdicts[c.first + i].as_py() or ():
                        if v["h1"] == h1[i]:
                            if v["copy"]:
                                gone[:] = True
                            else:
                                edge = np.zeros(len(gone) + WINDOW, np.int64)
                                s = np.array(v["starts"], np.int64)
                                np.add.at(edge, s, 1)
                                np.add.at(edge, s + WINDOW, -1)
                                gone |= edge.cumsum()[: len(gone)] > 0
                    words = raw[c.off[i] : c.off[i + 1]].split()
                    n_words.append(len(words))
                    n_removed.append(int(gone.sum()))
                    kept.append(b" ".join([word for word, out in zip(words, gone.tolist(), strict=True) if not out] if n_removed[-1] else words).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=schema.names)

    return joined.mapInArrow(lean(run), schema)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words of every document."""
    slim = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col))
    return remove(slim, id_col, text_col).select(F.col("doc").getField(id_col).alias(id_col), "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def apply(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated words taken out of the texts; a text that loses nothing stays as it is, and n_chars, if there, follows."""
    lost = F.col("n_removed") > 0
    columns = {c: F.col("doc").getField(c) for c in docs.columns}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(lost, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    columns[text_col] = F.when(lost, F.col("kept")).otherwise(columns[text_col])
    return remove(docs, id_col, text_col).select(*(c.alias(name) for name, c in columns.items()))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS line, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
p AS (SELECT line, unnest(range(1, len(w) - 33)) AS s FROM d WHERE len(w) >= 35),
h AS (SELECT p.line, p.s, md5(array_to_string(d.w[p.s : p.s + 34], ' ')) AS k FROM p JOIN d USING (line)),
r AS (SELECT k FROM h GROUP BY k HAVING count(*) > 1),
g AS (SELECT line, list(s) AS starts FROM h JOIN r USING (k) GROUP BY line),
c AS (SELECT DISTINCT line, unnest(starts) + o AS i FROM g, (SELECT unnest(range(0, 35)) AS o)),
x AS (SELECT line, list(i) AS gone, count(*) AS n FROM c GROUP BY line)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
       sha256(CASE WHEN n IS NULL THEN array_to_string(w, ' ')
                   ELSE array_to_string(list_filter(w, lambda v, j: NOT list_contains(gone, j)), ' ') END) AS kept_sha256
FROM d LEFT JOIN x USING (line)
"""

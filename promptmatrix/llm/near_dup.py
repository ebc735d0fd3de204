"""Near-duplicate classes by BagMinHash signatures, bands and exact multiset overlap.

A text is the multiset of its shingles of five words (a text of one to four
words is one shingle).  Two texts are linked if the sum of the least counts of
their shingles is at least 0.8 of the sum of the largest; a class is a
connected component of links.

1. Every text gets a BagMinHash signature in one narrow pass; texts with equal
   words are one member from here on.
2. Members that agree in a whole band of the signature share a bucket.  Texts
   with an overlap of 0.8 share one of the 25 bands of 5 with probability
   1 - 5e-5.
3. Every member of a bucket is verified against the bucket's pivot, its least
   member: signatures first, then whole shingle multisets.  A large bucket is
   cut into blocks that each see the pivot, so this is linear in its members.
4. Where the other members of a bucket are then not all connected, they are
   compared with each other in pairs of blocks, members that are connected
   already excepted; buckets with the same members are compared once.  Only
   links that connect something are emitted, at most one a row of a block.
5. The components of all links are the classes.

Every pair that shares a bucket is thus verified or connected already; nothing
is compared outside a bucket.

Defined results: null and empty texts are classes of their own; repeated rows
and exact copies are in one class; rows that share an id but not their words
are members of their own; the class id is the least id in the class (null if
all its ids are); a null id keeps its row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptmatrix.llm import textkit as tk
from promptmatrix.llm.components import components
from promptmatrix.llm.session import bounded_batches, by_key, checkpointed, cpu_parallelism, lean, stored

WORDS, LEAST = 5, 0.8
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
#: Of 125 registers, pairs with fewer equal ones are not verified; at an overlap of 0.8 that loses 2 pairs in a million.
AGREE = 78
#: Members and bytes of shingles in a block, about.
BLOCK_ROWS, BLOCK_BYTES = 512, 8 << 20

_GOLD, _OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_LEFT, _RIGHT = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def shingles(c: tk.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk: shingle hashes with their documents, and two hashes of each document's whole word sequence."""
    w = tk.find_words(c)
    h = tk.word_hashes(c.data, w.start, w.end)
    at = np.flatnonzero(tk.spans(w.cut, WORDS))
    g, doc = tk.grams(h, WORDS)[at], w.doc[at]
    n = np.diff(w.cut)
    place = np.arange(len(h), dtype=np.uint64) - w.cut[w.doc].astype(np.uint64)
    whole = []
    for salt in (_GOLD, _OTHER):
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(tk.mix64(h * salt + place * _OTHER), out=total[1:])
        whole.append(tk.mix64(total[w.cut[1:]] - total[w.cut[:-1]] + n.astype(np.uint64)))
    short = np.flatnonzero((n > 0) & (n < WORDS))
    g, doc = np.concatenate([g, whole[0][short]]), np.concatenate([doc, short])
    return g, doc, whole[0].view(np.int64), whole[1].view(np.int64)


def weigh(g: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, shingle) with counts, documents in order."""
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    first = np.ones(len(g), bool)
    first[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(first)
    return g[at], doc[at], np.diff(np.append(at, len(g)))


def signatures(g: np.ndarray, doc: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """BagMinHash of n weighted sets at once.

    The weight axis is discretised to whole numbers and cut into [0,1), [1,2),
    [2,4), [4,8) ...; every shingle has in each of these intervals a Poisson
    process of points (time, register), the same for any weight.  A process
    over more than one step of the axis splits in halves at its first point:
    one half, drawn by lot, inherits the point and the other goes on from that
    time by itself, down to processes of one step.  Halves that lie above the
    weight are dropped, so a partly covered interval is refined only along the
    edge of the weight.  A point counts when the interval it is known to lie in
    is wholly covered.  A register keeps the earliest point; a process ends
    when it comes after the latest register of its document.
    """
    best = np.full((n, REGISTERS), np.inf)
    flat = best.ravel()
    top = np.ones(len(g), np.int64) + np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64)
    item = np.repeat(np.arange(len(g)), top)
    level = np.arange(len(item)) - np.repeat(np.cumsum(top) - top, top)
    low = np.where(level == 0, 0.0, 2.0 ** (level - 1))
    span = np.where(level == 0, 1.0, low)
    owner, most, time = doc[item], weight[item].astype(float), np.zeros(len(item))
    key = tk.mix64(g[item] + level.astype(np.uint64) * _OTHER)  # the random state of an interval
    step, heir, point = np.zeros(len(item), np.uint64), np.zeros(len(item), bool), np.zeros(len(item), np.uint64)
    while len(key):
        z = tk.mix64(key + (step + np.uint64(1)) * _GOLD)
        waits = np.where(heir, 0.0, -np.log(((z >> np.uint64(11)).astype(float) + 0.5) / 2**53) / span)
        time, point = time + waits, np.where(heir, point, tk.mix64(z ^ _OTHER))
        counts = low + span <= most
        register = ((point & np.uint64(0xFFFFFFFF)) * np.uint64(REGISTERS) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(flat, owner[counts] * REGISTERS + register[counts], time[counts])
        go = time < best.max(1)[owner]
        single, wide = np.flatnonzero(go & (span == 1)), np.flatnonzero(go & (span > 1))
        to_right = (tk.mix64(key[wide] ^ _GOLD) & np.uint64(1)).astype(bool)
        half = span[wide] / 2
        right = wide[low[wide] + half < most[wide]]
        in_right = low[wide] + half < most[wide]
        keep = np.concatenate([single, wide, right])
        low = np.concatenate([low[single], low[wide], (low[wide] + half)[in_right]])
        span = np.concatenate([span[single], half, half[in_right]])
        heir = np.concatenate([np.zeros(len(single), bool), ~to_right, to_right[in_right]])
        step = np.concatenate([step[single] + np.uint64(1), np.zeros(len(wide) + len(right), np.uint64)])
        key = np.concatenate([key[single], tk.mix64(key[wide] + _LEFT), tk.mix64(key[right] + _RIGHT)])
        owner, most, time, point = owner[keep], most[keep], time[keep], point[keep]
    return (tk.mix64(best.view(np.uint64)) >> np.uint64(48)).astype(np.uint16)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column, Column]:
    """The id, the text, and a key that finds a text again: the id, or a hash of the text where there is none."""
    ident, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    return ident, text, F.coalesce(ident, F.xxhash64(text))


def _sign(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, key, exact (a hash of the text), h1, h2 (the whole word sequence), n (shingles), sig; n is 0 and sig null for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in tk.chunks(b.column(3)):
                g, doc, h1, h2 = shingles(c)
                n = np.bincount(doc, minlength=c.n)
                sig = signatures(*weigh(g, doc), c.n)
                own = [b.column(i)[c.first : c.first + c.n] for i in range(3)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(h1), pa.array(h2), pa.array(n.astype(np.int64)), pa.array([s.tobytes() if k else None for s, k in zip(sig, n, strict=True)], pa.binary())], ["id", "key", "exact", "h1", "h2", "n", "sig"])

    ident, text, key = _keyed(docs, id_col, text_col)
    return docs.select(ident.alias("id"), key.alias("key"), F.xxhash64(text).alias("exact"), text.alias("t")).mapInArrow(lean(run), "id long, key long, exact long, h1 long, h2 long, n long, sig binary")


def _bands(members: DataFrame) -> DataFrame:
    """One row for each member and band: a key of the band and its five registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(-1, BANDS, ROWS).astype(np.uint64)
            key = np.zeros(sig.shape[:2], np.uint64) + np.arange(BANDS, dtype=np.uint64)
            for i in range(ROWS):
                key = tk.mix64(key * _GOLD + sig[:, :, i])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), BANDS)), pa.array(key.ravel().view(np.int64))], ["rep", "bucket"])

    return members.select("rep", "sig").mapInArrow(lean(run), "rep long, bucket long")


def _bags(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """rep, sig and bag (sorted hashes of the shingles, the nth copy of one apart from the others) of the wanted members (rep, key, h1, h2, sig)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            want = b.column(2).to_numpy(), b.column(3).to_numpy()
            for c in tk.chunks(b.column(1)):
                g, doc, h1, h2 = shingles(c)
                g, doc, weight = weigh(g, doc)
                item = np.repeat(np.arange(len(g)), weight)
                nth = (np.arange(len(item)) - np.repeat(np.cumsum(weight) - weight, weight)).astype(np.uint64)
                keys, doc = tk.mix64(g[item] + nth * _OTHER), doc[item]
                order = np.lexsort((keys, doc))
                cut = np.searchsorted(doc[order], np.arange(c.n + 1))
                keys = keys[order]
                rows = slice(c.first, c.first + c.n)
                same = pa.array((h1 == want[0][rows]) & (h2 == want[1][rows]))
                out = pa.RecordBatch.from_arrays([b.column(0)[rows], b.column(4)[rows], pa.array([keys[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], ["rep", "sig", "bag"])
                yield out.filter(same)

    _, text, key = _keyed(docs, id_col, text_col)
    texts = docs.select(key.alias("key"), text.alias("t")).join(wanted, "key").select("rep", "t", "h1", "h2", "sig")
    return texts.mapInArrow(lean(run), "rep long, sig binary, bag binary")


class _Forest:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i


def link_block(ids: np.ndarray, side: np.ndarray, sigs: np.ndarray, bags: list[np.ndarray], label: np.ndarray) -> list[tuple[int, int]]:
    """Verified links that connect the rows of one block pair; rows of side 2 belong to a block compared with itself, and rows of one label are connected."""
    forest, links = _Forest(len(ids)), []
    size = np.array([len(x) for x in bags])
    root_of: dict[int, int] = {}
    for i, x in enumerate(label.tolist()):
        forest.up[i] = root_of.setdefault(x, i)
    left = np.flatnonzero(side != 1)
    for i in left:
        right = np.flatnonzero(side == 1) if side[i] == 0 else np.arange(i + 1, len(ids))
        right = right[label[right] != label[i]]
        if not len(right):
            continue
        fits = (np.minimum(size[right], size[i]) >= LEAST * np.maximum(size[right], size[i])) & ((sigs[right] == sigs[i]).sum(1) >= AGREE)
        for j in right[fits]:
            a, b = forest.root(i), forest.root(j)
            if a == b:
                continue
            both = len(np.intersect1d(bags[i], bags[j], assume_unique=True))
            if both >= LEAST * (size[i] + size[j] - both) - 1e-9:
                forest.up[b] = a
                links.append((int(ids[i]), int(ids[j])))
    return links


def _compared(dealt: DataFrame, parallelism: int) -> DataFrame:
    """Links ``a``, ``b`` from rows (rep, label, grp, x, y, side, sig, bag): one block pair for each (grp, x, y)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in by_key(batches, ["grp", "x", "y"]):
            ids = t["rep"].to_numpy()
            at = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))  # a member whose row is repeated in the table comes repeatedly
            if len(at) < 2:
                continue
            label, side = t["label"].to_numpy()[at], t["side"].to_numpy()[at]
            sigs = np.frombuffer(b"".join(t["sig"].take(at).to_pylist()), np.uint16).reshape(len(at), -1)
            found = link_block(ids[at], side, sigs, [np.frombuffer(x, np.uint64) for x in t["bag"].take(at).to_pylist()], label)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], ["a", "b"])

    rows = dealt.select("rep", "label", "grp", "x", "y", "side", "sig", "bag").repartition(parallelism, "grp", "x", "y").sortWithinPartitions("grp", "x", "y", "side", "rep")
    return rows.mapInArrow(lean(run), "a long, b long")


def _cut(by: str) -> tuple[Column, Column]:
    """Of rows grouped by a column: into how many blocks the group is cut, and the block of a row."""
    k = F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n") * 8 / BLOCK_BYTES)).cast("int")
    return k.alias("k"), F.pmod(F.xxhash64("rep"), F.col("k")).cast("int")


def links(docs: DataFrame, members: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links ``a``, ``b`` that connect the members (``rep``, key, h1, h2, n, sig) of one text each, bucket by bucket."""
    spread = cpu_parallelism(docs.sparkSession) * 2
    zero = F.lit(0)
    banded, drop_banded = stored(_bands(members))
    pivots = banded.groupBy("bucket").agg(F.min("rep").alias("pivot"), F.count("*").alias("c")).where("c > 1")
    met, drop_met = stored(banded.join(pivots, "bucket"))
    drop_banded()
    bags, drop_bags = stored(_bags(docs, members.join(met.select("rep").distinct(), "rep").select("rep", "key", "h1", "h2", "sig"), id_col, text_col))

    # every member against the pivots of its buckets, a large star in blocks that each hold the pivot
    pairs = checkpointed(met.where("rep <> pivot").select("rep", "pivot").distinct().join(members.select("rep", "n"), "rep"))
    k, block = _cut("pivot")
    stars = pairs.groupBy("pivot").agg(k)
    rim = pairs.join(stars, "pivot").select("rep", F.col("rep").alias("label"), F.col("pivot").alias("grp"), block.alias("x"), zero.alias("y"), F.lit(1).alias("side"))
    hub = stars.select(F.col("pivot").alias("rep"), F.col("pivot").alias("label"), F.col("pivot").alias("grp"), F.explode(F.sequence(zero, F.col("k") - 1)).alias("x"), zero.alias("y"), zero.alias("side"))
    star_links = checkpointed(_compared(rim.unionByName(hub).join(bags, "rep"), spread))

    # buckets whose other members are not all connected yet; one of the buckets with the same members
    label = components(star_links).withColumnRenamed("id", "rep")
    known = met.where("rep <> pivot AND c > 2").join(label, "rep", "left").select("rep", "bucket", "pivot", F.coalesce("label", "rep").alias("label"))
    mixed = known.groupBy("bucket", "pivot").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("c"), F.bit_xor(F.xxhash64("rep")).alias("one"), F.sum(F.xxhash64("rep").bitwiseAND(F.lit((1 << 40) - 1))).alias("two"))
    chosen = mixed.where("low <> high").groupBy("pivot", "c", "one", "two").agg(F.min("bucket").alias("bucket")).select("bucket")
    open_ = checkpointed(known.join(chosen, "bucket").join(members.select("rep", "n"), "rep"))
    drop_met()
    k, block = _cut("bucket")
    placed = open_.join(open_.groupBy("bucket").agg(k), "bucket").withColumn("block", block).withColumn("other", F.explode(F.sequence(zero, F.col("k") - 1)))
    dealt = placed.select(
        "rep", "label", F.col("bucket").alias("grp"), F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"),
        F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1).alias("side"),
    )
    found = checkpointed(star_links.unionAll(_compared(dealt.join(bags, "rep"), spread)))
    drop_bags()
    return found


def _classed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """All rows (id, key, exact, h1, h2, n), and a row for each distinct word sequence: h1, h2, ``label`` (the same for all of a class), its least id, and ``pick``, its first row as (nameless, key, exact)."""
    bounded_batches(docs.sparkSession)
    signed = checkpointed(_sign(docs, id_col, text_col))
    pick = F.struct(F.col("id").isNull().alias("nameless"), F.col("key").alias("key"), F.col("exact").alias("exact"))
    grouped = checkpointed(signed.where("n > 0").groupBy("h1", "h2").agg(F.min("key").alias("key"), F.min("id").alias("least"), F.min(pick).alias("pick"), F.first("n").alias("n"), F.first("sig").alias("sig")))
    members = grouped.withColumn("rep", F.monotonically_increasing_id())  # over stored rows: the same on every read
    found = components(links(docs, members, id_col, text_col))
    named = members.select("h1", "h2", "rep", "least", "pick").join(found.select(F.col("id").alias("rep"), "label"), "rep", "left")
    return signed.drop("sig"), checkpointed(named.select("h1", "h2", F.coalesce("label", "rep").alias("label"), "least", "pick"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and its class, the least id that it is connected with."""
    rows, named = _classed(docs, id_col, text_col)
    ids = named.join(named.groupBy("label").agg(F.min("least").alias("class_id")), "label").select("h1", "h2", "class_id")
    worded = rows.where("n > 0").join(ids, ["h1", "h2"]).select(F.col("id").alias(id_col), "class_id")
    return worded.unionAll(rows.where("n = 0").select(F.col("id").alias(id_col), F.col("id").alias("class_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class, whole: that with the least id (of several texts under that id, one).

    Different texts that share an id are judged each by its own class; a class
    without ids keeps one of its texts; of rows with equal id and text one
    stays.  Texts without words stay, once for each id; those without an id
    all stay.
    """
    rows, named = _classed(docs, id_col, text_col)
    chosen = named.groupBy("label").agg(F.min("pick").alias("f")).select("f.key", "f.exact")
    empty = rows.where("n = 0 AND id IS NOT NULL").groupBy("key").agg(F.min("exact").alias("exact"))
    kept = chosen.unionByName(empty).select(F.col("key").alias("_kept_key"), F.col("exact").alias("_kept_exact")).distinct()
    _, text, key = _keyed(docs, id_col, text_col)
    found = docs.select(F.struct("*").alias("doc"), key.alias("_kept_key"), F.xxhash64(text).alias("_kept_exact")).join(kept, ["_kept_key", "_kept_exact"])
    blank = docs.where(F.col(id_col).isNull() & ~F.coalesce(text, F.lit("")).rlike(r"[^ \t-\r]"))
    return found.dropDuplicates(["_kept_key", "_kept_exact"]).select("doc.*").unionByName(blank)

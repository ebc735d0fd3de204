"""Exact top-k inner products by dual-tree search over cover trees.

Vectors become integer vectors.  The top of the data's cover tree is a net of
pivots, about one for each block of data: every vector belongs to the cell of
its nearest pivot, whose covering radius Spark measures.  Queries have the same
cells.  Cells are cut into blocks of bounded size.

1. The queries of a cell are searched in one block of their own cell; the worst
   of their kth scores is the bar of the query cell.
2. A pair of cells can not hold a score above <a, b> + r|b| + s|a| + rs (pivots
   a, b, covering radii r, s).  Pairs whose bound lies below the bar are pruned
   before any vector is sent; of the others, every pair of a query block and a
   data block is one unit of work.
3. A unit builds a cover tree over its queries and one over its data: a node
   holds a center and the largest distance of its points from it; the centers
   of its children are a net of its points (each new one the farthest from
   those before) that goes on until it covers them at half the radius or has
   4 centers, so the centers are at least the covering distance apart.  Pairs
   of nodes are walked best first and dropped when the bound above lies below
   the worst kth score of the query node, which starts from step 1.  The best
   k of each unit are merged by query.

Vectors without structure allow no pruning by any exact bound; then all pairs
of blocks are scored.

Defined results: vectors that are null or hold null, NaN or infinite components
take no part, nor do rows with a null id; only vectors of one length are
compared; repeated rows are rows of their own, each a candidate of the other;
equal scores go to the smaller id; a query has fewer than k rows if there are
fewer candidates; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptmatrix.llm.session import by_key, checkpointed, cpu_parallelism, lean

#: Rows of a block of data and of queries, pivots at most, points of a leaf of data and of queries, children of a node at most.
DATA_BLOCK, QUERY_BLOCK, PIVOTS, LEAF, QUERY_LEAF, CHILDREN = 4096, 1024, 256, 256, 16, 4
SCALE = 256


@dataclass
class Tree:
    """Node i covers ``order[begin[i]:end[i]]``; children[i] is empty for a leaf."""

    order: np.ndarray
    begin: list[int]
    end: list[int]
    center: list[int]
    radius: list[float]
    children: list[list[int]]


def cover_tree(x: np.ndarray, leaf: int = LEAF) -> Tree:
    tree = Tree(np.zeros(len(x), np.int64), [], [], [], [], [])
    square = (x * x).sum(1)

    def distances(center: int, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(square[rows] + square[center] - 2 * (x[rows] @ x[center]), 0))

    def add(rows: np.ndarray, center: int, begin: int, radius: float) -> int:
        tree.begin.append(begin)
        tree.end.append(begin + len(rows))
        tree.center.append(center)
        tree.radius.append(radius)
        tree.children.append([])
        tree.order[begin : begin + len(rows)] = rows
        return len(tree.begin) - 1

    todo = [add(np.arange(len(x)), 0, 0, float(distances(0, np.arange(len(x))).max()))] if len(x) else []
    while todo:
        node = todo.pop()
        rows, at, radius = tree.order[tree.begin[node] : tree.end[node]].copy(), tree.begin[node], tree.radius[node]
        if len(rows) <= leaf or radius == 0:
            continue
        centers = [tree.center[node]]
        far, owner = distances(centers[0], rows), np.zeros(len(rows), np.int64)
        while len(centers) < CHILDREN and far.max() > radius / 2:
            centers.append(int(rows[far.argmax()]))
            near = distances(centers[-1], rows)
            owner[near < far] = len(centers) - 1
            far = np.minimum(far, near)
        for i, center in enumerate(centers):
            mine = owner == i
            if mine.any():
                tree.children[node].append(child := add(rows[mine], center, at, float(far[mine].max())))
                todo.append(child)
                at += int(mine.sum())
    return tree


def search(q: np.ndarray, q_row: np.ndarray, bar: np.ndarray, x: np.ndarray, x_id: np.ndarray, x_row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """For each query, the places in ``x`` of its k best candidates that score ``bar`` at least (-1: none), their scores, and how many pairs were scored."""
    best, place, scored = np.full((len(q), k), -np.inf), np.full((len(q), k), -1), 0
    if not len(q) or not len(x):
        return best, place, scored
    a, b = cover_tree(q, QUERY_LEAF), cover_tree(x)
    a_center, b_center = q[a.center], x[b.center]
    a_norm, b_norm = np.sqrt((a_center**2).sum(1)), np.sqrt((b_center**2).sum(1))
    a_radius, b_radius = np.array(a.radius), np.array(b.radius)
    q_mine, x_mine = q[a.order], x[b.order]
    kth = bar[a.order].astype(float)  # in the order of the tree

    def bounds(m: list[int], n: list[int]) -> np.ndarray:
        top = a_center[m] @ b_center[n].T + a_radius[m][:, None] * b_norm[n] + a_norm[m][:, None] * b_radius[n] + a_radius[m][:, None] * b_radius[n]
        return top + 1e-9 * np.abs(top) + 1e-6

    def leaves(m: int, n: int) -> None:
        mine, theirs = a.order[a.begin[m] : a.end[m]], b.order[b.begin[n] : b.end[n]]
        score = q_mine[a.begin[m] : a.end[m]] @ x_mine[b.begin[n] : b.end[n]].T
        score[q_row[mine][:, None] == x_row[theirs]] = -np.inf
        for i in np.flatnonzero(score.max(1) >= kth[a.begin[m] : a.end[m]]):
            r = mine[i]
            better = np.flatnonzero((score[i] >= kth[a.begin[m] + i]) & (score[i] > -np.inf))
            if len(better):
                s, p = np.concatenate([best[r], score[i, better]]), np.concatenate([place[r], theirs[better]])
                order = np.lexsort((x_row[p], x_id[p], -s))[:k]
                best[r], place[r] = s[order], p[order]
                kth[a.begin[m] + i] = max(kth[a.begin[m] + i], s[order][-1])

    stack = [(np.inf, 0, 0)]
    while stack:
        bound, m, n = stack.pop()
        if bound < kth[a.begin[m] : a.end[m]].min():
            continue
        ms, ns = a.children[m] or [m], b.children[n] or [n]
        if ms == [m] and ns == [n]:
            leaves(m, n)
            scored += (a.end[m] - a.begin[m]) * (b.end[n] - b.begin[n])
            continue
        top = bounds(ms, ns)
        stack.extend((float(top[i, j]), ms[i], ns[j]) for i, j in zip(*np.unravel_index(np.argsort(top, axis=None), top.shape), strict=True))
    return best, place, scored


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, row (a number of its own) and v, the integer vector, of every row that takes part."""
    e = F.col(vector_col)
    whole = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vectors.where(F.col(id_col).isNotNull() & e.isNotNull() & whole).select(
        F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), F.transform(e, lambda x: F.floor(x.cast("double") * SCALE).cast("double")).alias("v")
    )


def _celled(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """``rows`` (id, row, ask, dim, v) with ``cell``, the place of the nearest pivot (-1: the origin, where a length has none), and ``far``, the distance from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, v = b.column(3).to_numpy(), b.column(4)
            flat, ends = v.values.to_numpy(), v.offsets.to_numpy()
            cell, far = np.full(b.num_rows, -1, np.int32), np.zeros(b.num_rows)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                x = flat[ends[at][:, None] + np.arange(dim)]
                net = pivots.get(dim)
                if net is None:
                    far[at] = np.sqrt((x * x).sum(1))
                    continue
                near = (net * net).sum(1) - 2 * (x @ net.T)
                cell[at] = near.argmin(1)
                far[at] = np.sqrt(((x - net[cell[at]]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(cell), pa.array(far)], ["id", "row", "ask", "dim", "v", "cell", "far"])

    return rows.select("id", "row", "ask", "dim", "v").mapInArrow(lean(run), "id long, row long, ask boolean, dim int, v array<double>, cell int, far double")


def _searched(units: DataFrame, parallelism: int, k: int) -> DataFrame:
    """The k best of each query in each unit: rows (dim, qcell, qblock, cell, block, asks, bar, id, row, v), queries with ``asks``."""
    key = ["dim", "qcell", "qblock", "cell", "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (dim, *_), t in by_key(batches, key):
            ask, ids, row, bar = (t[c].to_numpy() for c in ("asks", "id", "row", "bar"))
            if not ask.any() or ask.all():
                continue
            v = t["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
            x_id, x_row = ids[~ask], row[~ask]
            best, place, _ = search(v[ask], row[ask], bar[ask], v[~ask], x_id, x_row, k)
            who, col = np.nonzero(place >= 0)
            p = place[who, col]
            yield pa.RecordBatch.from_arrays([pa.array(ids[ask][who]), pa.array(row[ask][who]), pa.array(x_id[p]), pa.array(x_row[p]), pa.array(best[who, col].astype(np.int64))], ["query_id", "query_row", "id", "row", "score"])

    dealt = units.select(*key, "asks", "bar", "id", "row", "v").repartition(parallelism, *key).sortWithinPartitions(*key)
    return dealt.mapInArrow(lean(run), "query_id long, query_row long, id long, row long, score long")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, id and score of each query's k best candidates; ``is_query`` is a condition over ``id``."""
    tasks = max(cpu_parallelism(vectors.sparkSession), 1)
    rows = checkpointed(integers(vectors, id_col, vector_col).withColumn("dim", F.size("v")).withColumn("ask", F.coalesce(is_query, F.lit(False))).where("dim > 0"))
    n = rows.count()
    wanted = max(1, min(PIVOTS, n // DATA_BLOCK))
    pivots: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64(F.lit("pivot"), "row"), "row").limit(wanted).select("dim", "v").collect():
        pivots.setdefault(r["dim"], []).append(r["v"])
    nets = {dim: np.unique(np.array(v), axis=0) for dim, v in pivots.items()}
    placed = checkpointed(_celled(rows, nets))

    # a row for each cell (at most one a pivot, and one for each length without pivots)
    centers = vectors.sparkSession.createDataFrame([(dim, i, v) for dim, net in nets.items() for i, v in enumerate(net.tolist())], "dim int, cell int, center array<double>")
    cut = lambda rows, most: F.greatest(F.ceil(rows / most), F.lit(1)).cast("int")
    cells = placed.groupBy("dim", "cell").agg(F.max("far").alias("radius"), cut(F.count("*"), DATA_BLOCK).alias("blocks"), F.count_if("ask").alias("asks"), F.max(F.when(F.col("ask"), F.col("far"))).alias("ask_radius"), cut(F.count_if("ask"), QUERY_BLOCK).alias("ask_blocks"))
    cells = checkpointed(cells.join(centers, ["dim", "cell"], "left").withColumn("norm", F.sqrt(F.aggregate(F.coalesce("center", F.array()), F.lit(0.0), lambda s, x: s + x * x))))
    within = lambda m: F.pmod(F.xxhash64("row"), F.col(m)).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    dealt = checkpointed(placed.join(cells.select("dim", "cell", "blocks", "ask_blocks"), ["dim", "cell"]).withColumns({"block": within("blocks"), "ask_block": within("ask_blocks")}))
    none = F.lit(float("-inf"))

    # 1: every query in one block of its own cell
    asks = dealt.where("ask").select("dim", F.col("cell").alias("qcell"), F.col("ask_block").alias("qblock"), "id", "row", "v")
    own = asks.select("dim", "qcell", "qblock", F.col("qcell").alias("cell"), F.lit(0).alias("block"), F.lit(True).alias("asks"), none.alias("bar"), "id", "row", "v")
    near = dealt.where("block = 0").select("dim", F.col("cell").alias("qcell"), each("ask_blocks").alias("qblock"), "cell", "block", F.lit(False).alias("asks"), none.alias("bar"), "id", "row", "v")
    first = checkpointed(_searched(own.unionAll(near), tasks, k))
    bars = first.groupBy(F.col("query_row").alias("row")).agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("bar"))
    asks = checkpointed(asks.join(bars, "row", "left").withColumn("bar", F.coalesce("bar", none)))

    # 2: the pairs of cells that may hold more
    zero = F.lit(0.0)
    mine = cells.where("asks > 0").join(asks.groupBy("dim", F.col("qcell").alias("cell")).agg(F.min("bar").alias("bar")), ["dim", "cell"])
    mine = mine.select("dim", F.col("cell").alias("qcell"), F.col("center").alias("a"), F.col("ask_radius").alias("r"), F.col("norm").alias("an"), "bar", F.col("ask_blocks").alias("qblocks"))
    pairs = mine.join(cells.select("dim", "cell", F.col("center").alias("b"), F.col("radius").alias("s"), F.col("norm").alias("bn"), "blocks"), "dim")
    dot = F.coalesce(F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), zero, lambda s, x: s + x), zero)
    top = dot + F.col("r") * F.col("bn") + F.col("s") * F.col("an") + F.col("r") * F.col("s")
    pairs = checkpointed(pairs.where(top + F.abs(top) * 1e-9 + 1e-6 >= F.col("bar")).select("dim", "qcell", "cell", "qblocks", "blocks"))
    ask_units = asks.join(pairs, ["dim", "qcell"]).select("dim", "qcell", "qblock", "cell", each("blocks").alias("block"), F.lit(True).alias("asks"), "bar", "id", "row", "v")
    data_units = dealt.select("dim", "cell", "block", "id", "row", "v").join(pairs, ["dim", "cell"]).select("dim", "qcell", each("qblocks").alias("qblock"), "cell", "block", F.lit(False).alias("asks"), none.alias("bar"), "id", "row", "v")
    units = ask_units.unionByName(data_units).where("qcell <> cell OR block <> 0")

    found = first.unionAll(_searched(units, tasks, k))
    order = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS line, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.line, q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score FROM v AS q JOIN v ON q.line <> v.line WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY line ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

"""Gradient-boosted trees in numpy: histogram splits, monotonic constraints, flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Trees of one depth laid end to end: node i goes to ``left[i]`` if x[feature[i]] <= threshold[i], else to right[i]; a leaf goes to itself."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Sum of the leaf values of every row of ``x``, all rows at once."""
        out, rows = np.full(len(x), self.bias), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out += self.value[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: int = 8) -> Forest:
    """Logistic loss, Newton leaves.  monotone[f] = -1 makes the margin non-increasing in feature f, 1 non-decreasing, 0 free.

    A split on a constrained feature is taken only if its two leaf values have
    the right order; both children are then bounded by the middle of the two,
    so that no later split can break the order.  With no rows or one class
    only, the forest is its bias.
    """
    n, k = x.shape
    share = (y.sum() + 0.5) / (n + 1)
    nodes: list[list[float]] = []
    roots: list[int] = []
    bias = float(np.log(share / (1 - share)))
    if n and 0 < y.sum() < n:
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(k)]
        code = np.stack([np.searchsorted(edges[f], x[:, f], "left") for f in range(k)], 1)
        flat = code + np.arange(k) * bins
        margin = np.full(n, bias)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, p * (1 - p)
            roots.append(len(nodes))
            nodes.append([0, 0.0, 0, 0, 0.0])
            todo = [(roots[-1], np.arange(n), -np.inf, np.inf, 0)]
            while todo:
                node, rows, low, high, level = todo.pop()
                gs, hs = g[rows].sum(), h[rows].sum()
                value = float(np.clip(gs / (hs + l2), low, high))
                best = None
                if level < depth and len(rows) >= 2 * least:
                    keys = flat[rows].ravel()
                    gl = np.bincount(keys, np.repeat(g[rows], k), k * bins).reshape(k, bins).cumsum(1)
                    hl = np.bincount(keys, np.repeat(h[rows], k), k * bins).reshape(k, bins).cumsum(1)
                    cl = np.bincount(keys, minlength=k * bins).reshape(k, bins).cumsum(1)
                    gr, hr = gs - gl, hs - hl
                    vl, vr = np.clip(gl / (hl + l2), low, high), np.clip(gr / (hr + l2), low, high)
                    gain = gl * vl - 0.5 * (hl + l2) * vl**2 + gr * vr - 0.5 * (hr + l2) * vr**2 - (gs * value - 0.5 * (hs + l2) * value**2)
                    order = monotone[:, None] * (vr - vl)
                    allowed = (cl >= least) & (len(rows) - cl >= least) & (order >= 0)
                    gain = np.where(allowed, gain, -1)
                    f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
                    if gain[f, b] > 1e-6 and b < len(edges[f]):
                        best = (int(f), int(b), float(vl[f, b]), float(vr[f, b]))
                if best is None:
                    nodes[node] = [0, np.inf, node, node, rate * value]
                    margin[rows] += rate * value
                    continue
                f, b, left_value, right_value = best
                left = len(nodes)
                nodes += [[0, 0.0, 0, 0, 0.0], [0, 0.0, 0, 0, 0.0]]
                nodes[node] = [f, float(edges[f][b]), left, left + 1, 0.0]
                goes = code[rows, f] <= b
                middle = (left_value + right_value) / 2
                bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[int(monotone[f])]
                todo += [(left, rows[goes], *bounds[0], level + 1), (left + 1, rows[~goes], *bounds[1], level + 1)]
    a = np.array(nodes, float).reshape(-1, 5)
    return Forest(np.array(roots, np.int64), a[:, 0].astype(np.int64), a[:, 1], a[:, 2].astype(np.int64), a[:, 3].astype(np.int64), a[:, 4], depth, bias)

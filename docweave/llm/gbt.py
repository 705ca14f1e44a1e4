"""Histogram gradient-boosted trees in numpy, and isotonic calibration.

Trees are complete to their depth and lie in flat arrays, so all rows walk
down together: one gather and one comparison for each level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    feature: np.ndarray  # (trees, 2**depth - 1)
    cut: np.ndarray  # (trees, 2**depth - 1); right if value > cut
    leaf: np.ndarray  # (trees, 2**depth)
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if not len(x):
            return out
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - inner]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -30, 30)))


def bin_edges(x: np.ndarray, bins: int = 63) -> list[np.ndarray]:
    """Inner cuts of each feature, at quantiles of the distinct values."""
    cuts = []
    for col in x.T:
        values = np.unique(col)
        if len(values) > bins:
            values = np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)))
        cuts.append((values[1:] + values[:-1]) / 2)
    return cuts


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, l2: float = 2.0, least: int = 8, bins: int = 63) -> Forest:
    """Logistic loss; every level's histograms are one bincount per feature."""
    n, width = x.shape
    prior = (y.sum() + 1.0) / (n + 2.0)
    base = float(np.log(prior / (1 - prior)))
    inner = 2**depth - 1
    feature, cut, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    if n == 0 or width == 0:
        return Forest(feature, cut, leaf, base)
    cuts = bin_edges(x, bins)
    codes = np.column_stack([np.searchsorted(c, col, "left") for c, col in zip(cuts, x.T, strict=True)])
    size = max(len(c) for c in cuts) + 1
    margin = np.full(n, base)
    for t in range(trees):
        p = 1.0 / (1.0 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            k, first = 2**level, 2**level - 1
            best, pick, where = np.full(k, 1e-9), np.zeros(k, np.int64), np.full(k, size)
            for f in range(width):
                at = node * size + codes[:, f]
                G = np.bincount(at, g, k * size).reshape(k, size).cumsum(axis=1)
                H = np.bincount(at, h, k * size).reshape(k, size).cumsum(axis=1)
                N = np.bincount(at, minlength=k * size).reshape(k, size).cumsum(axis=1)
                gt, ht, nt = G[:, -1:], H[:, -1:], N[:, -1:]
                gain = G**2 / (H + l2) + (gt - G) ** 2 / (ht - H + l2) - gt**2 / (ht + l2)
                gain[(N < least) | (nt - N < least)] = -1
                s = gain.argmax(axis=1)
                got = gain[np.arange(k), s]
                better = got > best
                best[better], pick[better], where[better] = got[better], f, s[better]
            feature[t, first : first + k] = pick
            cut[t, first : first + k] = [cuts[f][s] if s < len(cuts[f]) else np.inf for f, s in zip(pick, where, strict=True)]
            node = 2 * node + (codes[np.arange(n), pick[node]] > where[node])
        gs, hs = np.bincount(node, g, inner + 1), np.bincount(node, h, inner + 1)
        leaf[t] = rate * gs / (hs + l2)
        margin += leaf[t][node]
    return Forest(feature, cut, leaf, base)


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (knots, values), for interpolation."""
    if not len(score):
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    order = np.argsort(score, kind="stable")
    xs, ys = score[order], y[order].astype(float)
    blocks: list[list[float]] = []  # sum, count, first, last
    for x, v in zip(xs, ys, strict=True):
        blocks.append([v, 1.0, x, x])
        while len(blocks) > 1 and (blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1] or blocks[-2][3] == blocks[-1][2]):
            s, c, _, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + c, blocks[-1][2], last]
    # A pseudo-count keeps end blocks of few rows off 0 and 1.
    knots = [k for s, c, a, b in blocks for k in ((a,) if a == b else (a, b))]
    values = [(s + 0.5) / (c + 1.0) for s, c, a, b in blocks for _ in ((a,) if a == b else (a, b))]
    return np.array(knots), np.maximum.accumulate(np.array(values))


def auc(score: np.ndarray, y: np.ndarray) -> float:
    _, at, n = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[at]
    pos = y == 1
    a, b = int(pos.sum()), int((~pos).sum())
    return float((rank[pos].sum() - a * (a + 1) / 2) / (a * b)) if a and b else float("nan")

"""Histogram gradient-boosted trees for a 0/1 label, in numpy: trained on the driver, scored in flat arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class FlatTrees:
    """Complete trees of one depth; node i of a tree has the children 2i+1 (value <= cut) and 2i+2."""

    depth: int
    base: float
    feature: np.ndarray  # trees x (2^depth - 1)
    cut: np.ndarray  # same shape
    leaf: np.ndarray  # trees x 2^depth

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            total += v[node - (2**self.depth - 1)]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def train(
    x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.2, l2: float = 1.0, least: float = 2.0
) -> FlatTrees:
    """Second-order boosting of the logistic loss, one level of a tree at a time.

    Values are cut into at most `bins` quantile bins a feature. With one class or no rows the
    result is a constant.
    """
    n, width = x.shape
    inner = 2**depth - 1
    p0 = (y.sum() + 0.5) / (n + 1.0)
    base = float(np.log(p0 / (1 - p0)))
    out = FlatTrees(depth, base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    if n == 0 or y.min() == y.max():
        return out
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(width)], 1)
    code = binned + np.arange(width) * bins
    margin = np.full(n, base)
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            count, first = 2**level, 2**level - 1
            at = ((node - first)[:, None] * (width * bins) + code).ravel()
            size = count * width * bins
            gs = np.bincount(at, np.repeat(g, width), size).reshape(count, width, bins)
            hs = np.bincount(at, np.repeat(h, width), size).reshape(count, width, bins)
            gl, hl = gs.cumsum(2), hs.cumsum(2)
            gt, ht = gl[:, :1, -1:], hl[:, :1, -1:]
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            gain[(hl < least) | (ht - hl < least)] = 0
            for j in range(width):
                gain[:, j, len(cuts[j]) :] = 0
            best = gain.reshape(count, -1).argmax(1)
            for k in range(count):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-9:
                    feature[first + k], cut[first + k] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        slot = node - inner
        leaf = -rate * np.bincount(slot, g, inner + 1) / (np.bincount(slot, h, inner + 1) + l2)
        margin += leaf[slot]
        features.append(feature)
        thresholds.append(cut)
        leaves.append(leaf)
    return FlatTrees(depth, base, np.array(features), np.array(thresholds), np.array(leaves))

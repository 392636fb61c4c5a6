"""Histogram gradient-boosted trees in numpy, flattened for vectorised traversal."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Complete binary trees of one depth: node i has children 2i+1 and 2i+2."""

    feature: np.ndarray  # (trees, 2**depth - 1)
    cut: np.ndarray  # same; right if value > cut
    leaf: np.ndarray  # (trees, 2**depth)
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        depth = int(np.log2(inner + 1))
        which = np.arange(trees)[None, :]
        rows = np.arange(len(x))[:, None]
        node = np.zeros((len(x), trees), np.int64)
        for _ in range(depth):
            node = 2 * node + 1 + (x[rows, self.feature[which, node]] > self.cut[which, node])
        return self.start + self.leaf[which, node - inner].sum(axis=1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for a in range(0, len(x), 4096):
            out[a : a + 4096] = 1 / (1 + np.exp(-self.margin(x[a : a + 4096])))
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.15, l2: float = 2.0, least: float = 3.0) -> Forest:
    """Logistic loss; splits by second-order gain over quantile bins. One class only: a constant."""
    n, features = x.shape
    inner, leaves = 2**depth - 1, 2**depth
    share = (y.sum() + 1) / (n + 2)
    start = float(np.log(share / (1 - share)))
    feature, cut, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    if n == 0 or y.min() == y.max():
        return Forest(feature[:1], cut[:1], leaf[:1], start)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(features)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], "left") for f in range(features)], 1)  # > edges[b-1]
    flat = binned + np.arange(features) * bins
    margin = np.full(n, start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            key = ((node - first)[:, None] * (features * bins) + flat).ravel()
            size = count * features * bins
            hg, hh = (np.bincount(key, np.repeat(v, features), size).reshape(count, features, bins) for v in (g, h))
            lg, lh = hg.cumsum(2)[:, :, :-1], hh.cumsum(2)[:, :, :-1]
            tg, th = hg.sum(2, keepdims=True), hh.sum(2, keepdims=True)
            gain = lg**2 / (lh + l2) + (tg - lg) ** 2 / (th - lh + l2) - tg**2 / (th + l2)
            gain[(lh < least) | (th - lh < least)] = -1
            best = gain.reshape(count, -1).argmax(1)
            f, b = best // (bins - 1), best % (bins - 1)
            good = gain.reshape(count, -1)[np.arange(count), best] > 1e-6
            for k in np.flatnonzero(good):
                if b[k] < len(edges[f[k]]):
                    feature[t, first + k], cut[t, first + k] = f[k], edges[f[k]][b[k]]
            here = node - first
            node = 2 * node + 1 + (x[np.arange(n), feature[t, first + here]] > cut[t, first + here])
        key = node - inner
        leaf[t] = -rate * np.bincount(key, g, leaves) / (np.bincount(key, h, leaves) + l2)
        margin += leaf[t][key]
    return Forest(feature, cut, leaf, start)

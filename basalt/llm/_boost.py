"""Histogram gradient-boosted trees for a binary label, kept as flat arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete binary trees of equal depth: node i has children 2 i + 1 and 2 i + 2."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            while inner and node[0] < inner if len(x) else False:
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 10.0, ridge: float = 1.0) -> Trees:
    """Logistic boosting; splits between histogram bins of the features' quantiles.

    With no rows, or one label only, the model is a constant.
    """
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    base = float(np.log(share / (1 - share)))
    inner = (1 << depth) - 1
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    if not len(y) or y.min() == y.max():
        return Trees(feature[:0], threshold[:0], leaf[:0], base)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], 1)
    offset = np.arange(x.shape[1]) * bins
    raw = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, many = (1 << level) - 1, 1 << level
            slot = ((node - first)[:, None] * (x.shape[1] * bins) + offset + binned).ravel()
            size = many * x.shape[1] * bins
            gs, hs = (np.bincount(slot, np.repeat(v, x.shape[1]), size).reshape(many, x.shape[1], bins) for v in (g, h))
            gl, hl = gs.cumsum(2), hs.cumsum(2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(hl < least / 4) | (ht - hl < least / 4)] = -np.inf
            flat = gain.reshape(many, -1)
            best = flat.argmax(1)
            for k in range(many):
                f, b = divmod(int(best[k]), bins)
                if flat[k, best[k]] > 1e-6 and b < len(edges[f]):
                    feature[t, first + k], threshold[t, first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > threshold[t, node])
        at = node - inner
        step = -rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + ridge)
        leaf[t] = step
        raw += step[at]
    return Trees(feature, threshold, leaf, base)

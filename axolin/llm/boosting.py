"""Gradient-boosted trees for two classes, on binned features, in numpy."""

from __future__ import annotations

import numpy as np

BINS = 32


class Trees:
    """Complete binary trees of one depth; a node's feature and bin threshold, a leaf's value."""

    def __init__(self, edges: np.ndarray, base: float, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray):
        self.edges, self.base, self.feature, self.cut, self.leaf = edges, base, feature, cut, leaf

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(self.edges[f], x[:, f], side="left") for f in range(x.shape[1])], axis=1).astype(np.uint8)

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of class 1 for each row."""
        b, out, rows = self.bins(x), np.full(len(x), self.base), np.arange(len(x))
        depth = self.leaf.shape[1].bit_length() - 1
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (b[rows, feature[at]] > cut[at])
            out += leaf[at - (len(leaf) - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 4, rate: float = 0.3, l2: float = 1.0, least: int = 8) -> Trees:
    """Newton boosting of the logistic loss; splits by gain over histograms. The same input gives the same trees."""
    n_features = x.shape[1]
    edges = np.array([np.quantile(np.unique(x[:, f]), np.linspace(0, 1, BINS + 1)[1:-1]) for f in range(n_features)])
    p0 = np.clip(y.mean(), 0.01, 0.99)
    model = Trees(edges, float(np.log(p0 / (1 - p0))), np.zeros((rounds, 2**depth - 1), np.int64), np.full((rounds, 2**depth - 1), BINS, np.int64), np.zeros((rounds, 2**depth)))
    b = model.bins(x).astype(np.int64)
    margin = np.full(len(y), model.base)
    for r in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            slot = (at - first)[:, None] * (n_features * BINS) + np.arange(n_features) * BINS + b
            shape = (width, n_features, BINS)
            sums = [np.cumsum(np.bincount(slot.ravel(), np.repeat(w, n_features), minlength=width * n_features * BINS).reshape(shape), axis=2) for w in (g, h, np.ones(len(y)))]
            (gl, hl, nl), (gt, ht, nt) = sums, [s[:, :, -1:] for s in sums]
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            gain[(nl < least) | (nt - nl < least)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            good = gain.reshape(width, -1)[np.arange(width), best] > 1e-9
            model.feature[r, first : first + width] = np.where(good, best // BINS, 0)
            model.cut[r, first : first + width] = np.where(good, best % BINS, BINS)
            at = 2 * at + 1 + (b[np.arange(len(y)), model.feature[r, at]] > model.cut[r, at])
        leaf = at - (2**depth - 1)
        gs, hs = np.bincount(leaf, g, minlength=2**depth), np.bincount(leaf, h, minlength=2**depth)
        model.leaf[r] = rate * gs / (hs + l2)
        margin += model.leaf[r][leaf]
    return model

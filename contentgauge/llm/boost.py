"""Small gradient-boosted trees for binary labels: histogram splits, logistic loss, numpy only."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Complete binary trees. ``feature`` and ``cut`` are (trees, 2^depth - 1), ``leaf`` (trees, 2^depth)."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of the rows of ``x``."""
        total, rows, inner = np.full(len(x), self.base), np.arange(len(x)), self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            while len(at) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            total += leaf[at - inner]
        return total


def fit(
    x: np.ndarray, y: np.ndarray, trees: int = 100, depth: int = 4, rate: float = 0.15, bins: int = 16, ridge: float = 1.0,
    columns: float = 0.3, seed: int = 0,
) -> Trees:
    """Each tree sees a random share of the ``columns``, so that no single feature decides alone."""
    draw = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    share = y.mean()
    base = float(np.log(share / (1 - share)))
    margin, inner = np.full(len(x), base), 2**depth - 1
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        chosen = draw.choice(len(cuts), max(1, int(columns * len(cuts))), replace=False)
        feature, cut, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(x), np.int64)
        for node in range(inner):
            rows = np.flatnonzero(at == node)
            best = 1e-6
            if len(rows) >= 10:
                g, h = grad[rows], hess[rows]
                whole = g.sum() ** 2 / (h.sum() + ridge)
                for f in chosen:
                    c = cuts[f]
                    if not len(c):
                        continue
                    left_g = np.cumsum(np.bincount(binned[rows, f], g, len(c) + 1))[:-1]
                    left_h = np.cumsum(np.bincount(binned[rows, f], h, len(c) + 1))[:-1]
                    gain = left_g**2 / (left_h + ridge) + (g.sum() - left_g) ** 2 / (h.sum() - left_h + ridge) - whole
                    k = int(gain.argmax())
                    if gain[k] > best:
                        best, feature[node], cut[node] = gain[k], f, c[k]
            at[rows] = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
        leaf = np.zeros(inner + 1)
        for k in range(inner + 1):
            rows = at == inner + k
            leaf[k] = -rate * grad[rows].sum() / (hess[rows].sum() + ridge)
        margin += leaf[at - inner]
        features.append(feature)
        thresholds.append(cut)
        leaves.append(leaf)
    return Trees(base, np.array(features), np.array(thresholds), np.array(leaves))

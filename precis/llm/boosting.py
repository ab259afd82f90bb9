"""Gradient-boosted trees for two classes, on binned features (fitted on the driver).

Features are cut into bins at quantiles; every tree is complete to ``depth`` and greedy: a
node takes the split with the largest second-order gain of the logistic loss, or none (all rows
then go left). Fitting and scoring use no random numbers.
"""

from __future__ import annotations

import numpy as np

BINS = 32


class Trees:
    """``base`` plus the leaves that a row reaches: log-odds of class 1."""

    def __init__(self, edges: list[np.ndarray], base: float, feature: np.ndarray, bin_: np.ndarray, leaf: np.ndarray) -> None:
        self.edges, self.base = edges, base
        # per tree: the inner nodes' features and highest bins to the left, and the leaves
        self.feature, self.bin, self.leaf = feature, bin_, leaf

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], axis=1).astype(np.uint8)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        bins, out = self.binned(x), np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, bin_, leaf in zip(self.feature, self.bin, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            while inner and at[:1].size and at[0] < inner:  # all rows are on one level
                at = 2 * at + 1 + (bins[rows, feature[at]] > bin_[at])
            out += leaf[at - inner]
        return out


def best_splits(bins: np.ndarray, node: np.ndarray, nodes: int, g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """For each node the feature and the highest bin to the left; bin ``BINS``: no split."""
    n, features = bins.shape
    cell = (node[:, None] * features + np.arange(features)) * BINS + bins
    size = nodes * features * BINS
    left_g = np.bincount(cell.ravel(), np.repeat(g, features), size).reshape(nodes, features, BINS).cumsum(axis=2)
    left_h = np.bincount(cell.ravel(), np.repeat(h, features), size).reshape(nodes, features, BINS).cumsum(axis=2)
    all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
    right_g, right_h = all_g - left_g, all_h - left_h
    gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - all_g**2 / (all_h + ridge)
    gain[(left_h < 1e-3) | (right_h < 1e-3)] = -np.inf
    flat = gain.reshape(nodes, -1)
    best = flat.argmax(axis=1)
    good = flat[np.arange(nodes), best] > 1e-6
    return np.where(good, best // BINS, 0), np.where(good, best % BINS, BINS)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.3, ridge: float = 1.0) -> Trees:
    quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
    edges = [np.unique(np.quantile(c, quantiles, method="lower")) if len(c) else np.zeros(1) for c in x.T]
    share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    model = Trees(edges, float(np.log(share / (1 - share))), np.zeros((0, (1 << depth) - 1), np.int64), np.zeros((0, (1 << depth) - 1), np.int64), np.zeros((0, 1 << depth)))
    if not len(y) or y.min() == y.max():
        return model
    bins, score = model.binned(x), np.full(len(y), model.base)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        node, feature, bin_ = np.zeros(len(y), np.int64), [], []
        for level in range(depth):
            f, b = best_splits(bins, node, 1 << level, g, h, ridge)
            feature.append(f)
            bin_.append(b)
            node = 2 * node + (bins[np.arange(len(y)), f[node]] > b[node])
        leaf = rate * np.bincount(node, g, 1 << depth) / (np.bincount(node, h, 1 << depth) + ridge)
        score = score + leaf[node]
        found.append((np.concatenate(feature), np.concatenate(bin_), leaf))
    model.feature, model.bin, model.leaf = (np.stack(part) for part in zip(*found, strict=True))
    return model

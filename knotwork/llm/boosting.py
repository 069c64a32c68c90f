"""Gradient-boosted trees for a yes-or-no label: histogram splits, logistic loss, over numpy arrays."""

from __future__ import annotations

import numpy as np

BINS = 24


def _edges(x: np.ndarray) -> list[np.ndarray]:
    return [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1).astype(np.uint8)


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, depth: int = 5, rate: float = 0.2, ridge: float = 2.0) -> dict:
    """edges, base, and complete trees of this depth: feature, bin (go right above it) and leaf values."""
    edges = _edges(x)
    b = _binned(x, edges)
    n, f = b.shape
    base = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    score = np.full(n, base)
    flat = b.astype(np.int64) + np.arange(f) * (BINS + 1)
    trees = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, BINS, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (f * (BINS + 1)) + flat).ravel()
            size = width * f * (BINS + 1)
            sums = [np.bincount(at, np.repeat(v, f), size).reshape(width, f, BINS + 1) for v in (g, h)]
            left = [np.cumsum(s, axis=2) for s in sums]
            total = [s[:, :, -1:] for s in left]
            gain = left[0] ** 2 / (left[1] + ridge) + (total[0] - left[0]) ** 2 / (total[1] - left[1] + ridge) - total[0] ** 2 / (total[1] + ridge)
            gain[(left[1] < 1.0) | (total[1] - left[1] < 1.0)] = -1
            best = gain.reshape(width, -1).argmax(axis=1)
            good = gain.reshape(width, -1)[np.arange(width), best] > 1e-6
            feature[first : first + width] = np.where(good, best // (BINS + 1), 0)
            cut[first : first + width] = np.where(good, best % (BINS + 1), BINS)
            node = 2 * node + 1 + (b[np.arange(n), feature[node]] > cut[node])
        leaf = node - (2**depth - 1)
        value = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + ridge)
        score += value[leaf]
        trees.append((feature, cut, value))
    return {"edges": edges, "base": base, "trees": trees, "depth": depth}


def decide(model: dict, x: np.ndarray) -> np.ndarray:
    """Log odds of the rows of x."""
    if not len(x):
        return np.zeros(0)
    b = _binned(x, model["edges"])
    rows = np.arange(len(b))
    score = np.full(len(b), model["base"])
    for feature, cut, value in model["trees"]:
        node = np.zeros(len(b), np.int64)
        for _ in range(model["depth"]):
            node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
        score += value[node - (2 ** model["depth"] - 1)]
    return score

"""Gradient-boosted trees for yes or no, small enough to be sent along: histograms of binned features, trees of one depth."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Trees:
    """``feature`` and ``cut`` of each tree's inner nodes, in the order of a heap, and the values of its leaves."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """``x`` has a row per feature."""
        depth = int(np.log2(self.leaf.shape[1]))
        out = np.full(x.shape[1], self.base)
        rows = np.arange(x.shape[1])
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(x.shape[1], dtype=np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[feature[at], rows] > cut[at])
            out += leaf[at - (leaf.size - 1)]
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 50, depth: int = 4, rate: float = 0.25, penalty: float = 1.0) -> Trees:
    """Fit to labels 0 and 1. Each level takes, for each of its nodes, the cut with the best second-order gain."""
    cuts = [np.unique(np.quantile(f, np.linspace(0, 1, BINS + 1)[1:-1])) for f in x]
    binned = np.stack([np.searchsorted(c, f, side="left") for c, f in zip(cuts, x, strict=True)])
    share = np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    score = np.full(len(y), base)
    out = Trees(base, np.zeros((trees, (1 << depth) - 1), dtype=np.int64), np.zeros((trees, (1 << depth) - 1)), np.zeros((trees, 1 << depth)))
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (p - y), weight * p * (1 - p)
        at = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            local = at - first
            best = np.full(width, 1e-9)
            chosen = np.zeros(width, dtype=np.int64)
            place = np.full(width, BINS, dtype=np.int64)
            for f in range(len(x)):
                key = local * BINS + binned[f]
                gs = np.bincount(key, weights=g, minlength=width * BINS).reshape(width, BINS).cumsum(axis=1)
                hs = np.bincount(key, weights=h, minlength=width * BINS).reshape(width, BINS).cumsum(axis=1)
                ga, ha = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + penalty) + (ga - gs) ** 2 / (ha - hs + penalty) - ga**2 / (ha + penalty)
                gain[:, len(cuts[f]):] = 0
                top = gain.argmax(axis=1)
                better = gain[np.arange(width), top] > best
                best[better] = gain[np.arange(width), top][better]
                chosen[better], place[better] = f, top[better]
            out.feature[t, first : first + width] = chosen
            out.cut[t, first : first + width] = [cuts[f][k] if k < len(cuts[f]) else np.inf for f, k in zip(chosen, place, strict=True)]
            at = 2 * at + 1 + (binned[chosen[local], np.arange(len(y))] > place[local])
        local = at - ((1 << depth) - 1)
        gs, hs = (np.bincount(local, weights=v, minlength=1 << depth) for v in (g, h))
        out.leaf[t] = -rate * gs / (hs + penalty)
        score = score + out.leaf[t][local]
    return out

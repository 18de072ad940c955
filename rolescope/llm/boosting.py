"""Gradient-boosted trees with logistic loss on binned features, and their calibration; arrays only."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 32


def bin_edges(x: np.ndarray) -> list[np.ndarray]:
    """Upper edges of at most ``BINS`` bins of each feature."""
    out = []
    for column in x.T:
        values = np.unique(column)
        if len(values) > BINS:
            values = np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:]))
        out.append(values[:-1])
    return out


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)]).astype(np.uint8) if len(x) else np.empty((0, len(edges)), np.uint8)


@dataclass
class BoostedTrees:
    edges: list[np.ndarray]
    base: float
    depth: int
    #: Of each tree: feature and bin of each inner node in heap order, and the value of each leaf.
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = binned(x, self.edges)
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
            out += leaf[node - (2**self.depth - 1)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.25, ridge: float = 1.0, least: float = 3.0) -> BoostedTrees:
    """Second-order boosting; a node that no split improves passes its rows on unsplit."""
    edges = bin_edges(x)
    b = binned(x, edges)
    n, k = b.shape
    share = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
    model = BoostedTrees(edges, float(np.log(share / (1 - share))), depth)
    margin = np.full(n, model.base)
    flat = b.astype(np.int64) + np.arange(k) * BINS
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        inner = 2**depth - 1
        feature, cut = np.zeros(inner, np.int64), np.full(inner, 255, np.int64)
        node = np.zeros(n, np.int64)
        for parent in range(inner):
            own = np.flatnonzero(node == parent)
            if len(own) > 1:
                index = flat[own].ravel()
                gs = np.bincount(index, np.repeat(g[own], k), k * BINS).reshape(k, BINS).cumsum(1)
                hs = np.bincount(index, np.repeat(h[own], k), k * BINS).reshape(k, BINS).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain[(hs < least * 0.05) | (ht - hs < least * 0.05)] = 0
                best = int(gain.argmax())
                if gain.flat[best] > 1e-6:
                    feature[parent], cut[parent] = best // BINS, best % BINS
            right = b[own, feature[parent]] > cut[parent]
            node[own] = 2 * parent + 1 + right
        leaf_of = node - inner
        leaves = 2**depth
        value = -rate * np.bincount(leaf_of, g, leaves) / (np.bincount(leaf_of, h, leaves) + ridge)
        margin += value[leaf_of]
        model.trees.append((feature, cut, value))
    return model


@dataclass
class Calibrated:
    """Trees with a logistic calibration of their margin and the threshold that served held-out rows best."""

    trees: BoostedTrees
    slope: float
    shift: float
    threshold: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.trees.margin(x) + self.shift, -40, 40)))


def fit_calibrated(x: np.ndarray, y: np.ndarray, seed: int = 11, **params) -> Calibrated:
    """Fit on four fifths of the rows, calibrate and choose the threshold of the best F1 on the rest."""
    rng = np.random.default_rng(seed)
    held = rng.random(len(y)) < 0.2
    if not held.any() or held.all() or len(set(y[held].tolist())) < 2:
        held = np.zeros(len(y), bool)
        trees = fit_trees(x, y, **params)
        return Calibrated(trees, 1.0, 0.0, 0.5)
    trees = fit_trees(x[~held], y[~held], **params)
    m, t = trees.margin(x[held]), y[held].astype(float)
    slope, shift = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(slope * m + shift, -40, 40)))
        slope -= 0.05 * ((p - t) * m).mean()
        shift -= 0.05 * (p - t).mean()
    p = 1 / (1 + np.exp(-np.clip(slope * m + shift, -40, 40)))
    best = (-1.0, 0.5)
    for cut in np.linspace(0.1, 0.9, 17):
        hit = p >= cut
        f1 = 2 * (hit & (t > 0)).sum() / max(hit.sum() + t.sum(), 1)
        # Of equally good thresholds the one nearest to one half.
        best = max(best, (round(float(f1), 6), -abs(cut - 0.5), cut), key=lambda z: z[:2] if len(z) == 3 else (z[0], -1.0))
    return Calibrated(trees, slope, shift, float(best[-1]))

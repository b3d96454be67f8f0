"""Gradient-boosted trees for a binary label, in numpy, flattened into node arrays, with monotonic constraints.

Features are numbers without nulls; of splits of equal gain the first feature and threshold is taken; repeated rows weigh
as often as they occur; without rows there is nothing to fit, and the caller keeps to its rules.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Node arrays of all trees; `roots` are the first nodes.  A leaf is its own child on both sides."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row of x; a row descends all trees level by level."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.bias + self.value[at].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 0.5, ridge: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss over quantile histograms.

    monotone: per feature 1 (the score must not fall as it grows), -1 (not rise) or 0.  A split on a constrained
    feature is taken only if its leaf values are in order; their midpoint then bounds both subtrees.
    """
    n, width = x.shape
    positives = float(y.mean()) if n else 0.5
    bias = float(np.log(np.clip(positives, 1e-6, 1 - 1e-6) / np.clip(1 - positives, 1e-6, 1 - 1e-6)))
    nodes: list[list] = []
    roots = []
    if n and 0 < positives < 1:
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
        binned = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(width)], axis=1)
        margin = np.full(n, bias)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = y - p, np.maximum(p * (1 - p), 1e-9)
            roots.append(len(nodes))
            update = np.zeros(n)

            def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
                me = len(nodes)
                g, h = grad[rows].sum(), hess[rows].sum()
                value = float(np.clip(g / (h + ridge), low, high))
                nodes.append([0, np.inf, me, me, value * rate])
                best = (1e-6, -1, 0, 0.0, 0.0)
                if level < depth and h > 2 * least:
                    for f in range(width):
                        if not len(cuts[f]):
                            continue
                        b = binned[rows, f]
                        gs = np.cumsum(np.bincount(b, grad[rows], len(cuts[f]) + 1))[:-1]
                        hs = np.cumsum(np.bincount(b, hess[rows], len(cuts[f]) + 1))[:-1]
                        lv, rv = np.clip(gs / (hs + ridge), low, high), np.clip((g - gs) / (h - hs + ridge), low, high)
                        gain = gs**2 / (hs + ridge) + (g - gs) ** 2 / (h - hs + ridge) - g * g / (h + ridge)
                        gain[(hs < least) | (h - hs < least) | (monotone[f] * (rv - lv) < 0)] = -1
                        k = int(gain.argmax())
                        if gain[k] > best[0]:
                            best = (float(gain[k]), f, k, float(lv[k]), float(rv[k]))
                if best[1] < 0:
                    update[rows] = value * rate
                    return me
                _, f, k, lv, rv = best
                middle = (lv + rv) / 2
                side = binned[rows, f] <= k
                bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[int(monotone[f])]
                left = grow(rows[side], level + 1, *bounds[0])
                right = grow(rows[~side], level + 1, *bounds[1])
                nodes[me] = [f, float(cuts[f][k]), left, right, 0.0]
                return me

            grow(np.arange(n), 0, -np.inf, np.inf)
            margin += update
    table = list(zip(*nodes, strict=True)) if nodes else [(), (), (), (), ()]
    kinds = (np.int32, np.float64, np.int32, np.int32, np.float64)
    arrays = [np.array(c, k) for c, k in zip(table, kinds, strict=True)]
    return Trees(*arrays, roots=np.array(roots, np.int32), depth=depth, bias=bias)

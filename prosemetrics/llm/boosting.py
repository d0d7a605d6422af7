"""Histogram gradient-boosted trees in numpy, flattened into arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """All trees of a model end to end.  A node sends values up to ``threshold`` of its ``feature``
    to ``left`` and others to the node after that; a leaf is its own left child."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row of ``x``: all rows go down each tree together."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                below = self.left[node]
                right = x[rows, self.feature[node]] > self.threshold[node]
                node = np.where(below == node, node, below + right)
            total += self.value[node]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margin(x)))


def bin_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Cut points of each feature at its quantiles; equal ones once."""
    shares = np.linspace(0, 1, bins + 1)[1:-1]
    return [np.unique(np.quantile(column, shares, method="lower")) for column in x.T]


def fit(
    x: np.ndarray,
    y: np.ndarray,
    trees: int = 60,
    depth: int = 4,
    rate: float = 0.2,
    bins: int = 64,
    least_weight: float = 5.0,
    ridge: float = 1.0,
    weight: np.ndarray | None = None,
) -> Trees:
    """Boosted trees for 0/1 labels by logistic loss.

    Features are binned once; a node's best split comes from the histograms of gradients and
    curvatures of its rows.  Without rows, or with one label only, the model is a constant.
    """
    n = len(y)
    weight = np.ones(n) if weight is None else weight
    positive, total = float((weight * y).sum()), float(weight.sum())
    share = (positive + 1) / (total + 2)
    base = float(np.log(share / (1 - share)))
    out: dict[str, list] = {"feature": [], "threshold": [], "left": [], "value": []}
    roots: list[int] = []

    def add(value: float) -> int:
        at = len(out["value"])
        for key, start in (("feature", 0), ("threshold", np.inf), ("left", at), ("value", value)):
            out[key].append(start)
        return at

    if 0 < positive < total:
        edges = bin_edges(x, bins)
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
        width = bins + 1
        margin = np.full(n, base)
        for _ in range(trees):
            p = 1.0 / (1.0 + np.exp(-margin))
            gradient, curve = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-9)
            leaf_value = lambda g, h: -rate * g / (h + ridge)
            root = add(leaf_value(gradient.sum(), curve.sum()))
            roots.append(root)
            level = [(root, np.arange(n))]
            for _ in range(depth):
                following = []
                for node, rows in level:
                    g, h = gradient[rows], curve[rows]
                    best = (1e-6, None)
                    for f, e in enumerate(edges):
                        if not len(e):
                            continue
                        at = binned[rows, f]
                        gl = np.cumsum(np.bincount(at, g, width))[: len(e)]
                        hl = np.cumsum(np.bincount(at, h, width))[: len(e)]
                        wl = np.cumsum(np.bincount(at, weight[rows], width))[: len(e)]
                        gr, hr, wr = g.sum() - gl, h.sum() - hl, weight[rows].sum() - wl
                        gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - g.sum() ** 2 / (h.sum() + ridge)
                        gain[(wl < least_weight) | (wr < least_weight)] = 0
                        k = int(gain.argmax())
                        if gain[k] > best[0]:
                            best = (float(gain[k]), (f, k))
                    if best[1] is None:
                        continue
                    f, k = best[1]
                    goes_left = binned[rows, f] <= k
                    sides = [rows[goes_left], rows[~goes_left]]
                    children = [add(leaf_value(gradient[r].sum(), curve[r].sum())) for r in sides]
                    out["feature"][node], out["threshold"][node], out["left"][node] = f, float(edges[f][k]), children[0]
                    following += list(zip(children, sides))
                level = following
            model = Trees(*(np.array(out[k]) for k in ("feature", "threshold", "left", "value")), np.array([root]), depth, 0.0)
            margin += model.margin(x)
    arrays = [np.array(out[k], dtype=t) for k, t in (("feature", np.int64), ("threshold", float), ("left", np.int64), ("value", float))]
    return Trees(*arrays, np.array(roots, dtype=np.int64), depth, base)

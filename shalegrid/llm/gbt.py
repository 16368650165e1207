"""Gradient-boosted trees for a binary target: histogram splits, monotonic constraints, flat node arrays for scoring."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    """All trees' nodes one after another. A leaf has feature -1; children are indices into the same arrays."""

    base: float
    feature: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    threshold: np.ndarray = field(default_factory=lambda: np.zeros(0))
    left: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    right: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))
    roots: list[int] = field(default_factory=list)
    depth: int = 0

    def margin(self, x: np.ndarray) -> np.ndarray:
        """The log-odds of each row; a whole level of a tree at a time."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root, np.int32)
            for _ in range(self.depth):
                f = self.feature[at]
                inner = f >= 0
                down = np.where(x[rows, np.maximum(f, 0)] <= self.threshold[at], self.left[at], self.right[at])
                at = np.where(inner, down, at)
            out += self.value[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, signs: list[int], rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: int = 20) -> Trees:
    """Trees for P(y = 1). signs: for each feature 1 (may only raise it), -1 (may only lower it) or 0.

    No rows, or rows of one class, give no trees: the smoothed share of the class for all.
    """
    n, y = len(y), np.asarray(y, float)
    share = (y.sum() + 1) / (n + 2)
    out = Trees(float(np.log(share / (1 - share))), depth=depth)
    if n == 0 or y.min() == y.max():
        return out
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    nodes: list[list] = []
    margin = np.full(n, out.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        step = np.zeros(n)

        def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
            gs, hs = g[rows].sum(), h[rows].sum()
            here = len(nodes)
            value = float(np.clip(gs / (hs + ridge), low, high))
            nodes.append([-1, 0.0, here, here, rate * value])
            best = None
            if level < depth and len(rows) >= 2 * least:
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    b = binned[rows, j]
                    gl, hl, cl = (np.cumsum(np.bincount(b, w, len(e) + 1))[:-1] for w in (g[rows], h[rows], None))
                    vl, vr = (np.clip(a / (c + ridge), low, high) for a, c in ((gl, hl), (gs - gl, hs - hl)))
                    gain = gl * vl - 0.5 * (hl + ridge) * vl**2 + (gs - gl) * vr - 0.5 * (hs - hl + ridge) * vr**2
                    gain = np.where((cl < least) | (len(rows) - cl < least) | (signs[j] * (vr - vl) < 0), -np.inf, gain)
                    k = int(np.argmax(gain))
                    if best is None or gain[k] > best[0]:
                        best = gain[k], j, k, float(vl[k]), float(vr[k])
            if best is None or best[0] <= gs * value - 0.5 * (hs + ridge) * value**2 + 1e-6:
                step[rows] = rate * value
                return here
            _, j, k, vl, vr = best
            middle = (vl + vr) / 2
            to_left = binned[rows, j] <= k
            bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}.get(signs[j], ((low, high), (low, high)))
            nodes[here][:2] = [j, float(edges[j][k])]
            nodes[here][2] = grow(rows[to_left], level + 1, *bounds[0])
            nodes[here][3] = grow(rows[~to_left], level + 1, *bounds[1])
            return here

        out.roots.append(grow(np.arange(n), 0, -np.inf, np.inf))
        margin += step
    f, t, a, b, v = zip(*nodes, strict=True)
    out.feature, out.threshold, out.left, out.right, out.value = np.array(f, np.int32), np.array(t), np.array(a, np.int32), np.array(b, np.int32), np.array(v)
    return out

"""Gradient-boosted trees for a few classes, fitted on a bounded table in numpy.

Softmax loss, second-order gains over histogram bins, probabilities calibrated by a temperature.
"""

from __future__ import annotations

import numpy as np

BINS = 32


class Boosted:
    """``trees[round][class]`` are lists of nodes (feature, threshold, left, right, value); a leaf has feature -1."""

    def __init__(self, classes: list[str], trees: list[list[list[tuple]]] | None = None, temperature: float = 1.0, rate: float = 0.2):
        self.classes, self.trees, self.temperature, self.rate = classes, trees or [], temperature, rate

    @staticmethod
    def _grow(binned: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, lam: float = 1.0, least: float = 2.0) -> list[tuple]:
        nodes: list[tuple] = []

        def make(rows: np.ndarray, d: int) -> int:
            me = len(nodes)
            G, H = g[rows].sum(), h[rows].sum()
            nodes.append((-1, 0.0, -1, -1, float(-G / (H + lam))))
            if d == 0 or len(rows) < 4:
                return me
            best = (1e-6, -1, 0)
            for f in range(binned.shape[1]):
                if not len(edges[f]):
                    continue
                b = binned[rows, f]
                gs, hs = np.bincount(b, g[rows], BINS + 1), np.bincount(b, h[rows], BINS + 1)
                gl, hl = np.cumsum(gs)[:-1], np.cumsum(hs)[:-1]
                gain = gl**2 / (hl + lam) + (G - gl) ** 2 / (H - hl + lam) - G**2 / (H + lam)
                gain[(hl < least * 0.05) | (H - hl < least * 0.05)] = 0
                k = int(np.argmax(gain[: len(edges[f])]))
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, k)
            if best[1] < 0:
                return me
            _, f, k = best
            left = binned[rows, f] <= k
            a = make(rows[left], d - 1)
            b = make(rows[~left], d - 1)
            nodes[me] = (f, float(edges[f][k]), a, b, nodes[me][4])
            return me

        make(np.arange(len(g)), depth)
        return nodes

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 4) -> "Boosted":
        """``y`` holds class numbers. Classes weigh the same in total."""
        n, k = len(x), len(self.classes)
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
        hot = np.eye(k)[y]
        weight = (n / k / np.maximum(1, hot.sum(0)))[y]
        weight = np.minimum(weight, 20.0)
        score = np.zeros((n, k))
        for _ in range(rounds):
            p = np.exp(score - score.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            group = []
            for c in range(k):
                tree = self._grow(binned, edges, weight * (p[:, c] - hot[:, c]), weight * np.maximum(1e-6, p[:, c] * (1 - p[:, c])), depth)
                score[:, c] += self.rate * self._run(tree, x)
                group.append(tree)
            self.trees.append(group)
        return self

    @staticmethod
    def _run(tree: list[tuple], x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        feat, thr, left, right, val = (np.array(c) for c in zip(*tree))
        for _ in range(32):
            f = feat[at]
            inner = f >= 0
            if not inner.any():
                break
            go = x[np.arange(len(x)), np.maximum(f, 0)] <= thr[at]
            at = np.where(inner, np.where(go, left[at], right[at]), at)
        return val[at]

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(self.classes)))
        for group in self.trees:
            for c, tree in enumerate(group):
                out[:, c] += self.rate * self._run(tree, x)
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        s = self.scores(x) / self.temperature
        p = np.exp(s - s.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        """Set the temperature that gives the holdout the greatest likelihood."""
        s, best = self.scores(x), (np.inf, 1.0)
        for t in np.geomspace(0.25, 8.0, 41):
            z = s / t
            nll = float(np.mean(np.log(np.exp(z - z.max(1, keepdims=True)).sum(1)) + z.max(1) - z[np.arange(len(y)), y]))
            if nll < best[0]:
                best = (nll, float(t))
        self.temperature = best[1]
        return self

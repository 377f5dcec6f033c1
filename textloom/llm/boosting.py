"""A small gradient-boosted tree classifier and isotonic calibration, in numpy."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic-loss boosting of depth-limited trees over quantile bins.  Deterministic."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 1.0, least: float = 2.0):
        self.rounds, self.depth, self.rate, self.bins, self.l2, self.least = rounds, depth, rate, bins, l2, least
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> "Boosted":
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        # the smallest value above zero splits sparse rates from none
        self.edges = [np.unique(np.concatenate((e, [0.0]))) for e in self.edges]
        b = np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T)], axis=1)
        p = float(np.clip(np.average(y, weights=w), 1e-4, 1 - 1e-4))
        self.base = float(np.log(p / (1 - p)))
        f = np.full(len(y), self.base)
        n_bins = max(len(e) for e in self.edges) + 1
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-f))
            g, h = w * (q - y), w * np.maximum(q * (1 - q), 1e-6)
            tree, node = [], np.zeros(len(y), dtype=np.int64)
            for level in range(self.depth):
                splits = {}
                for k in range(1 << level):
                    rows = np.flatnonzero(node == k)
                    best = (1e-9, -1, 0)
                    if len(rows):
                        gs, hs = g[rows].sum(), h[rows].sum()
                        for j in range(x.shape[1]):
                            gl = np.cumsum(np.bincount(b[rows, j], g[rows], n_bins))[:-1]
                            hl = np.cumsum(np.bincount(b[rows, j], h[rows], n_bins))[:-1]
                            gain = gl**2 / (hl + self.l2) + (gs - gl) ** 2 / (hs - hl + self.l2) - gs**2 / (hs + self.l2)
                            gain[(hl < self.least * 1e-3) | (hs - hl < self.least * 1e-3)] = 0
                            at = int(gain.argmax())
                            if gain[at] > best[0]:
                                best = (float(gain[at]), j, at)
                    splits[k] = best[1:]
                tree.append(splits)
                j = np.array([splits[k][0] for k in range(1 << level)])[node]
                t = np.array([splits[k][1] for k in range(1 << level)])[node]
                node = node * 2 + ((j >= 0) & (b[np.arange(len(y)), np.maximum(j, 0)] > t))
            leaf = np.array([-self.rate * g[node == k].sum() / (h[node == k].sum() + self.l2) for k in range(1 << self.depth)])
            f = f + leaf[node]
            self.trees.append((tree, leaf))
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        b = np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T)], axis=1) if len(x) else np.zeros((0, len(self.edges)), dtype=int)
        rows = np.arange(len(x))
        for tree, leaf in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for level, splits in enumerate(tree):
                j = np.array([splits[k][0] for k in range(1 << level)])[node]
                t = np.array([splits[k][1] for k in range(1 << level)])[node]
                node = node * 2 + ((j >= 0) & (b[rows, np.maximum(j, 0)] > t))
            f += leaf[node]
        return f


def isotonic(score: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (score, probability) of the weighted monotone fit, by pooling adjacent violators."""
    order = np.argsort(score, kind="stable")
    s, y, w = score[order], y[order].astype(float), w[order].astype(float)
    blocks: list[list[float]] = []  # sum of w*y, sum of w, first and last score
    for a, b, c in zip(s.tolist(), y.tolist(), w.tolist()):
        if blocks and blocks[-1][3] == a:
            blocks[-1][0] += b * c
            blocks[-1][1] += c
        else:
            blocks.append([b * c, c, a, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            x = blocks.pop()
            blocks[-1][0] += x[0]
            blocks[-1][1] += x[1]
            blocks[-1][3] = x[3]
    knots = [(p, v) for num, den, a, b in blocks for p in ((a,) if a == b else (a, b)) for v in (num / den,)]
    return np.array([k[0] for k in knots]), np.array([k[1] for k in knots])

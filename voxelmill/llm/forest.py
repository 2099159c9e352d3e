"""A small random forest (Breiman 2001) for binary labels, vectorised with NumPy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Trees side by side: node arrays of shape (trees, nodes); feature -1 marks a leaf, whose share of label 1 is value."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Mean share of label 1 over the trees, for each row of x."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            while (open_ := self.feature[t, node] >= 0).any():
                f = self.feature[t, node]
                goes_left = x[rows, np.maximum(f, 0)] <= self.threshold[t, node]
                node = np.where(open_, np.where(goes_left, self.left[t, node], self.right[t, node]), node)
            total += self.value[t, node]
        return total / max(1, len(self.feature))


def _split(x: np.ndarray, y: np.ndarray, features: np.ndarray, min_leaf: int) -> tuple[int, float] | None:
    """The feature and threshold of least Gini impurity among the given features."""
    best, n = None, len(y)
    for f in features:
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        cut = np.flatnonzero(v[1:] > v[:-1]) + 1
        cut = cut[(cut >= min_leaf) & (cut <= n - min_leaf)]
        if not len(cut):
            continue
        a, total = ones[cut - 1], ones[-1]
        impurity = 2 * (a - a * a / cut + (total - a) - (total - a) ** 2 / (n - cut)) / n
        k = int(np.argmin(impurity))
        if best is None or impurity[k] < best[0]:
            best = (impurity[k], int(f), float((v[cut[k] - 1] + v[cut[k]]) / 2))
    return None if best is None else best[1:]


def train(x: np.ndarray, y: np.ndarray, n_trees: int = 40, max_depth: int = 12, min_leaf: int = 2, seed: int = 3) -> Forest:
    rng, trees = np.random.default_rng(seed), []
    tried = max(1, int(np.sqrt(x.shape[1])) + 1)
    for _ in range(n_trees):
        nodes: list[list] = []
        stack = [(rng.integers(0, len(y), len(y)), 0, -1, False)]
        while stack:
            rows, depth, parent, is_left = stack.pop()
            at = len(nodes)
            nodes.append([-1, 0.0, 0, 0, float(y[rows].mean())])
            if parent >= 0:
                nodes[parent][2 if is_left else 3] = at
            if depth < max_depth and 0 < nodes[at][4] < 1 and (s := _split(x[rows], y[rows], rng.permutation(x.shape[1])[:tried], min_leaf)):
                nodes[at][:2] = s
                low = x[rows, s[0]] <= s[1]
                stack += [(rows[~low], depth + 1, at, False), (rows[low], depth + 1, at, True)]
        trees.append(nodes)
    out = np.zeros((5, n_trees, max(map(len, trees))))
    out[0] = -1
    for t, nodes in enumerate(trees):
        out[:, t, : len(nodes)] = np.array(nodes).T
    return Forest(out[0].astype(np.int64), out[1], out[2].astype(np.int64), out[3].astype(np.int64), out[4])

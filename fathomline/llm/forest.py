"""A random forest of binary trees in numpy, for feature tables that fit in memory."""

from __future__ import annotations

import numpy as np


def grow(x, y, rng, depth: int, least: int, tries: int) -> list[tuple]:
    """Nodes (feature, cut, left, right, share of positives); feature -1 marks a leaf."""
    nodes: list[tuple] = []

    def split(rows, level) -> int:
        at = len(nodes)
        share = float(y[rows].mean())
        nodes.append((-1, 0.0, -1, -1, share))
        if level == depth or len(rows) < 2 * least or share in (0.0, 1.0):
            return at
        best = None
        for f in rng.choice(x.shape[1], size=tries, replace=False):
            order = np.argsort(x[rows, f], kind="stable")
            value, label = x[rows, f][order], y[rows][order]
            left = np.arange(1, len(rows))
            ones = np.cumsum(label)[:-1]
            ok = (value[1:] > value[:-1]) & (left >= least) & (len(rows) - left >= least)
            if not ok.any():
                continue
            a, b = ones / left, (label.sum() - ones) / (len(rows) - left)
            impurity = np.where(ok, left * a * (1 - a) + (len(rows) - left) * b * (1 - b), np.inf)
            i = int(impurity.argmin())
            if best is None or impurity[i] < best[0]:
                middle = float((value[i] + value[i + 1]) / 2)
                best = (impurity[i], int(f), middle if middle < value[i + 1] else float(value[i]))  # neighbours have no middle
        if best is None:
            return at
        low = x[rows, best[1]] <= best[2]
        nodes[at] = (best[1], best[2], split(rows[low], level + 1), split(rows[~low], level + 1), share)
        return at

    split(np.arange(len(y)), 0)
    return nodes


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 9, least: int = 2, seed: int = 3) -> list[dict]:
    rng = np.random.default_rng(seed)
    tries = max(1, int(np.sqrt(x.shape[1])) + 1)
    forest = []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        nodes = grow(x[rows], y[rows], rng, depth, least, tries)
        columns = list(zip(*nodes, strict=True))
        forest.append({k: np.array(c) for k, c in zip(("feature", "cut", "left", "right", "share"), columns, strict=True)})
    return forest


def predict(forest: list[dict], x: np.ndarray) -> np.ndarray:
    """Mean share of positives over the trees."""
    total = np.zeros(len(x))
    for t in forest:
        at = np.zeros(len(x), int)
        while len(x):
            f = t["feature"][at]
            inner = f >= 0
            if not inner.any():
                break
            low = x[np.arange(len(x)), np.maximum(f, 0)] <= t["cut"][at]
            at = np.where(inner, np.where(low, t["left"][at], t["right"][at]), at)
        total += t["share"][at]
    return total / max(1, len(forest))

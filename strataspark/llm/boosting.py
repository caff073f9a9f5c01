"""Gradient-boosted trees over counted cells of small integer features.

Rows are counted by feature vector before training, so what is fitted here is bounded by the number
of different vectors, whatever the number of rows; the result is that of training on all rows.
A fitted model becomes a SQL expression.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Tree = float | tuple[int, int, "Tree", "Tree"]


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, ridge: float, least: float) -> Tree:
    leaf = float(-g.sum() / (h.sum() + ridge))
    if not depth:
        return leaf
    best, gain = None, 1e-6
    whole = g.sum() ** 2 / (h.sum() + ridge)
    for f in range(x.shape[1]):
        top = int(x[:, f].max(initial=0)) + 1
        gl, hl = np.cumsum(np.bincount(x[:, f], g, top)), np.cumsum(np.bincount(x[:, f], h, top))
        gr, hr = gl[-1] - gl, hl[-1] - hl
        found = np.where((hl > least) & (hr > least), gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - whole, 0)
        at = int(found.argmax())
        if found[at] > gain:
            best, gain = (f, at), found[at]
    if best is None:
        return leaf
    left = x[:, best[0]] <= best[1]
    return (*best, *(_tree(x[m], g[m], h[m], depth - 1, ridge, least) for m in (left, ~left)))


def _apply(tree: Tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    f, at, left, right = tree
    return np.where(x[:, f] <= at, _apply(left, x), _apply(right, x))


def fit(x: np.ndarray, positive: np.ndarray, negative: np.ndarray, rounds: int = 24, depth: int = 3, rate: float = 0.3, ridge: float = 1.0, least: float = 0.5) -> tuple[float, list[Tree]]:
    """Start and trees (already multiplied by rate) for log-odds; x: small integers, a row for each cell."""
    n = positive + negative
    start = float(np.log((positive.sum() + 0.5) / (negative.sum() + 0.5)))
    margin, trees = np.full(len(x), start), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        tree = _scaled(_tree(x, n * p - positive, n * p * (1 - p), depth, ridge, least), rate)
        trees.append(tree)
        margin += _apply(tree, x)
    return start, trees


def _scaled(tree: Tree, rate: float) -> Tree:
    return tree * rate if isinstance(tree, float) else (*tree[:2], _scaled(tree[2], rate), _scaled(tree[3], rate))


def margins(model: tuple[float, list[Tree]], x: np.ndarray) -> np.ndarray:
    return model[0] + sum((_apply(t, x) for t in model[1]), np.zeros(len(x)))


def platt(margin: np.ndarray, positive: np.ndarray, negative: np.ndarray) -> tuple[float, float]:
    """a, b of the calibrated log-odds a * margin + b, by Newton steps with a weak prior."""
    a, b, n = 1.0, 0.0, positive + negative
    for _ in range(30):
        p = 1 / (1 + np.exp(-(a * margin + b)))
        g = np.array([((n * p - positive) * margin).sum() + 0.1 * (a - 1), (n * p - positive).sum() + 0.1 * b])
        w = n * p * (1 - p)
        h = np.array([[(w * margin**2).sum() + 0.1, (w * margin).sum()], [(w * margin).sum(), w.sum() + 0.1]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -1, 1))
    return a, b


def expression(model: tuple[float, list[Tree]], features: list[Column]) -> Column:
    def one(tree: Tree) -> Column:
        return F.lit(tree) if isinstance(tree, float) else F.when(features[tree[0]] <= tree[1], one(tree[2])).otherwise(one(tree[3]))

    out = F.lit(model[0])
    for t in model[1]:
        out = out + one(t)
    return out

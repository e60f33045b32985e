"""Small gradient-boosted trees: fitted with numpy on a bounded labelled sample, scored as a SQL expression."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    """Nested (feature, threshold, left, right) or a leaf value, by the second-order gain."""
    leaf = float(-g.sum() / (h.sum() + 1.0))
    if depth == 0 or len(g) < 4:
        return leaf
    best = (1e-6, None, None)
    whole = g.sum() ** 2 / (h.sum() + 1.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            left = x[:, f] < cut
            gain = g[left].sum() ** 2 / (h[left].sum() + 1) + g[~left].sum() ** 2 / (h[~left].sum() + 1) - whole
            if gain > best[0]:
                best = (gain, f, float(cut))
    if best[1] is None:
        return leaf
    left = x[:, best[1]] < best[2]
    return best[1], best[2], _tree(x[left], g[left], h[left], depth - 1), _tree(x[~left], g[~left], h[~left], depth - 1)


def _value(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    f, cut, a, b = tree
    return np.where(x[:, f] < cut, _value(a, x), _value(b, x))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.3) -> list:
    """Trees for the log-odds of y, by logistic loss; leaf values include the learning rate."""
    out, z = [], np.zeros(len(y))
    scale = lambda t: t * rate if isinstance(t, float) else (t[0], t[1], scale(t[2]), scale(t[3]))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        out.append(scale(_tree(x, p - y, p * (1 - p), depth)))
        z += _value(out[-1], x)
    return out


def score(trees: list, x: np.ndarray) -> np.ndarray:
    return sum((_value(t, x) for t in trees), np.zeros(len(x)))


def threshold(z: np.ndarray, y: np.ndarray, precision: float) -> float:
    """Lowest score at which the held-out precision is reached at every higher cut too; above all scores if none does."""
    best = float(z.max()) + 1.0 if len(z) else float("inf")
    for cut in np.unique(z)[::-1]:
        if y[z >= cut].mean() < precision:
            break
        best = float(cut)
    return best


def expression(trees: list, features: list[Column]) -> Column:
    """The same score as nested CASE WHEN over feature columns."""

    def walk(t) -> Column:
        return F.lit(t) if isinstance(t, float) else F.when(features[t[0]] < F.lit(t[1]), walk(t[2])).otherwise(walk(t[3]))

    return reduce(lambda a, b: a + b, (walk(t) for t in trees), F.lit(0.0))

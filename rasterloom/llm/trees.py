"""Small decision trees and forests, grown in numpy on bounded labelled tables.

Splits minimise Gini impurity; thresholds lie half-way between neighbouring values; the
first best feature and threshold win ties, so growing is deterministic for a seed.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Tree:
    """Nodes in arrays: feature -1 marks a leaf, ``value`` is its share of label 1."""

    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self, value: float) -> int:
        self.feature.append(-1)
        self.threshold.append(0.0)
        self.left.append(-1)
        self.right.append(-1)
        self.value.append(value)
        return len(self.value) - 1

    def score(self, row) -> float:
        at = 0
        while self.feature[at] >= 0:
            at = self.left[at] if row[self.feature[at]] <= self.threshold[at] else self.right[at]
        return self.value[at]


def _best_split(x: np.ndarray, y: np.ndarray, weight: np.ndarray, features: np.ndarray, least: int) -> tuple[int, float] | None:
    best, found = 1e-12, None
    total, ones = weight.sum(), (weight * y).sum()
    gini = 2 * ones / total * (1 - ones / total)
    for f in features:
        order = np.argsort(x[:, f], kind="stable")
        values, w, one = x[order, f], np.cumsum(weight[order]), np.cumsum((weight * y)[order])
        cut = np.flatnonzero(values[1:] > values[:-1])
        cut = cut[(cut + 1 >= least) & (len(y) - cut - 1 >= least)]
        if not len(cut):
            continue
        wl, ol = w[cut], one[cut]
        wr, o_r = total - wl, ones - ol
        gain = gini - (2 * ol * (1 - ol / wl) + 2 * o_r * (1 - o_r / wr)) / total
        i = int(np.argmax(gain))
        if gain[i] > best:
            best, found = gain[i], (int(f), float((values[cut[i]] + values[cut[i] + 1]) / 2))
    return found


def grow(x: np.ndarray, y: np.ndarray, *, depth: int = 8, least: int = 2, weight: np.ndarray | None = None, per_split: int | None = None, rng: np.random.Generator | None = None) -> Tree:
    """``per_split`` features drawn by ``rng`` are tried at each node; all of them by default."""
    weight = np.ones(len(y)) if weight is None else weight
    tree = Tree()

    def node(rows: np.ndarray, level: int) -> int:
        w, t = weight[rows], y[rows]
        at = tree.add(float((w * t).sum() / max(w.sum(), 1e-12)))
        if level == 0 or len(rows) < 2 * least or t.min() == t.max():
            return at
        tried = np.arange(x.shape[1]) if per_split is None else np.sort(rng.choice(x.shape[1], per_split, replace=False))
        split = _best_split(x[rows], t, w, tried, least)
        if split is None:
            return at
        goes_left = x[rows, split[0]] <= split[1]
        tree.feature[at], tree.threshold[at] = split
        tree.left[at] = node(rows[goes_left], level - 1)
        tree.right[at] = node(rows[~goes_left], level - 1)
        return at

    if len(y):
        node(np.arange(len(y)), depth)
    else:
        tree.add(0.0)
    return tree


@dataclass
class Forest:
    trees: list[Tree]

    def score(self, row) -> float:
        return sum(t.score(row) for t in self.trees) / len(self.trees)


def grow_forest(x: np.ndarray, y: np.ndarray, *, trees: int = 40, depth: int = 10, least: int = 2, seed: int = 11) -> Forest:
    rng = np.random.default_rng(seed)
    per_split = max(1, int(np.sqrt(x.shape[1])))
    out = []
    for _ in range(trees):
        drawn = rng.integers(0, len(y), len(y))
        out.append(grow(x[drawn], y[drawn], depth=depth, least=least, per_split=per_split, rng=rng))
    return Forest(out)

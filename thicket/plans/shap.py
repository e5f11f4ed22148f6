"""Feature contributions of trees (Shapley values along the paths), for all rows of a batch at once.

For every leaf, the features on its path form a game: a feature's player takes part with weight one if the row follows the path at all
of that feature's splits, and with the share of training rows that do so otherwise. The Shapley value of each player comes
from the polynomial of subset weights, which is built once for a leaf and divided by one player at a time.
"""

from __future__ import annotations

from math import factorial

import numpy as np

from thicket.operators.binning import NAN, ZERO, ZERO_MISSING
from thicket.plans.model import Node, Tree


def _left(n: Node, v: np.ndarray) -> np.ndarray:
    gone = np.isnan(v)
    if n.cats is not None:
        return np.isin(np.trunc(np.where(gone | (v <= -1), -1, v)), n.cats)
    if n.missing != NAN:
        v = np.where(gone, 0.0, v)
        gone = (np.abs(v) <= ZERO) if n.missing == ZERO_MISSING else np.zeros(len(v), bool)
    return np.where(gone, n.default_left, v <= n.threshold)


def _count(tree: Tree, at: int) -> float:
    return float(tree.nodes[at].count if at >= 0 else tree.leaves[~at].count)


def expected(tree: Tree) -> float:
    """Mean output over the training rows."""
    total = sum(x.count for x in tree.leaves)
    return sum(x.count * x.value for x in tree.leaves) / total if total else tree.leaves[0].value


def _paths(tree: Tree) -> list[tuple[int, list[tuple[int, bool]]]]:
    out, todo = [], [(0 if tree.nodes else -1, [])]
    while todo:
        at, path = todo.pop()
        if at < 0:
            out.append((~at, path))
        else:
            todo += [(tree.nodes[at].left, [*path, (at, True)]), (tree.nodes[at].right, [*path, (at, False)])]
    return out


def tree_contributions(tree: Tree, width: int, x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), width + 1))
    out[:, -1] = expected(tree)
    side = [_left(n, x[:, n.feature]) for n in tree.nodes]
    for leaf, path in _paths(tree):
        share: dict[int, float] = {}
        follows: dict[int, np.ndarray] = {}
        for at, left in path:
            n = tree.nodes[at]
            child = _count(tree, n.left if left else n.right) / max(_count(tree, at), 1.0)
            share[n.feature] = share.get(n.feature, 1.0) * child
            here = side[at] if left else ~side[at]
            follows[n.feature] = follows[n.feature] & here if n.feature in follows else here
        players, m = list(share), len(share)
        weights = [factorial(s) * factorial(m - 1 - s) / factorial(m) for s in range(m)]
        for f in players:
            # weights of subsets of the other players, by size
            poly = np.zeros((len(x), m))
            poly[:, 0] = 1.0
            for j, g in enumerate(p for p in players if p != f):
                one, zero = follows[g].astype(float), share[g]
                poly[:, 1 : j + 2] = poly[:, 1 : j + 2] * zero + poly[:, : j + 1] * one[:, None]
                poly[:, 0] *= zero
            out[:, f] += (poly @ np.array(weights)) * (follows[f] - share[f]) * tree.leaves[leaf].value
    return out


def contributions(trees: list[Tree], num_class: int, width: int, x: np.ndarray, average: bool) -> np.ndarray:
    """Contributions of all features, then the expected value, class by class."""
    out = np.zeros((len(x), num_class, width + 1))
    for i, t in enumerate(trees):
        out[:, i % num_class] += tree_contributions(t, width, x)
    if average:
        out /= max(1, len(trees) // num_class)
    return out.reshape(len(x), -1)

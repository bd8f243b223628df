"""Isolation depths of one category's weeks, for the trees of one block."""

from __future__ import annotations

import numpy as np

from marginwatch.functions.draws import MODULUS, MULTIPLIER

NODE_STRIDE = 7919
EULER_GAMMA = 0.5772156649015329


def mix(x: np.ndarray) -> np.ndarray:
    """Two steps of the generator behind :mod:`marginwatch.functions.draws`."""
    return x * MULTIPLIER % MODULUS * MULTIPLIER % MODULUS


def expected_depth(rows: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``rows`` values."""
    rows = np.asarray(rows, dtype=float)
    many = np.maximum(rows, 3.0)
    usual = 2.0 * (np.log(many - 1.0) + EULER_GAMMA) - 2.0 * (many - 1.0) / many
    return np.where(rows <= 1, 0.0, np.where(rows == 2, 1.0, usual))


def isolation_depths(values: np.ndarray, seeds: np.ndarray, sample_size: int) -> np.ndarray:
    """Depths (trees x rows) at which random splits isolate each row.

    All trees grow together, one level per round. Only a tree's sampled rows decide its
    splits; the other rows follow them, which scores every row on the way.
    """
    n, trees = len(values), len(seeds)
    used = min(n, sample_size)
    height = max(1, int(np.ceil(np.log2(max(used, 2)))))
    lots = mix(seeds[:, None] + np.arange(n) * NODE_STRIDE)
    sampled = np.zeros((trees, n), dtype=bool)
    np.put_along_axis(sampled, np.argsort(lots, axis=1, kind="stable")[:, :used], True, axis=1)
    sampled = sampled.ravel()

    tree, row = np.repeat(np.arange(trees), n), np.tile(np.arange(n), trees)
    node, depth = np.ones(trees * n, dtype=np.int64), np.full(trees * n, -1.0)
    for level in range(height + 1):
        cell = tree * 2 ** (height + 2) + node
        members = np.flatnonzero(sampled)
        members = members[np.argsort(cell[members], kind="stable")]
        cells, starts, sizes = np.unique(cell[members], return_index=True, return_counts=True)
        low = np.minimum.reduceat(values[row[members]], starts, axis=0)
        high = np.maximum.reduceat(values[row[members]], starts, axis=0)

        usable = high > low
        choices = usable.sum(axis=1)
        draw = mix(seeds[tree[members[starts]]] + node[members[starts]] * NODE_STRIDE + 1)
        feature = np.argmax(np.cumsum(usable, axis=1) == (draw % np.maximum(choices, 1) + 1)[:, None], axis=1)
        at = np.arange(len(cells)), feature
        split = low[at] + mix(draw) / float(MODULUS) * (high[at] - low[at])

        mine = np.searchsorted(cells, cell)
        leaf = (sizes <= 1) | (choices == 0) | (level >= height)
        settled = depth >= 0
        depth = np.where(~settled & leaf[mine], level + expected_depth(sizes)[mine], depth)
        right = values[row, feature[mine]] > split[mine]
        node = np.where(depth >= 0, node, node * 2 + right)
    return depth.reshape(trees, n)

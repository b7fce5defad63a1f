"""One tree of a random forest on class sums of cells.

Each tree draws a Poisson number for every record, as a bootstrap of a large table does; the draws
of records that share a cell, a year and a class add up to one draw with their count as its mean.
Splits are those of the Gini index over a random part of the features at each node: intervals of
a continuous input, and single levels of a category against all others.
"""

from __future__ import annotations

import math

import numpy as np

from .cells import Grid


def features_of(grid: Grid) -> list[tuple[int, int | None]]:
    """(feature, level) with the level of an indicator, or None for a continuous input."""
    listed: list[tuple[int, int | None]] = [(i, None) for i in range(len(grid.inputs))]
    for place, (_, levels) in enumerate(grid.categories, len(grid.inputs)):
        listed += [(place, level) for level in range(len(levels))]
    return listed


def gini_tree(
    grid: Grid,
    codes: np.ndarray,
    positive: np.ndarray,
    negative: np.ndarray,
    depth: int,
    random: np.random.Generator,
) -> np.ndarray:
    """Positive share of the leaf of every cell."""
    features = features_of(grid)
    tried = max(1, int(math.sqrt(len(features))))
    share = np.empty(len(codes))
    open_nodes = [(np.arange(len(codes)), 0)]
    while open_nodes:
        inside, level = open_nodes.pop()
        p, q = positive[inside], negative[inside]
        p_sum, q_sum = p.sum(), q.sum()
        share[inside] = p_sum / (p_sum + q_sum) if p_sum + q_sum > 0 else 0.5
        if level == depth or p_sum == 0 or q_sum == 0:
            continue
        best, left = 0.0, None
        whole = (p_sum**2 + q_sum**2) / (p_sum + q_sum)
        for chosen in random.permutation(len(features))[:tried]:
            feature, single = features[chosen]
            own, size = codes[inside, feature], grid.sizes[feature]
            p_side, q_side = np.bincount(own, p, size), np.bincount(own, q, size)
            if single is None:
                p_left, q_left = np.cumsum(p_side)[:-1], np.cumsum(q_side)[:-1]
            else:
                p_left, q_left = p_side[single : single + 1], q_side[single : single + 1]
            p_right, q_right = p_sum - p_left, q_sum - q_left
            n_left, n_right = p_left + q_left, p_right + q_right
            fit = (n_left > 1e-9) & (n_right > 1e-9)
            if not fit.any():
                continue
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = (p_left**2 + q_left**2) / n_left + (p_right**2 + q_right**2) / n_right - whole
            gain = np.where(fit, gain, -np.inf)
            cut = int(gain.argmax())
            if gain[cut] > best + 1e-12:
                best = float(gain[cut])
                left = own <= cut if single is None else own == single
        if left is not None:
            open_nodes.append((inside[left], level + 1))
            open_nodes.append((inside[~left], level + 1))
    return share

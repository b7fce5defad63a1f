"""Histogram boosting on class sums of cells: best leaf first, second-order gains, a leaf penalty.

A round takes the logistic gradient and Hessian of every cell and grows one tree: of all open
leaves the one whose best split gains most is split next, until the budget of leaves is used up. The
gain of a split is ``G^2 / (H + l2)`` of its sides less that of the leaf, and a leaf's value is
``-G / (H + l2)``. A continuous input is split at a cut; a category's levels are ordered by their
own value in the leaf and split like a continuous input, so a side may be any set of levels. Levels
and intervals without training records in a leaf go right. Ties go to the first feature and cut.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Mapping
from typing import NamedTuple

import numpy as np

from ..plans.specifications import BoostingParameters
from .cells import Grid

LEAST_HESSIAN = 1e-3
LEAST_GAIN = 1e-12


class Split(NamedTuple):
    gain: float
    feature: int
    left: np.ndarray  # codes of the feature that go left


class Cells(NamedTuple):
    """Cells of one fold: codes of each feature, training records and weights of each class."""

    codes: np.ndarray
    n: np.ndarray
    positive: np.ndarray
    negative: np.ndarray


class _Leaf(NamedTuple):
    cells: np.ndarray
    g: float
    h: float


def best_split(
    grid: Grid, cells: Cells, inside: np.ndarray, g: np.ndarray, h: np.ndarray, parameters: BoostingParameters
) -> Split | None:
    """The split of a leaf's cells that gains most, or none that keeps enough records on both sides."""
    l2, least = parameters.l2_regularization, parameters.min_samples_leaf
    own_g, own_h, own_n = g[inside], h[inside], cells.n[inside]
    total_g, total_h, total_n = own_g.sum(), own_h.sum(), own_n.sum()
    if total_n < 2 * least or total_h < 2 * LEAST_HESSIAN:
        return None
    found = None
    for feature, size in enumerate(grid.sizes):
        codes = cells.codes[inside, feature]
        n = np.bincount(codes, own_n, size)
        sum_g, sum_h = np.bincount(codes, own_g, size), np.bincount(codes, own_h, size)
        order = np.arange(size)
        if feature >= len(grid.inputs):
            held = np.flatnonzero(n > 0)
            value = sum_g[held] / (sum_h[held] + l2 + LEAST_HESSIAN)
            order = held[np.argsort(value, kind="stable")]
        left_n = np.cumsum(n[order])[:-1]
        left_g, left_h = np.cumsum(sum_g[order])[:-1], np.cumsum(sum_h[order])[:-1]
        right_g, right_h = total_g - left_g, total_h - left_h
        allowed = (left_n >= least) & (total_n - left_n >= least)
        allowed &= (left_h >= LEAST_HESSIAN) & (right_h >= LEAST_HESSIAN)
        if not allowed.any():
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left_g**2 / (left_h + l2) + right_g**2 / (right_h + l2) - total_g**2 / (total_h + l2)
        gain = np.where(allowed, gain, -np.inf)
        cut = int(gain.argmax())
        if gain[cut] > max(LEAST_GAIN, found.gain if found else 0.0):
            found = Split(float(gain[cut]), feature, order[: cut + 1])
    return found


def grow(
    grid: Grid, cells: Cells, g: np.ndarray, h: np.ndarray, parameters: BoostingParameters
) -> Iterable[tuple[np.ndarray, float]]:
    """Cells and value of each leaf of one tree."""
    root = _Leaf(np.arange(len(g)), float(g.sum()), float(h.sum()))
    leaves, waiting, made = {0: root}, [], 1

    def consider(number: int) -> None:
        split = best_split(grid, cells, leaves[number].cells, g, h, parameters)
        if split is not None:
            heapq.heappush(waiting, (-split.gain, number, split))

    consider(0)
    while waiting and len(leaves) < parameters.max_leaf_nodes:
        _, number, split = heapq.heappop(waiting)
        leaf = leaves.pop(number)
        goes_left = np.zeros(grid.sizes[split.feature], bool)
        goes_left[split.left] = True
        left = goes_left[cells.codes[leaf.cells, split.feature]]
        for side in (leaf.cells[left], leaf.cells[~left]):
            leaves[made] = _Leaf(side, float(g[side].sum()), float(h[side].sum()))
            consider(made)
            made += 1
    for leaf in leaves.values():
        yield leaf.cells, -leaf.g / max(leaf.h + parameters.l2_regularization, LEAST_HESSIAN)


def boost(
    grid: Grid, cells: Cells, parameters: BoostingParameters, iterations: Iterable[int]
) -> Mapping[int, np.ndarray]:
    """Log odds of every cell after each of the wanted numbers of rounds, from one fit."""
    wanted = sorted(set(iterations))
    weight = cells.positive + cells.negative
    total, positive = weight.sum(), cells.positive.sum()
    if not 0 < positive < total:
        raise ValueError("A boosting fit needs both classes")
    score = np.full(len(weight), np.log(positive / (total - positive)))
    found = {}
    for done in range(wanted[-1] + 1):
        if done in wanted:
            found[done] = score.copy()
        if done == wanted[-1]:
            break
        p = 1.0 / (1.0 + np.exp(-score))
        g, h = weight * p - cells.positive, weight * p * (1.0 - p)
        for inside, value in grow(grid, cells, g, h, parameters):
            score[inside] += parameters.learning_rate * value
    return found

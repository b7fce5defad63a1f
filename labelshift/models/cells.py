"""Records as cells of a grid: intervals of each continuous input, levels of each category.

A tree over binned inputs is a function of the cell, so a fit needs only the class sums of the
cells. Records are read once, in one grouped aggregate; the table has at most
``bins ** inputs * levels`` rows a fold, however many records there are. Fits run on it in tasks
of their own, one for each fold and candidate or tree, and scores go back by a join on the cell.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..domain import DEFAULT, Domain
from ..functions.joins import bounded
from ..functions.places import with_place

SKETCH_ACCURACY = 10_000
MOST_CELLS = 1 << 20


@dataclass(frozen=True)
class Grid:
    """Cut points of the inputs and levels of the categories; a value equal to a cut is below it.

    Every input has ``bins`` intervals, of which those past its last cut stay empty, so cells of
    folds with other cuts bear the same numbers.
    """

    bins: int
    inputs: tuple[str, ...]
    categories: tuple[tuple[str, tuple[int, ...]], ...]

    def __post_init__(self) -> None:
        if self.n_cells > MOST_CELLS:
            raise ValueError(f"A grid of {self.n_cells} cells passes {MOST_CELLS}: take fewer bins")

    @property
    def sizes(self) -> tuple[int, ...]:
        return (*[self.bins] * len(self.inputs), *[len(levels) for _, levels in self.categories])

    @property
    def n_cells(self) -> int:
        return math.prod(self.sizes)

    def codes(self, cells: np.ndarray) -> np.ndarray:
        """Code of each feature in each cell: a row for each cell."""
        return np.stack(np.unravel_index(cells, self.sizes), axis=1).astype(np.int32)

    def with_cell(self, frame: DataFrame, cuts: Sequence[Column], name: str) -> DataFrame:
        """Add the cell number of a record, from the cut arrays of the inputs; null where an input is
        missing or a level is not declared."""
        placed, number, places = frame, F.lit(0), []
        for position, (source, own) in enumerate(zip(self.inputs, cuts, strict=True)):
            places.append(f"_place_{position}")
            placed = with_place(placed, F.col(source).cast("double"), own, self.bins - 1, places[-1])
            number = number * self.bins + F.when(F.col(source).isNotNull(), F.col(places[-1]))
        for source, levels in self.categories:
            place = F.array_position(F.array(*map(F.lit, levels)), F.col(source).cast("int"))
            number = number * len(levels) + F.nullif(place, F.lit(0)).cast("int") - 1
        return placed.withColumn(name, number.cast("int")).drop(*places)


def interval(value: Column, cuts: Column, bins: int) -> Column:
    """Number of cuts below the value, by a coarse and a fine comparison; null stays null.

    One expression, for few rows; ``Grid.with_cell`` places records.
    """
    side = math.isqrt(bins - 1) + 1

    def below(place: Column) -> Column:
        return F.when(F.get(cuts, place) < value, 1).otherwise(0)

    coarse = F.lit(0)
    for step in range(1, side):
        coarse = coarse + below(F.lit(step * side - 1))
    found = coarse * side
    for step in range(side - 1):
        found = found + below(coarse * side + step)
    return F.when(value.isNotNull(), found)


def make_grid(bins: int, feature_set: str = "core", domain: Domain = DEFAULT) -> Grid:
    return Grid(
        bins,
        tuple(domain.inputs(feature_set)),
        tuple((name, tuple(levels)) for name, levels in domain.categories.items()),
    )


def quantile_cuts(
    rows: DataFrame, keys: Sequence[str], bins: int, feature_set: str = "core", domain: Domain = DEFAULT
) -> dict[tuple, list[list[float]]]:
    """Up to ``bins - 1`` cut points of each input for each key (a fold), from one mergeable sketch."""
    levels = [position / bins for position in range(1, bins)]
    names = domain.inputs(feature_set)
    sketched = rows.groupBy(*keys).agg(
        *[F.percentile_approx(F.col(n).cast("double"), levels, SKETCH_ACCURACY).alias(n) for n in names]
    )
    return {tuple(row[k] for k in keys): [sorted(set(row[n] or [])) for n in names] for row in sketched.collect()}


def cut_column(cuts: Sequence[float]) -> Column:
    return F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<double>")


def with_scores(rows: DataFrame, scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Scores of the cells joined to records; the table is broadcast only below a checked size."""
    return rows.join(bounded(scores), list(keys))

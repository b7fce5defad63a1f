"""Iterative solvers of many cells at once, with their state in a table.

A step is one grouped aggregate over the records of all cells that still move, joined to
the state table and written back; the driver sees only how many cells are left. Several solvers
share the steps, so a run costs as many scans as its slowest solver and not the sum of all.
The updates are column expressions: no cell reaches the driver or a Python worker.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.expressions import clip, counted, expit, log_add_exp, logit, mean, total
from ..functions.local import small_table
from ..functions.storage import written, written_with

SHARE_BOUND = 1e-9
LEAST_SCALE = 2.0**-20
ASCENT_SLACK = 1e-8
# Intervals a unit of the log ratio, and the last unit that is divided.
START_INTERVALS = 128
START_LIMIT = 32
# Records a cell from which reading them once for a start saves more steps than it costs.
START_RECORDS = 50_000


def match(frame: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join by null-safe keys; the size of ``table`` decides how."""
    renamed = table.withColumnsRenamed({key: f"_of_{key}" for key in keys})
    same = [F.col(key).eqNullSafe(F.col(f"_of_{key}")) for key in keys]
    return frame.join(renamed, reduce(Column.__and__, same, F.lit(True)), how).drop(*[f"_of_{key}" for key in keys])


def staged(frame: DataFrame, stages: Sequence[Mapping[str, Column]]) -> DataFrame:
    """Add columns stage by stage, each in a projection of its own."""
    return reduce(lambda held, stage: held.withColumns(dict(stage)), stages, frame)


class Solver:
    """State columns of one kind of problem. ``open`` names the flag of cells that still move."""

    open: str
    bound: tuple[str, ...]  # state columns that the moments read
    weight: str | None = None  # number of equal records that a row stands for

    @property
    def held(self) -> Column | None:
        return None if self.weight is None else F.col(self.weight)

    def first_values(self) -> list[dict[str, Column]]:
        """Values of a record for the first scan, as for ``values``."""
        return []

    def values(self) -> list[dict[str, Column]]:
        """Values of a record that the moments share, in stages that read those before.

        A stage is a projection of its own, so an exponential is taken once and not once for each
        aggregate. Null for cells that do not move.
        """
        return []

    def first(self, started: bool = False) -> list[Column]:
        """Aggregates of the first scan; with given starts, the moments there are among them."""
        raise NotImplementedError

    def start(self, table: DataFrame, started: bool = False) -> DataFrame:
        """State columns from the first aggregates and, if given, the starts."""
        raise NotImplementedError

    def refused(self) -> tuple[Column, str] | None:
        """Condition on the first aggregates that stops the run, with its message."""
        return None

    def moments(self) -> list[Column]:
        """Aggregates of a step; null for cells that do not move."""
        raise NotImplementedError

    def move(self, table: DataFrame) -> DataFrame:
        """State after a step from the state before and the moments."""
        raise NotImplementedError

    def change(self, table: DataFrame, values: Mapping[str, Column]) -> DataFrame:
        """Set state columns of the cells that moved."""
        moving = F.col(self.open)
        return table.withColumns({n: F.when(moving, v).otherwise(F.col(n)) for n, v in values.items()})


class ShareSolver(Solver):
    """Safeguarded Newton search of the concave share likelihood of ``value``."""

    open = "_share_open"
    bound = ("mixture_share",)

    def __init__(self, value: str, tolerance: float, most: int, weight: str | None = None) -> None:
        self.value, self.tolerance, self.most, self.weight = value, tolerance, most, weight

    def _values(self, share: Column, moving: Column) -> list[dict[str, Column]]:
        value, small, density = F.col(self.value), F.col("_small"), F.col("_density")
        above = value > 0
        mixed = F.when(above, (1.0 - share) * small + share).otherwise(1.0 - share + share * small)
        return [
            {"_small": F.when(moving, F.exp(-F.abs(value)))},
            {"_density": mixed},  # relative to the larger one of the two classes
            {
                "_slope": F.when(above, 1.0 - small).otherwise(small - 1.0) / density,
                "_log_density": F.log(density) + F.greatest(value, F.lit(0.0)),
            },
        ]

    def first_values(self) -> list[dict[str, Column]]:
        return self._values(F.lit(0.5), F.lit(True))

    def values(self) -> list[dict[str, Column]]:
        return self._values(F.col("mixture_share"), F.col(self.open))

    def first(self, started: bool = False) -> list[Column]:
        value = F.col(self.value)
        bad = F.count_if(value.isNull() | F.isnan(value)).alias("_n_bad")
        return [counted(self.held).alias("n"), bad, *self.moments()]

    def refused(self) -> tuple[Column, str]:
        return F.col("_n_bad") > 0, f"{self.value} contains non-finite values in cells"

    def start(self, table: DataFrame, started: bool = False) -> DataFrame:
        began = table.withColumns(
            {
                "mixture_share": F.col("mixture_share") if started else F.lit(0.5),
                "_low": F.lit(SHARE_BOUND),
                "_high": F.lit(1.0 - SHARE_BOUND),
                "_tested_low": F.lit(False),
                "_tested_high": F.lit(False),
                "mean_log_likelihood": F.lit(None).cast("double"),
                "optimizer_converged": F.lit(False),
                "optimizer_iterations": F.lit(0),
                self.open: F.lit(True),
            }
        )
        return self.move(began)

    def moments(self) -> list[Column]:
        slope = F.col("_slope")
        return [
            mean(F.col("_log_density"), self.held).alias("_likelihood"),
            mean(slope, self.held).alias("_gradient"),
            mean(slope * slope, self.held).alias("_curvature"),
        ]

    def move(self, table: DataFrame) -> DataFrame:
        share, slope, curvature = F.col("mixture_share"), F.col("_gradient"), F.col("_curvature")
        low, high = F.col("_low"), F.col("_high")
        at_low = (share <= SHARE_BOUND) & (slope <= 0)
        at_high = (share >= 1.0 - SHARE_BOUND) & (slope >= 0)
        staged = self.change(
            table.withColumn("_stays", at_low | at_high | (curvature == 0)),
            {
                "_low": F.when(slope > 0, F.greatest(low, share)).otherwise(low),
                "_high": F.when(slope > 0, high).otherwise(F.least(high, share)),
                "mean_log_likelihood": F.col("_likelihood"),
                "optimizer_iterations": F.col("optimizer_iterations") + 1,
            },
        ).withColumn("_newton", share + F.try_divide(slope, curvature))
        under, over = F.col("_newton") <= low, F.col("_newton") >= high
        middle = 0.5 * (low + high)
        proposed = (
            F.when(under, F.when(F.col("_tested_low"), middle).otherwise(low))
            .when(over, F.when(F.col("_tested_high"), middle).otherwise(high))
            .otherwise(F.col("_newton"))
        )
        proposed = F.when(F.col("_stays"), share).otherwise(proposed)
        goes_on = ~F.col("_stays")
        settled = F.col("_stays") | (F.abs(F.col("_next") - share) < self.tolerance)
        spent = F.col("optimizer_iterations") >= self.most
        return self.change(
            staged.withColumn("_next", proposed),
            {
                "_tested_low": F.col("_tested_low") | (goes_on & under),
                "_tested_high": F.col("_tested_high") | (goes_on & ~under & over),
                "optimizer_converged": settled,
                "mixture_share": F.col("_next"),
                self.open: ~settled & ~spent,
            },
        ).drop("_stays", "_newton", "_next", "_likelihood", "_gradient", "_curvature")


class CalibrationSolver(Solver):
    """Step-halving Newton fit of ``label ~ intercept + slope * score``.

    The point with the prevalence and slope zero needs no scan: its gradient and information follow
    from the sums of the first one. Fits that do not exist end as failed.
    """

    open = "_fit_open"
    bound = ("_c0", "_c1")

    def __init__(self, score: str, label: str, tolerance: float, most: int, weight: str | None = None) -> None:
        self.score, self.label, self.tolerance, self.most, self.weight = score, label, tolerance, most, weight

    def first(self, started: bool = False) -> list[Column]:
        x, y = F.col(self.score), F.col(self.label)
        return [
            *(self.moments() if started else []),
            counted(self.held).alias("_m"),
            mean(y, self.held).alias("_prevalence"),
            total(x, self.held).alias("_sx"),
            total(x * y, self.held).alias("_sxy"),
            total(x * x, self.held).alias("_sxx"),
            F.min(x).alias("_least_score"),
            F.max(x).alias("_most_score"),
        ]

    def refused(self) -> tuple[Column, str]:
        return F.col("_prevalence").isin(0.0, 1.0), "Cells with records of one class cannot be calibrated:"

    def start(self, table: DataFrame, started: bool = False) -> DataFrame:
        held = clip(F.col("_prevalence"), 1e-12, 1.0 - 1e-12)
        weight = held * (1.0 - held)
        zero = F.lit(0.0)
        at_prevalence = {
            "_c0": logit(held),
            "_c1": zero,
            "_objective": F.col("_m") * (held * logit(held) - log_add_exp(zero, logit(held))),
            "_g0": zero,
            "_g1": F.col("_sxy") - held * F.col("_sx"),
            "_h00": F.col("_m") * weight,
            "_h01": F.col("_sx") * weight,
            "_h11": F.col("_sxx") * weight,
        }
        began = table.withColumns(
            {
                **({} if started else at_prevalence),
                "_best": F.lit(float("-inf")),
                "_step0": zero,
                "_step1": zero,
                "_scale": F.lit(1.0),
                "_started": F.lit(False),
                "_failed": F.lit(False),
                "_steps": F.lit(0),
                self.open: F.lit(True),
            }
        ).withColumns({"_a0": F.col("_c0"), "_a1": F.col("_c1")})
        return self.move(began).drop("_m", "_sx", "_sxy", "_sxx")

    def values(self) -> list[dict[str, Column]]:
        linear, decay, fitted = F.col("_linear"), F.col("_decay"), F.col("_fitted")
        return [
            {"_linear": F.when(F.col(self.open), F.col("_c0") + F.col("_c1") * F.col(self.score))},
            {"_decay": F.exp(-F.abs(linear))},
            {
                "_fitted": F.when(linear >= 0, 1.0).otherwise(decay) / (1.0 + decay),
                "_log_sum": F.greatest(linear, F.lit(0.0)) + F.log1p(decay),
            },
            {"_spread": fitted * (1.0 - fitted), "_residual": F.col(self.label) - fitted},
        ]

    def moments(self) -> list[Column]:
        x, spread, residual = F.col(self.score), F.col("_spread"), F.col("_residual")
        parts = {
            "_objective": F.col(self.label) * F.col("_linear") - F.col("_log_sum"),
            "_g0": residual,
            "_g1": x * residual,
            "_h00": spread,
            "_h01": spread * x,
            "_h11": spread * x * x,
        }
        return [total(part, self.held).alias(name) for name, part in parts.items()]

    def move(self, table: DataFrame) -> DataFrame:
        g0, g1 = F.col("_g0"), F.col("_g1")
        h00, h01, h11 = F.col("_h00"), F.col("_h01"), F.col("_h11")
        started, scale = F.col("_started"), F.col("_scale")
        fell = F.isnan("_objective") | (F.col("_objective") < F.col("_best") - ASCENT_SLACK)
        moved = F.greatest(F.abs("_step0"), F.abs("_step1")) * scale
        staged = table.withColumns(
            {"_halved": started & fell, "_det": h00 * h11 - h01 * h01, "_moved": moved}
        ).withColumns(
            {
                "_settled": ~F.col("_halved") & started & (F.col("_moved") < self.tolerance),
                "_lost": F.when(F.col("_halved"), scale / 2.0 < LEAST_SCALE).otherwise(
                    (F.col("_det") == 0) | F.isnan("_det")
                ),
            }
        )
        halved, keep = F.col("_halved"), F.col("_halved") | F.col("_settled")

        def either(name: str, value: Column) -> Column:
            return F.when(keep, F.col(name)).otherwise(value)

        stepped = self.change(
            staged,
            {
                "_a0": F.when(halved, F.col("_a0")).otherwise(F.col("_c0")),
                "_a1": F.when(halved, F.col("_a1")).otherwise(F.col("_c1")),
                "_best": F.when(halved, F.col("_best")).otherwise(F.col("_objective")),
                "_step0": either("_step0", F.try_divide(h11 * g0 - h01 * g1, F.col("_det"))),
                "_step1": either("_step1", F.try_divide(h00 * g1 - h01 * g0, F.col("_det"))),
                "_scale": F.when(halved, scale / 2.0).otherwise(1.0),
                "_started": F.lit(True),
                "_steps": F.col("_steps") + 1,
                "_failed": ~F.col("_settled") & F.col("_lost"),
            },
        )
        over = F.col("_settled") | F.col("_failed") | (F.col("_steps") > self.most)
        return self.change(
            stepped,
            {
                "_c0": F.col("_a0") + F.col("_scale") * F.col("_step0"),
                "_c1": F.col("_a1") + F.col("_scale") * F.col("_step1"),
                self.open: ~over,
            },
        ).drop("_halved", "_det", "_moved", "_settled", "_lost", "_objective", "_g0", "_g1", "_h00", "_h01", "_h11")

    @staticmethod
    def coefficients(state: DataFrame) -> tuple[Column, Column]:
        """Accepted intercept and slope, null where the fit does not exist."""
        finite = ~F.isnan("_a0") & ~F.isnan("_a1") & (F.abs("_a0") < float("inf")) & (F.abs("_a1") < float("inf"))
        held = ~F.col("_failed") & finite
        return F.when(held, F.col("_a0")), F.when(held, F.col("_a1"))


class PosteriorSolver(Solver):
    """Share by repeated averaging of the posterior of ``value``."""

    open = "_mean_open"
    bound = ("em_share",)

    def __init__(
        self, value: str, initial: float | DataFrame, keys: Sequence[str], tolerance: float, most: int, accelerate: bool
    ) -> None:
        self.value, self.initial, self.keys = value, initial, keys
        self.tolerance, self.most, self.accelerate = tolerance, most, accelerate

    def first(self, started: bool = False) -> list[Column]:
        return [F.count(F.lit(1)).alias("n")]

    def start(self, table: DataFrame, started: bool = False) -> DataFrame:
        if isinstance(self.initial, DataFrame):
            began = match(table, self.initial, self.keys)
        else:
            began = table.withColumn("em_share", F.lit(float(self.initial)))
        return began.withColumns(
            {
                "_before": F.col("em_share"),
                "em_converged": F.lit(False),
                "em_iterations": F.lit(0),
                self.open: F.lit(self.most > 0),
            }
        )

    def moments(self) -> list[Column]:
        share = F.col("em_share")
        posterior = expit(F.col(self.value) + F.log(share / (1.0 - share)))
        return [F.avg(F.when(F.col(self.open), posterior)).alias("_updated")]

    def move(self, table: DataFrame) -> DataFrame:
        share, before, updated = F.col("em_share"), F.col("_before"), F.col("_updated")
        settled = F.abs(updated - share) < self.tolerance
        following = clip(updated, SHARE_BOUND, 1.0 - SHARE_BOUND)
        if self.accelerate:  # Aitken's limit of three successive shares, where it is a share
            bend = following - 2.0 * share + before
            limit = before - F.try_divide((share - before) * (share - before), bend)
            usable = (limit > SHARE_BOUND) & (limit < 1.0 - SHARE_BOUND)
            third = F.col("em_iterations") % 3 == 2
            following = F.when(third & usable, limit).otherwise(following)
        staged = table.withColumns({"_settles": settled, "_follows": F.when(settled, updated).otherwise(following)})
        rounds = F.col("em_iterations") + 1
        return self.change(
            staged,
            {
                "em_converged": F.col("_settles"),
                "_before": share,
                "em_share": F.col("_follows"),
                "em_iterations": rounds,
                self.open: ~F.col("_settles") & (rounds < self.most),
            },
        ).drop("_settles", "_follows", "_updated")


def share_of(value: np.ndarray, weight: np.ndarray) -> float:
    """Share at which the likelihood of weighted log ratios is greatest, by halving."""
    small = np.exp(-np.abs(value))
    above = value > 0

    def slope(share: float) -> float:
        density = np.where(above, (1.0 - share) * small + share, 1.0 - share + share * small)
        return float(weight @ (np.where(above, 1.0 - small, small - 1.0) / density))

    low, high = SHARE_BOUND, 1.0 - SHARE_BOUND
    if slope(low) <= 0:
        return low
    if slope(high) >= 0:
        return high
    for _ in range(60):
        middle = 0.5 * (low + high)
        low, high = (middle, high) if slope(middle) > 0 else (low, middle)
    return 0.5 * (low + high)


def line_of(score: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of ``label ~ score``; those of the prevalence where Newton's steps fail."""
    prevalence = float(np.clip((weight @ label) / weight.sum(), 1e-12, 1.0 - 1e-12))
    first = np.array([np.log(prevalence / (1.0 - prevalence)), 0.0])
    point, design = first, np.stack([np.ones_like(score), score])
    for _ in range(30):
        fitted = 1.0 / (1.0 + np.exp(-(point @ design)))
        hessian = (design * (weight * fitted * (1.0 - fitted))) @ design.T
        if not np.isfinite(hessian).all() or np.linalg.det(hessian) <= 0:
            break
        step = np.linalg.solve(hessian, design @ (weight * (label - fitted)))
        point = point + step
        if np.abs(step).max() < 1e-12:
            return float(point[0]), float(point[1])
    return float(first[0]), float(first[1])


def counted_starts(rows: DataFrame, keys: Sequence[str], value: str, label: str) -> DataFrame:
    """Starts of share and calibration: their results on counts by intervals of ``value``.

    The rows are read once; a cell has at most two rows for each interval. Two points stand for the
    records of an interval, with their number, mean and spread. What the points leave out costs
    a step more, no digit: :func:`solve` goes on from here on the records themselves.
    """
    keys, width = list(keys), 1.0 / START_INTERVALS
    edge = float(START_LIMIT * START_INTERVALS)
    place = F.floor(clip(F.col(value) * START_INTERVALS, -edge, edge))
    beyond = F.col(value) - F.col("_place") * width
    counts = (
        rows.withColumn("_place", place)
        .groupBy(*keys, label, "_place")
        .agg(F.count(F.lit(1)).alias("_n"), F.avg(beyond).alias("_mean"), F.var_pop(beyond).alias("_spread"))
    )

    def started(cell: pd.DataFrame) -> pd.DataFrame:
        middle, spread = cell["_place"] * width + cell["_mean"], np.sqrt(cell["_spread"])
        points = np.concatenate([middle - spread, middle + spread])
        weight = np.tile(cell["_n"].to_numpy(dtype=float) / 2.0, 2)
        share, line = 0.5, (0.0, 0.0)
        if np.isfinite(points).all():
            with np.errstate(all="ignore"):
                share = share_of(points, weight)
                line = line_of(points, np.tile(cell[label].to_numpy(dtype=float), 2), weight)
        return pd.DataFrame([[*cell[keys].iloc[0], share, *line]], columns=schema.names)

    names = ("mixture_share", "_c0", "_c1")
    schema = StructType([*[rows.schema[key] for key in keys], *[StructField(n, DoubleType(), True) for n in names]])
    return written(counts.groupBy(*keys).applyInPandas(started, schema))


def solve(
    rows: DataFrame, keys: Sequence[str], solvers: Sequence[Solver], starts: DataFrame | None = None
) -> DataFrame:
    """State of all cells of ``rows`` when no solver has an open cell any more.

    ``rows`` holds the keys and the inputs of the solvers and is read once a step: persist it. Solvers
    with a weight take a row for that many equal records. ``starts`` holds, for every cell,
    the state columns that the moments read; the nearer they are, the fewer steps follow.
    Cells with null keys are cells like others.
    """
    keys = list(keys)
    moving = reduce(Column.__or__, [F.col(solver.open) for solver in solvers])
    opened = {"moving": F.count_if(moving)}
    started = starts is not None
    if started:
        begun = match(rows, starts, keys).withColumns({solver.open: F.lit(True) for solver in solvers})
        began = staged(begun, [stage for solver in solvers for stage in solver.values()])
    else:
        began = staged(rows, [stage for solver in solvers for stage in solver.first_values()])
    table = began.groupBy(*keys).agg(*[column for solver in solvers for column in solver.first(started)])
    if started:
        table = match(table, starts, keys)
    refusals = [refusal for solver in solvers if (refusal := solver.refused()) is not None]
    for position, (condition, _) in enumerate(refusals):
        table = table.withColumn(f"_refused{position}", F.coalesce(condition, F.lit(False)))
        opened[f"refused{position}"] = F.count_if(F.col(f"_refused{position}"))
    for solver in solvers:
        table = solver.start(table, started)
    state, seen = written_with(table, opened)
    for position, (_, message) in enumerate(refusals):
        if seen.get(f"refused{position}"):
            named = state.where(f"_refused{position}").select(*keys).limit(5).collect()
            raise ValueError(f"{message} {[tuple(row) for row in named]}")
    state = state.drop(*[f"_refused{position}" for position in range(len(refusals))])
    opened = {"moving": opened["moving"]}
    bound = [name for solver in solvers for name in (*solver.bound, solver.open)]
    while seen.get("moving"):
        active = state.where(moving).select(*keys, *bound)
        moments = [column for solver in solvers for column in solver.moments()]
        valued = staged(match(rows, active, keys), [stage for solver in solvers for stage in solver.values()])
        found = valued.groupBy(*keys).agg(*moments)
        table = match(state, found, keys, "left")
        for solver in solvers:
            table = solver.move(table)
        state, seen = written_with(table, opened)
    return state


def cell_values(frame: DataFrame, keys: Sequence[str], values: Mapping[tuple, float], name: str) -> DataFrame:
    """Given values of cells as a table."""
    fields = [StructField(key, frame.schema[key].dataType, True) for key in keys]
    rows = [(*key, float(value)) for key, value in values.items()]
    return small_table(frame.sparkSession, rows, StructType([*fields, StructField(name, DoubleType(), True)]))

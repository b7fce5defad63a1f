"""Ridge logistic fits of many folds and penalties in shared scans.

Every feature is a continuous factor times an indicator of a category level.
Within one combination of levels the features are constants times the factors,
so weighted factor moments per combination determine gradient and Hessian of
the full model. One Newton step of all unfinished fits is therefore one grouped
aggregate inside the JVM: it returns a row per fit and level combination, and
the driver solves the small normal equations. A whole grid of one specification
needs about eight scans, whatever its number of folds, penalties and dummies.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.local import small_table
from ..operators.features import Term

MAX_ITERATIONS = 200
# Size of the last step; what it leaves is of the order of its square.
TOLERANCE = 1e-6


@dataclass
class RidgeFit:
    """State and result of one weighted ridge-logistic fit."""

    fold: int
    regularization_c: float
    beta: np.ndarray
    candidate: np.ndarray = field(default=None, repr=False)
    step: np.ndarray = field(default=None, repr=False)
    objective: float = np.inf
    scale: float = 1.0
    n_iter: int = 0
    converged: bool = False
    failed: bool = False
    n_training: int = 0

    @property
    def intercept(self) -> float:
        return float(self.beta[0])

    @property
    def coefficients(self) -> np.ndarray:
        return self.beta[1:]

    def update(self, hessian, gradient, loss: float, count: int, tolerance: float) -> None:
        """Accept or halve the candidate, then propose the next one."""
        self.n_iter, self.n_training = self.n_iter + 1, int(count)
        penalty = np.full(len(self.candidate), 1.0 / self.regularization_c)
        penalty[0] = 0.0
        objective = loss + 0.5 * float(penalty @ self.candidate**2)
        if self.step is not None and objective > self.objective + 1e-10 * abs(self.objective):
            self.scale /= 2.0
            self.failed = self.scale < 2.0**-30
        else:
            self.beta, self.objective, self.scale = self.candidate, objective, 1.0
            direction = gradient - penalty * self.beta
            self.step = np.linalg.solve(hessian + np.diag(penalty), direction)
            if np.abs(self.step).max() < tolerance:
                self.beta, self.converged = self.beta + self.step, True
                return
        self.candidate = self.beta + self.scale * self.step


class Design:
    """How the features of a model are made of factors and level indicators."""

    def __init__(
        self,
        terms: Sequence[Term],
        levels: Mapping[str, Sequence],
        scales: Mapping[str, float] | None = None,
    ) -> None:
        intercept = Term("intercept")
        self.terms = [intercept, *terms]
        self.factors = list(dict.fromkeys(t.factor for t in terms if t.factor is not None))
        self.categories = list(dict.fromkeys(t.category for t in terms if t.category is not None))
        self.levels = {name: list(levels[name]) for name in self.categories}
        held = dict(scales or {})
        self.scale = np.array([held.get(term.category, 1.0) for term in self.terms])
        place = {None: 0, **{name: i + 1 for i, name in enumerate(self.factors)}}
        self.factor_place = np.array([place[term.factor] for term in self.terms])

    @property
    def width(self) -> int:
        return len(self.terms)

    def level_index(self, category: str, value: Column) -> Column:
        """One-based place of a declared level; zero for null and the unknown."""
        levels = F.array(*[F.lit(level) for level in self.levels[category]])
        return F.coalesce(F.array_position(levels, value).cast("int"), F.lit(0))

    def coefficient_row(self, beta: np.ndarray) -> list:
        """Base coefficient of each factor, then its additions per level."""
        scaled = beta * self.scale
        bases = np.zeros(len(self.factors) + 1)
        additions = {
            (k, c): [0.0] * (len(self.levels[c]) + 1)
            for k in range(len(bases))
            for c in self.categories
            if self.has_additions(k, c)
        }
        for j, term in enumerate(self.terms):
            k = self.factor_place[j]
            if term.category is None:
                bases[k] += scaled[j]
            else:
                at = self.levels[term.category].index(term.level) + 1
                additions[(k, term.category)][at] += float(scaled[j])
        return [*map(float, bases), *additions.values()]

    def has_additions(self, factor: int, category: str) -> bool:
        return any(
            self.factor_place[j] == factor and term.category == category
            for j, term in enumerate(self.terms)
        )

    def coefficient_columns(self) -> list[tuple[str, str]]:
        n = len(self.factors) + 1
        names = [(f"_base_{k}", "double") for k in range(n)]
        names += [
            (f"_add_{k}_{c}", "array<double>")
            for k in range(n)
            for c in self.categories
            if self.has_additions(k, c)
        ]
        return names

    def linear_predictor(self, at: Callable[[str], Column] = F.col) -> Column:
        """The predictor from factor columns, level places and a coefficient row, found by name."""
        total = None
        for k in range(len(self.factors) + 1):
            weight = at(f"_base_{k}")
            for c in self.categories:
                if self.has_additions(k, c):
                    weight = weight + F.get(at(f"_add_{k}_{c}"), at(f"_i_{c}"))
            part = weight if k == 0 else weight * at(f"_f_{k}")
            total = part if total is None else total + part
        return total

    def moments(self) -> list[Column]:
        """Weighted factor moments of one pass, grouped by fit and levels."""
        z, y, w, decay = F.col("_z"), F.col("y"), F.col("w"), F.col("_decay")
        mu = F.col("_mu")
        curvature, residual = w * mu * (1.0 - mu), w * (y - mu)
        values = [F.lit(1.0), *[F.col(f"_f_{k + 1}") for k in range(len(self.factors))]]
        aggregates = [
            F.count(F.lit(1)).alias("n"),
            F.sum(w * (F.greatest(z, F.lit(0.0)) + F.log1p(decay) - y * z)).alias("loss"),
        ]
        for k, left in enumerate(values):
            aggregates.append(F.sum(residual * left).alias(f"g_{k}"))
            for m in range(k, len(values)):
                aggregates.append(F.sum(curvature * left * values[m]).alias(f"h_{k}_{m}"))
        return aggregates

    def normal_equations(self, table: Mapping[str, np.ndarray]):
        """Hessian, gradient, loss and count from the moments of one fit."""
        n_cells, n = len(table["n"]), len(self.factors) + 1
        active = np.ones((n_cells, self.width))
        for j, term in enumerate(self.terms):
            if term.category is not None:
                at = self.levels[term.category].index(term.level) + 1
                active[:, j] = table[f"_i_{term.category}"] == at
        active *= self.scale
        hessian = np.zeros((self.width, self.width))
        gradient = np.zeros(self.width)
        members = [np.flatnonzero(self.factor_place == k) for k in range(n)]
        for k in range(n):
            gradient[members[k]] = table[f"g_{k}"] @ active[:, members[k]]
            for m in range(k, n):
                left, right = active[:, members[k]], active[:, members[m]]
                block = left.T @ (right * table[f"h_{k}_{m}"][:, None])
                hessian[np.ix_(members[k], members[m])] = block
                hessian[np.ix_(members[m], members[k])] = block.T
        return hessian, gradient, float(table["loss"].sum()), int(table["n"].sum())


def not_null(value: Column) -> Column:
    """Inputs are validated before a fit; a null would show as NaN, not be skipped.

    Declaring the value non-null also shortens the generated aggregation code.
    """
    return F.coalesce(value, F.lit(float("nan")))


def newton_pass(
    rows: DataFrame, design: Design, fits: Sequence[RidgeFit], active: Sequence[int], tolerance: float
) -> None:
    """One scan that advances every active fit."""
    columns = design.coefficient_columns()
    schema = ", ".join(["job int", "fold_no int", *[f"{n} {t}" for n, t in columns]])
    jobs = [
        (job, fits[job].fold, *design.coefficient_row(fits[job].candidate)) for job in active
    ]
    # One row per fit: the broadcast is bounded by the plan, not by the records.
    table = small_table(rows.sparkSession, jobs, schema)
    scored = rows.join(F.broadcast(table), "fold_no").withColumn(
        "_z", not_null(design.linear_predictor())
    )
    places = [f"_i_{c}" for c in design.categories]
    summed = (
        # One exponential a row and fit serves the mean and the loss.
        scored.withColumn("_decay", F.exp(-F.abs(F.col("_z"))))
        .withColumn("_mu", F.when(F.col("_z") >= 0, 1.0).otherwise(F.col("_decay")) / (1.0 + F.col("_decay")))
        .groupBy("job", *places)
        .agg(*design.moments())
        .toArrow()
    )
    values = {name: summed.column(name).to_numpy() for name in summed.column_names}
    for job in active:
        held = values["job"] == job
        if not held.any():
            raise ValueError(f"Fold {fits[job].fold} has no training records")
        part = {name: column[held] for name, column in values.items()}
        fits[job].update(*design.normal_equations(part), tolerance)


def fit_ridge_grid(
    rows: DataFrame,
    design: Design,
    penalties: Mapping[int, Sequence[float]],
    *,
    starts: Mapping[tuple[int, float], np.ndarray] | None = None,
    tolerance: float = TOLERANCE,
    max_iterations: int = MAX_ITERATIONS,
) -> list[RidgeFit]:
    """Fit every (fold, C).

    ``rows`` has ``fold_no``, the label ``y``, the weight ``w``, the factors
    ``_f_1 ..`` and the level places ``_i_<category>``. Minimises
    ``sum(w * loss) + |beta|^2 / (2 C)`` with a free intercept. Fits that have
    not converged get four times the iteration limit before they are reported. ``starts`` holds
    coefficients that the fit of a (fold, C) begins with; others begin with zeros.
    The rows are kept while the passes last, and released after them.
    """
    fits = []
    for fold, values in penalties.items():
        for c in map(float, sorted(set(values))):
            begun = np.zeros(design.width)
            near = (starts or {}).get((fold, c), ())
            begun[: len(near)] = near
            fits.append(RidgeFit(fold, c, begun, begun))
    if any(fit.regularization_c <= 0 for fit in fits):
        raise ValueError("C must be positive")
    rows = rows.persist()
    try:
        for _ in range(4 * max_iterations):
            active = [i for i, fit in enumerate(fits) if not (fit.converged or fit.failed)]
            if not active:
                break
            newton_pass(rows, design, fits, active, tolerance)
    finally:
        rows.unpersist()
    return fits

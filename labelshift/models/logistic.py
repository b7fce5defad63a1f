"""Logistic class models and density ratios over temporal folds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..domain import DEFAULT, Domain
from ..functions.expressions import expit, indicator
from ..functions.local import small_table
from ..operators.features import (
    YEAR_EFFECT_SCALE,
    Parameter,
    category_column,
    category_levels,
    column_parameters,
    factor_columns,
    feature_terms,
    fit_feature_parameters,
    join_parameters,
    literal_parameters,
    year_terms,
)
from ..operators.mixture import ratio_log_means, ratio_normalisation
from ..operators.weights import equal_prior_weights, is_positive
from ..plans.folds import Fold, fold_table, join_sources
from ..plans.specifications import FeatureSpec, label_number
from .newton import Design, RidgeFit, fit_ridge_grid, not_null


@dataclass(frozen=True)
class LogisticModel:
    """A fitted transform and linear predictor; scoring is one expression."""

    variant: str
    spec: FeatureSpec
    regularization_c: float
    fold_id: str
    train_years: tuple[int, ...]
    parameters: Mapping[str, float]
    feature_names: tuple[str, ...]
    coefficients: tuple[float, ...]
    intercept: float
    n_iter: int = 0
    converged: bool = True
    n_training: int = 0
    raw_intercept: float = 0.0
    year_effects: tuple[float, ...] = ()
    mean_ratio_first: float | None = None
    mean_inverse_ratio_second: float | None = None
    domain: Domain = DEFAULT

    @property
    def model_id(self) -> str:
        family = "logistic" if self.variant == "known_source_prior" else f"logistic_{self.variant}"
        return (
            f"{family}__{self.spec.name}__c_{label_number(self.regularization_c)}"
            f"__train_{self.train_years[0]}_{self.train_years[-1]}"
        )

    def linear_predictor(self) -> Column:
        design = score_design(self.spec, self.feature_names, self.domain)
        row = design.coefficient_row(np.array([self.intercept, *self.coefficients]))
        names = [name for name, _ in design.coefficient_columns()]
        values = {
            name: F.array(*map(F.lit, value)) if isinstance(value, list) else F.lit(value)
            for name, value in zip(names, row, strict=True)
        }
        values |= design_inputs(self.spec, design, literal_parameters(self.parameters), self.domain)
        return design.linear_predictor(values.__getitem__)

    def log_ratio(self, frame: DataFrame, name: str = "log_ratio") -> DataFrame:
        return frame.withColumn(name, self.linear_predictor())

    def predict_probability(self, frame: DataFrame, name: str = "probability") -> DataFrame:
        return frame.withColumn(name, expit(self.linear_predictor()))

    def predict_class(self, frame: DataFrame, name: str) -> DataFrame:
        probability = expit(self.linear_predictor())
        return frame.withColumn(name, hard_class(probability, domain=self.domain))


def score_design(spec: FeatureSpec, names: Sequence[str], domain: Domain = DEFAULT) -> Design:
    """Factors and levels of a specification whose features bear these names."""
    terms = feature_terms(spec, domain)
    if tuple(term.name for term in terms) != tuple(names):
        raise ValueError("The model was fitted on other feature columns")
    return Design(terms, category_levels(domain))


def design_inputs(
    spec: FeatureSpec, design: Design, parameter: Parameter, domain: Domain = DEFAULT
) -> dict[str, Column]:
    """Factors and level places of a record by the names that the linear predictor reads."""
    factors = factor_columns(spec, parameter, domain)
    values = {f"_f_{k}": factors[name] for k, name in enumerate(design.factors, start=1)}
    return values | {f"_i_{c}": design.level_index(c, category_column(c, domain)) for c in design.categories}


def hard_class(probability: Column, threshold: float = 0.5, domain: Domain = DEFAULT) -> Column:
    return F.when(probability >= threshold, domain.positive_class).otherwise(domain.negative_class)


def training_rows(
    records: DataFrame,
    folds: Sequence[Fold],
    *,
    equal_prior: bool = False,
    domain: Domain = DEFAULT,
) -> DataFrame:
    """Labelled training records of every fold with their weights.

    ``fold_no`` numbers the folds in the given order; it is the key of the
    joins and groups of a fit, which are cheaper on integers.
    """
    years = sorted({year for fold in folds for year in fold.train_years})
    labelled = records.where(F.col("year").isin(*years) & F.col(domain.label).isNotNull())
    if equal_prior:
        labelled = equal_prior_weights(labelled, domain=domain)
    else:
        labelled = labelled.withColumn("source_weight", F.lit(1.0))
    numbered = fold_table(records.sparkSession, folds).join(
        fold_numbers(records.sparkSession, folds), "fold_id"
    )
    return join_sources(labelled, numbered)


def fold_numbers(spark: SparkSession, folds: Sequence[Fold]) -> DataFrame:
    rows = [(fold.fold_id, number) for number, fold in enumerate(folds)]
    return small_table(spark, rows, "fold_id string, fold_no int")


def _penalties(folds: Sequence[Fold], c_values) -> dict[str, Sequence[float]]:
    if isinstance(c_values, Mapping):
        return {fold: values for fold, values in c_values.items() if values}
    return {fold.fold_id: list(c_values) for fold in folds}


def fit_grid(
    records: DataFrame,
    folds: Sequence[Fold],
    spec: FeatureSpec,
    c_values: Sequence[float] | Mapping[str, Sequence[float]],
    *,
    variant: str = "raw",
    parameters: Mapping[str, Mapping[str, float]] | None = None,
    ratio_means: bool = True,
    near: Sequence[LogisticModel] = (),
    domain: Domain = DEFAULT,
) -> list[LogisticModel]:
    """Fit one specification on all folds and penalties together.

    ``variant`` is ``raw`` (observed prior), ``known_source_prior`` (both
    classes weigh one half of every source year; the log odds are the log
    density ratio), ``pooled`` (raw slope, normalised ratio) or
    ``year_fixed_effect`` (source-year block in the fit, dropped in the ratio).
    Feature ``parameters`` of an earlier fit on the same folds can be reused;
    ``ratio_means=False`` leaves out the normalisation diagnostics. The steps of a fit begin at the
    model of its fold and penalty in ``near``, if there is one, and end by the same rule.
    """
    if variant not in ("raw", "known_source_prior", "pooled", "year_fixed_effect"):
        raise ValueError(f"No logistic variant is called {variant!r}")
    equal_prior = variant == "known_source_prior"
    penalties = _penalties(folds, c_values)
    by_id = {fold.fold_id: fold for fold in folds if fold.fold_id in penalties}
    train = training_rows(records, list(by_id.values()), equal_prior=equal_prior, domain=domain)
    names = list(by_id)
    if parameters is None:
        numbered = fit_feature_parameters(train, spec, "fold_no", domain)
        parameters = {names[number]: values for number, values in numbered.items()}
    terms = feature_terms(spec, domain)
    blocks, levels, scales = list(terms), category_levels(domain), {}
    if variant == "year_fixed_effect":
        windows = {len(fold.train_years) for fold in by_id.values()}
        if len(windows) != 1 or min(windows) < 2:
            raise ValueError("Year effects need folds of one window of at least two years")
        window = windows.pop()
        blocks += year_terms(window)
        levels["year_position"] = tuple(range(window))
        scales["year_position"] = YEAR_EFFECT_SCALE
    design = Design(blocks, levels, scales)
    keyed = {number: parameters[name] for number, name in enumerate(names)}
    rows = design_rows(join_parameters(train, keyed, "fold_no"), spec, design, domain)
    starts = {
        (names.index(m.fold_id), float(m.regularization_c)): np.array([m.raw_intercept, *m.coefficients])
        for m in near
        if m.fold_id in by_id and m.parameters == parameters[m.fold_id]
    }
    fits = fit_ridge_grid(rows, design, {n: penalties[name] for n, name in enumerate(names)}, starts=starts)
    features = [term.name for term in terms]
    models = [
        _model(
            fit,
            variant,
            spec,
            by_id[names[fit.fold]],
            parameters[names[fit.fold]],
            tuple(features),
            domain,
        )
        for fit in fits
    ]
    if variant in ("pooled", "year_fixed_effect"):
        models = normalise_ratios(models, train, domain)
    elif variant == "known_source_prior" and ratio_means:
        models = attach_ratio_means(models, train, domain)
    return models


def design_rows(
    frame: DataFrame, spec: FeatureSpec, design: Design, domain: Domain = DEFAULT
) -> DataFrame:
    """Label, weight, factors and level places of every training record."""
    factors = factor_columns(spec, column_parameters(), domain)
    places = {c: design.level_index(c, category_column(c, domain)) for c in design.categories}
    return frame.select(
        "fold_no",
        indicator(is_positive(domain)).alias("y"),
        not_null(F.col("source_weight")).alias("w"),
        *[not_null(factors[name]).alias(f"_f_{k}") for k, name in enumerate(design.factors, start=1)],
        *[place.alias(f"_i_{c}") for c, place in places.items()],
    )


def _model(fit: RidgeFit, variant, spec, fold: Fold, parameters, names, domain) -> LogisticModel:
    n = len(names)
    return LogisticModel(
        variant=variant,
        spec=spec,
        regularization_c=fit.regularization_c,
        fold_id=fold.fold_id,
        train_years=fold.train_years,
        parameters=dict(parameters),
        feature_names=names,
        coefficients=tuple(map(float, fit.coefficients[:n])),
        intercept=fit.intercept,
        n_iter=fit.n_iter,
        converged=fit.converged,
        n_training=fit.n_training,
        raw_intercept=fit.intercept,
        year_effects=tuple(float(v) * YEAR_EFFECT_SCALE for v in fit.coefficients[n:]),
        domain=domain,
    )


def score_grid(
    frame: DataFrame,
    models: Sequence[LogisticModel],
    name: str = "log_ratio",
    domain: Domain = DEFAULT,
) -> DataFrame:
    """Score records of each fold with every model of that fold.

    All models share one specification. Their coefficients are columns of a
    table with one row per model: a base for each factor and additions by level, as in the fit. So
    the predictor has a term for each factor, not for each feature, and stays small enough to be
    compiled; the plan does not grow with the number of models.
    """
    spec, names = models[0].spec, models[0].feature_names
    if any(m.spec != spec or m.feature_names != names for m in models):
        raise ValueError("score_grid needs models of one specification")
    design = score_design(spec, names, domain)
    schema = ", ".join(
        ["fold_id string", "model_id string", "regularization_c double"]
        + [f"{column} {kind}" for column, kind in design.coefficient_columns()]
    )
    rows = [
        (m.fold_id, m.model_id, m.regularization_c, *design.coefficient_row(np.array([m.intercept, *m.coefficients])))
        for m in models
    ]
    table = small_table(frame.sparkSession, rows, schema)
    inputs = design_inputs(spec, design, column_parameters(), domain)
    prepared = join_parameters(frame, {m.fold_id: m.parameters for m in models}).select(
        *[F.col(f"`{column}`") for column in frame.columns], *[value.alias(key) for key, value in inputs.items()]
    )
    joined = prepared.join(F.broadcast(table), "fold_id")
    kept = [*[F.col(f"`{column}`") for column in frame.columns], "model_id", "regularization_c"]
    return joined.select(*kept, design.linear_predictor().alias(name))


def attach_ratio_means(models, train: DataFrame, domain: Domain = DEFAULT) -> list[LogisticModel]:
    """Record E0[r] and E1[1/r], both one for a perfect ratio."""
    scored = score_grid(train, models, "score", domain)
    means = ratio_normalisation(scored, ["model_id"], "score", is_positive(domain)).collect()
    found = {row.model_id: row for row in means}
    return [
        replace(
            m,
            mean_ratio_first=found[m.model_id].mean_ratio_first,
            mean_inverse_ratio_second=found[m.model_id].mean_inverse_ratio_second,
        )
        for m in models
    ]


def normalise_ratios(models, train: DataFrame, domain: Domain = DEFAULT) -> list[LogisticModel]:
    """Shift each slope so that the mean ratio over the negative class is one.

    A shift divides the mean ratio and multiplies the mean inverse, so both follow from the means
    of the slopes.
    """
    slopes = [replace(m, intercept=0.0) for m in models]
    scored = score_grid(train, slopes, "score", domain)
    means = ratio_log_means(scored, ["model_id"], "score", is_positive(domain)).collect()
    found = {row.model_id: row for row in means}
    return [
        replace(
            m,
            intercept=-found[m.model_id].log_mean_first,
            mean_ratio_first=1.0,
            mean_inverse_ratio_second=float(
                np.exp(found[m.model_id].log_mean_inverse_second + found[m.model_id].log_mean_first)
            ),
        )
        for m in models
    ]


def pooled_models(
    raw: Sequence[LogisticModel], records: DataFrame, folds: Sequence[Fold], domain: Domain = DEFAULT
) -> list[LogisticModel]:
    """The ``pooled`` variant of raw models: their fit, with the ratio normalised."""
    models = [replace(m, variant="pooled") for m in raw]
    return normalise_ratios(models, training_rows(records, folds, domain=domain), domain)


def parameters_of(models: Sequence[LogisticModel]) -> dict[str, Mapping[str, float]]:
    """Feature parameters of fitted folds, for another fit on the same folds."""
    return {m.fold_id: m.parameters for m in models}


def fit_model(
    records: DataFrame,
    spec: FeatureSpec,
    regularization_c: float,
    train_years: Sequence[int],
    *,
    variant: str = "raw",
    domain: Domain = DEFAULT,
) -> LogisticModel:
    """Refit one chosen specification on its final training years."""
    years = tuple(sorted(train_years))
    fold = Fold(years, (years[-1] + 1,), "forward")
    fitted = fit_grid(records, [fold], spec, [regularization_c], variant=variant, domain=domain)[0]
    if not fitted.converged:
        raise RuntimeError("No optimum was reached for the chosen model")
    return fitted


def source_year_diagnostics(
    records: DataFrame, fitted: LogisticModel, reference_intercept: float, domain: Domain = DEFAULT
) -> DataFrame:
    """Fitted year intercepts against the logit of the observed shares."""
    spark = records.sparkSession
    effects = (0.0, *fitted.year_effects)
    table = small_table(
        spark,
        [(int(y), float(e)) for y, e in zip(fitted.train_years, effects, strict=True)],
        "year int, year_effect double",
    )
    shares = (
        records.where(F.col("year").isin(*fitted.train_years))
        .groupBy("year")
        .agg(
            F.count(F.lit(1)).alias("n_source"),
            F.avg(indicator(is_positive(domain))).alias("observed_second_share"),
        )
    )
    share = F.col("observed_second_share")
    logit_share = F.log(share / (1.0 - share))
    intercept = F.lit(float(reference_intercept)) + F.col("year_effect")
    return shares.join(F.broadcast(table), "year").select(
        F.col("year").alias("source_year"),
        "n_source",
        "observed_second_share",
        logit_share.alias("observed_logit_share"),
        intercept.alias("fitted_year_intercept"),
        (intercept - logit_share).alias("intercept_minus_logit_share"),
        F.lit(fitted.intercept).alias("log_ratio_offset"),
        (intercept - logit_share - F.lit(fitted.intercept)).alias("normalization_gap"),
    )


def coefficient_table(spark: SparkSession, models: Sequence[LogisticModel]) -> DataFrame:
    """Long coefficient rows, the intercept included."""
    rows = []
    for m in models:
        identity = (
            m.model_id,
            m.spec.name,
            m.spec.geography or "none",
            float(m.regularization_c),
            int(m.train_years[0]),
            int(m.train_years[-1]),
        )
        rows.append((*identity, "intercept", float(m.intercept)))
        rows.extend(
            (*identity, name, float(value))
            for name, value in zip(m.feature_names, m.coefficients, strict=True)
        )
    return small_table(
        spark,
        rows,
        "model_id string, specification string, geography string, regularization_c double,"
        " train_start int, train_end int, feature string, coefficient double",
    )


def fit_table(spark: SparkSession, models: Sequence[LogisticModel]) -> DataFrame:
    """One diagnostics row per fit."""
    rows = [
        (
            m.model_id,
            m.variant,
            m.spec.name,
            float(m.regularization_c),
            m.fold_id,
            int(m.n_training),
            int(m.n_iter),
            bool(m.converged),
            float(m.intercept),
            m.mean_ratio_first,
            m.mean_inverse_ratio_second,
        )
        for m in models
    ]
    return small_table(
        spark,
        rows,
        "model_id string, variant string, specification string, regularization_c double,"
        " fold_id string, n_training long, n_iter int, converged boolean, log_ratio_offset double,"
        " mean_ratio_first double, mean_inverse_ratio_second double",
    )

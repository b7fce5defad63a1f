"""Validation, calibration, threshold and application reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..domain import DEFAULT, Domain
from ..functions.expressions import expit, indicator
from ..functions.local import freeze, small_table
from ..functions.storage import written
from ..models.logistic import (
    LogisticModel,
    fit_grid,
    fit_model,
    fit_table,
    hard_class,
    parameters_of,
    pooled_models,
    score_grid,
    source_year_diagnostics,
)
from ..models.trees import RECORDS, fit_forest
from ..operators import aggregate
from ..operators.bins import reliability_bins, subgroup_metrics, tail_metrics
from ..operators.metrics import (
    evaluate_log_ratios,
    evaluate_probabilities,
    precision_recall_counts,
    proper_scores,
    threshold_metrics,
)
from ..operators.mixture import adjust_cells
from ..operators.weights import is_positive
from ..plans.folds import Fold
from ..plans.specifications import FeatureSpec
from .selection import FOLD_COLUMNS, target_rows

VARIANTS = ("pooled", "year_fixed_effect", "known_source_prior")
ESTIMATORS = {
    "raw_logistic": "raw_probability",
    "known_source_prior_mixture": "probability",
}


def merge_records(metadata: Sequence[str], parts: Sequence[DataFrame]) -> DataFrame:
    """Join cell tables on their metadata; a shared field name is an error."""
    held = list(metadata)
    for part in parts:
        fields = [name for name in part.columns if name not in metadata]
        shared = sorted(set(fields) & set(held))
        if shared:
            raise ValueError(f"Two parts of a record both hold {', '.join(shared)}")
        held.extend(fields)
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.join(part, list(metadata))
    return merged


def diagnostic_cells(
    frame: DataFrame,
    keys: Sequence[str],
    positive: Column,
    *,
    probability: str = "probability",
    log_ratio: str | None = None,
    n_bins: int = 10,
    calibrated: bool = True,
    weight: str | None = None,
) -> dict[str, DataFrame]:
    """Metric row, reliability bins and, given a log ratio, its tails."""
    scores = evaluate_probabilities if calibrated else proper_scores
    tables = {
        "metrics": scores(frame, keys, positive, probability, weight=weight),
        "bins": reliability_bins(frame, keys, positive, probability, n_bins, weight),
    }
    if log_ratio is not None:
        tables["ratio_tails"] = tail_metrics(frame, keys, log_ratio, weight=weight)
    return tables


# -- mixture validation --------------------------------------------------------


# Cell metric and the name it has per ratio variant.
VARIANT_FIELDS = {
    "mixture_share": "mixture_share",
    "hard_share_050": "adjusted_hard_share",
    "brier_score": "adjusted_brier",
    "log_loss": "adjusted_log_loss",
    "mean_log_likelihood": "mean_log_likelihood",
    "optimizer_converged": "optimizer_converged",
    "mixture_at_boundary": "at_boundary",
    "mixture_em_difference": "optimizer_em_difference",
}


def run_mixture_validation(
    records: DataFrame,
    folds: Sequence[Fold],
    spec: FeatureSpec,
    regularization_c: float,
    domain: Domain = DEFAULT,
) -> dict[str, DataFrame]:
    """Raw shares and three density-ratio variants on every reverse cell."""
    targets = target_rows(records, folds, domain)
    raw_models = fit_grid(records, folds, spec, [regularization_c], domain=domain)
    y, p = indicator(is_positive(domain)), expit(F.col("log_ratio"))
    raw = score_grid(targets, raw_models, domain=domain).groupBy(*FOLD_COLUMNS).agg(
        F.count(F.lit(1)).alias("n_validation"),
        F.avg(y).alias("actual_second_share"),
        F.avg(p).alias("raw_mean_probability"),
        F.avg(indicator(p >= 0.5)).alias("raw_hard_share"),
        F.avg((p - y) * (p - y)).alias("raw_brier"),
    )
    fit = {"parameters": parameters_of(raw_models), "domain": domain}
    known = fit_grid(records, folds, spec, [regularization_c], variant="known_source_prior", **fit)
    effects = fit_grid(records, folds, spec, [regularization_c], variant="year_fixed_effect", near=raw_models, **fit)
    pooled = pooled_models(raw_models, records, folds, domain)
    intercepts = year_intercepts(records, effects, domain)
    models = [*pooled, *effects, *known]
    keys = ["model_id", *FOLD_COLUMNS]
    scored = score_grid(targets, models, domain=domain).select(*keys, domain.label, "log_ratio")
    named = small_table(
        records.sparkSession, [(m.model_id, m.variant) for m in models], "model_id string, variant string"
    ).distinct()
    long = evaluate_log_ratios(scored, keys, is_positive(domain)).join(named, "model_id")
    wide = long.groupBy(*FOLD_COLUMNS).agg(
        *[
            F.max(F.when(F.col("variant") == variant, F.col(field))).alias(f"{name}_{variant}")
            for variant in VARIANTS
            for field, name in VARIANT_FIELDS.items()
        ]
    )
    cells = freeze(merge_records(FOLD_COLUMNS, [raw, wide]))
    horizons, summary = aggregate.share_error_summary(cells)
    return {
        "cells": cells,
        "horizons": horizons,
        "summary": summary,
        "source_intercepts": intercepts,
        "ratio_diagnostics": fit_table(records.sparkSession, models),
    }


def year_intercepts(
    records: DataFrame, fitted: Sequence[LogisticModel], domain: Domain = DEFAULT
) -> DataFrame:
    """Source-year intercepts of every fold's fixed-effect fit."""
    table = None
    for model in fitted:
        rows = source_year_diagnostics(records, model, model.raw_intercept, domain).withColumn(
            "fold_id", F.lit(model.fold_id)
        )
        table = rows if table is None else table.unionByName(rows)
    return table


# -- calibration and thresholds --------------------------------------------------


def scored_estimators(
    records: DataFrame,
    folds: Sequence[Fold],
    spec: FeatureSpec,
    regularization_c: float,
    domain: Domain = DEFAULT,
) -> DataFrame:
    """Target records with the raw and the mixture-adjusted probability."""
    fit = {"domain": domain}
    raw = fit_grid(records, folds, spec, [regularization_c], **fit)
    known = fit_grid(
        records,
        folds,
        spec,
        [regularization_c],
        variant="known_source_prior",
        parameters=parameters_of(raw),
        ratio_means=False,
        **fit,
    )
    targets = target_rows(records, folds, domain)
    first = score_grid(targets, raw, "raw_log_odds", domain).drop("model_id", "regularization_c")
    second = score_grid(first, known, "log_ratio", domain).drop("model_id", "regularization_c")
    adjusted = adjust_cells(second.persist(), FOLD_COLUMNS)
    return adjusted.withColumn("raw_probability", expit(F.col("raw_log_odds")))


def run_calibration_report(
    scored: DataFrame,
    *,
    probability: str = "raw_probability",
    weight: str | None = None,
    domain: Domain = DEFAULT,
) -> dict[str, DataFrame]:
    """Metric cells and bins of one estimator with their horizon roll-ups.

    Roll-ups by horizon hold the reverse cells, the forward summary and bins the forward ones. With
    ``weight``, a row stands for that many equal records.
    """
    held = [] if weight is None else [weight]
    frame = scored.select(
        *FOLD_COLUMNS, domain.label, F.col(probability).alias("_p"), "log_ratio", *held
    ).persist()
    ratio = "log_ratio" if probability == "probability" else None
    tables = diagnostic_cells(
        frame, FOLD_COLUMNS, is_positive(domain), probability="_p", log_ratio=ratio, weight=weight
    )
    forward = F.col("validation_year") > F.col("train_end")
    reverse_metrics, reverse_bins = tables["metrics"].where(~forward), tables["bins"].where(~forward)
    tables["horizons"], tables["summary"] = aggregate.reverse_metric_summary(reverse_metrics)
    tables["forward_summary"] = aggregate.forward_metric_summary(tables["metrics"].where(forward))
    tables["horizon_bins"] = aggregate.pooled_reliability(reverse_bins, ["horizon"])
    tables["forward_bins"] = aggregate.pooled_reliability(tables["bins"].where(forward), ["horizon"])
    return tables


def by_estimator(scored: DataFrame, estimators: Mapping[str, str] = ESTIMATORS) -> DataFrame:
    """One row per record and estimator."""
    entries = [
        F.struct(F.lit(name).alias("estimator"), F.col(column).alias("_p"))
        for name, column in estimators.items()
    ]
    kept = [name for name in scored.columns if name not in estimators.values()]
    return scored.select(*kept, F.inline(F.array(*entries)))


def run_threshold_report(
    scored: DataFrame,
    *,
    estimators: Mapping[str, str] = ESTIMATORS,
    panel: str = "horizon",
    domain: Domain = DEFAULT,
) -> dict[str, DataFrame]:
    """Threshold, precision-recall and subgroup tables of all estimators."""
    frame = by_estimator(scored, estimators).persist()
    keys = ["estimator", *FOLD_COLUMNS]
    y = is_positive(domain)
    cells = threshold_metrics(frame, keys, y, "_p").persist()
    curves = precision_recall_counts(frame, keys, y, "_p")
    groups = subgroup_metrics(frame, keys, y, "_p", domain=domain)
    horizons, summary = aggregate.threshold_summary(cells, validate=False)
    group_horizons, group_summary = aggregate.subgroup_summary(groups)
    return {
        "threshold_cells": cells,
        "threshold_horizons": horizons,
        "threshold_summary": summary,
        "precision_recall": aggregate.pooled_precision_recall(curves, panel),
        "subgroup_cells": groups,
        "subgroup_horizons": group_horizons,
        "subgroup_summary": group_summary,
    }


def run_forest_comparison(
    records: DataFrame, folds: Sequence[Fold], domain: Domain = DEFAULT
) -> dict[str, DataFrame]:
    """Forest density ratios on every cell with metrics and bins.

    Target records are counted by the cell of the forest's grid, so metrics, shares and bins run on tables
    that the grid bounds, whatever the number of records.
    """
    scored = None
    for fold in folds:
        model = fit_forest(records, fold.train_years, domain=domain)
        part = model.counted_log_ratio(target_rows(records, [fold], domain), [*FOLD_COLUMNS, domain.label])
        scored = part if scored is None else scored.unionByName(part)
    scored = written(scored)
    metrics = evaluate_log_ratios(scored, FOLD_COLUMNS, is_positive(domain), weight=RECORDS)
    adjusted = adjust_cells(scored, FOLD_COLUMNS, estimator=lambda *_: metrics)  # the shares just found
    bins = reliability_bins(adjusted, FOLD_COLUMNS, is_positive(domain), weight=RECORDS)
    return {"metrics": metrics, "bins": bins}


# -- application -------------------------------------------------------------------


def apply_models(
    records: DataFrame, raw: LogisticModel, known: LogisticModel
) -> DataFrame:
    """All years scored in one pass, then adjusted year by year."""
    if raw.feature_names != known.feature_names:
        raise ValueError("Raw and mixture feature columns differ")
    scored = known.log_ratio(raw.predict_probability(records, "raw_probability"))
    return adjust_cells(scored, ["year"])


def run_historical_application(
    records: DataFrame,
    spec: FeatureSpec,
    regularization_c: float,
    train_years: Sequence[int],
    years: Sequence[int],
    *,
    stored: DataFrame | None = None,
    before: int = 2003,
    after: int = 2004,
    domain: Domain = DEFAULT,
) -> dict[str, DataFrame]:
    """Annual share series of labelled and unlabelled years.

    Years already in ``stored`` are kept; the others are scored together, so
    no order of years has to be kept.
    """
    raw = fit_model(records, spec, regularization_c, train_years, domain=domain)
    known = fit_model(
        records, spec, regularization_c, train_years, variant="known_source_prior", domain=domain
    )
    held = set() if stored is None else {row.year for row in stored.select("year").collect()}
    wanted = [year for year in years if year not in held]
    applied = apply_models(records.where(F.col("year").isin(*wanted)), raw, known)
    annual = freeze(aggregate.annual_shares(applied, is_positive(domain)))
    if stored is not None:
        annual = stored.unionByName(annual)
    return {
        "annual": annual,
        "continuity": aggregate.boundary_continuity(annual, before, after),
        "records": applied,
    }


def release_crosswalk(
    scored: DataFrame, model_version: str, domain: Domain = DEFAULT
) -> DataFrame:
    """Record-level release: identifiers, probability, hard class, version."""
    p = F.col("probability")
    return scored.select(
        "year",
        "resp_id",
        "seq_num",
        p.alias("prob_second_lien"),
        hard_class(p, domain=domain).alias("lien_status_predicted_050"),
        F.lit(model_version).alias("model_version"),
    )


def write_crosswalk(crosswalk: DataFrame, path: str) -> None:
    """Partition by year; the rebalance hint splits a dominating year."""
    crosswalk.hint("rebalance", "year").write.mode("overwrite").partitionBy("year").parquet(path)

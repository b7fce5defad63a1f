"""Roll-ups of evaluation cells: within horizon first, then equal horizons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import indicator, ratio

CELL_METRICS = (
    "brier_score",
    "log_loss",
    "observed_second_share",
    "mean_predicted_second_share",
    "calibration_mean_error",
    "calibration_intercept",
    "calibration_slope",
)
THRESHOLD_METRICS = (
    "accuracy",
    "precision_second",
    "recall_second",
    "f1_second",
    "observed_second_share",
    "mean_probability",
    "hard_second_share",
    "brier_score",
    "average_precision",
)
SUBGROUP_METRICS = THRESHOLD_METRICS[:-1]
# Reported share estimator and the cell column it comes from.
SHARE_ESTIMATORS = {
    "raw_mean_probability": "raw_mean_probability",
    "raw_hard_share": "raw_hard_share",
    "mixture_pooled": "mixture_share_pooled",
    "mixture_year_fixed_effect": "mixture_share_year_fixed_effect",
    "mixture_known_source_prior": "mixture_share_known_source_prior",
    "adjusted_hard_pooled": "adjusted_hard_share_pooled",
    "adjusted_hard_year_fixed_effect": "adjusted_hard_share_year_fixed_effect",
    "adjusted_hard_known_source_prior": "adjusted_hard_share_known_source_prior",
}
ANNUAL_ESTIMATORS = (
    "raw_mean_probability",
    "raw_hard_share_050",
    "mixture_mean_probability",
    "mixture_hard_share_050",
)


def incomplete_candidates(
    cells: DataFrame, candidates: Sequence[str], expected: Sequence[int] | None = None
) -> DataFrame:
    """Candidates whose set of horizons is not the expected one."""
    if expected is None:
        wanted = cells.agg(F.array_sort(F.collect_set("horizon")).alias("h")).scalar()
    else:
        wanted = F.array(*[F.lit(int(horizon)) for horizon in sorted(set(expected))])
    held = cells.groupBy(*candidates).agg(F.array_sort(F.collect_set("horizon")).alias("horizons"))
    return held.where(F.col("horizons") != wanted)


def require_complete(
    cells: DataFrame, candidates: Sequence[str], expected: Sequence[int] | None = None
) -> None:
    if cells.isEmpty():
        raise ValueError("No cells to average")
    if not incomplete_candidates(cells, candidates, expected).isEmpty():
        raise ValueError("A candidate lacks horizons that others have")


def horizon_means(
    cells: DataFrame, candidates: Sequence[str], metrics: Sequence[str]
) -> DataFrame:
    """Means by horizon; as in the summary, candidates with a null key drop out."""
    keyed = cells.dropna(subset=list(candidates)) if candidates else cells
    return keyed.groupBy(*candidates, "horizon").agg(
        *[F.avg(name).alias(name) for name in metrics], F.count(F.lit(1)).alias("n_cells")
    )


def equal_horizon_means(
    horizons: DataFrame, candidates: Sequence[str], metrics: Sequence[str]
) -> DataFrame:
    """Every horizon weighs the same; candidates with a null key drop out."""
    keyed = horizons.dropna(subset=list(candidates)) if candidates else horizons
    return keyed.groupBy(*candidates).agg(
        *[F.avg(name).alias(name) for name in metrics],
        F.count_distinct("horizon").alias("n_horizons"),
        F.sum("n_cells").alias("n_cells"),
    )


def two_stage_means(
    cells: DataFrame,
    candidates: Sequence[str],
    metrics: Sequence[str],
    expected_horizons: Sequence[int] | None = None,
    *,
    validate: bool = True,
) -> tuple[DataFrame, DataFrame]:
    if not metrics:
        raise ValueError("No metrics to average")
    needed = [*candidates, "horizon", *metrics]
    missing = [name for name in needed if name not in cells.columns]
    if missing:
        raise ValueError(f"Columns {missing} are needed for the averages")
    if validate:
        require_complete(cells, candidates, expected_horizons)
    horizons = horizon_means(cells, candidates, metrics)
    return horizons, equal_horizon_means(horizons, candidates, metrics)


RAW_CANDIDATE = (
    "specification",
    "continuous_form",
    "interactions",
    "geography",
    "regularization_c",
)
MIXTURE_CANDIDATE = ("specification", "continuous_form", "interactions", "regularization_c")
BOOSTING_CANDIDATE = (
    "parameter_id",
    "max_leaf_nodes",
    "learning_rate",
    "max_iter",
    "l2_regularization",
    "min_samples_leaf",
)


def brier_summary(cells: DataFrame, *, validate: bool = True) -> tuple[DataFrame, DataFrame]:
    """Raw candidates by Brier score with the extremes of every horizon."""
    if validate:
        require_complete(cells, RAW_CANDIDATE)
    horizons = cells.groupBy(*RAW_CANDIDATE, "horizon").agg(
        F.avg("brier_score").alias("mean_brier"),
        F.count(F.lit(1)).alias("n_cells"),
        F.min("brier_score").alias("min_brier"),
        F.max("brier_score").alias("max_brier"),
    )
    summary = equal_horizon_means(horizons, RAW_CANDIDATE, ["mean_brier"])
    return horizons, summary.withColumnRenamed("mean_brier", "selection_brier")


def _summary(cells, candidates, metrics: dict[str, str], validate: bool):
    horizons, summary = two_stage_means(cells, candidates, list(metrics), validate=validate)
    return (
        horizons.withColumnsRenamed({old: f"mean_{new}" for old, new in metrics.items()}),
        summary.withColumnsRenamed({old: f"selection_{new}" for old, new in metrics.items()}),
    )


def mixture_summary(cells: DataFrame, *, validate: bool = True) -> tuple[DataFrame, DataFrame]:
    metrics = {
        "brier_score": "brier",
        "log_loss": "log_loss",
        "mixture_share_error": "share_error",
    }
    return _summary(cells, MIXTURE_CANDIDATE, metrics, validate)


def boosting_summary(cells: DataFrame, *, validate: bool = True) -> tuple[DataFrame, DataFrame]:
    metrics = {"adjusted_brier": "brier", "mixture_share_error": "share_error"}
    return _summary(cells, BOOSTING_CANDIDATE, metrics, validate)


FAMILY_CANDIDATE = (
    "configuration_id",
    "family",
    "specification",
    "hyperparameters",
    "random_seed",
)


def family_summary(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cross-family summary; a missing seed is a key like any other."""
    horizons = cells.groupBy(*FAMILY_CANDIDATE, "horizon").agg(
        F.avg("brier_score").alias("mean_brier"),
        F.avg("log_loss").alias("mean_log_loss"),
        F.avg("mixture_share").alias("mean_mixture_share"),
        F.count(F.lit(1)).alias("n_cells"),
    )
    summary = horizons.groupBy(*FAMILY_CANDIDATE).agg(
        F.avg("mean_brier").alias("selection_brier"),
        F.avg("mean_log_loss").alias("mean_log_loss"),
        F.count(F.lit(1)).alias("n_horizons"),
        F.sum("n_cells").alias("n_cells"),
    )
    return horizons, summary


def reverse_metric_summary(metrics: DataFrame) -> tuple[DataFrame, DataFrame]:
    horizons = metrics.groupBy("horizon").agg(
        *[F.avg(name).alias(name) for name in CELL_METRICS],
        F.count(F.lit(1)).alias("n_cells"),
        F.sum("n").alias("n_loans"),
    )
    overall = horizons.agg(
        *[F.avg(name).alias(name) for name in CELL_METRICS],
        F.count_distinct("horizon").alias("n_horizons"),
        F.sum("n_cells").alias("n_cells"),
    ).withColumn("weighting", F.lit("equal_within_horizon_then_equal_across_horizons"))
    return horizons, overall


def forward_metric_summary(metrics: DataFrame) -> DataFrame:
    return metrics.agg(
        *[F.avg(name).alias(name) for name in CELL_METRICS], F.count(F.lit(1)).alias("n_cells")
    ).withColumn("weighting", F.lit("equal_across_validation_years"))


def share_error_summary(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Signed, absolute and squared share errors of every estimator."""
    entries = [
        F.struct(
            F.lit(name).alias("estimator"),
            (F.col(column) - F.col("actual_second_share")).alias("signed_error"),
        )
        for name, column in SHARE_ESTIMATORS.items()
    ]
    errors = cells.select("horizon", F.inline(F.array(*entries)))
    error = F.col("signed_error")
    horizons = errors.groupBy("estimator", "horizon").agg(
        F.avg(error).alias("mean_signed_error"),
        F.avg(F.abs(error)).alias("mean_absolute_error"),
        F.avg(error * error).alias("mean_squared_error"),
        F.count(F.lit(1)).alias("n_cells"),
    )
    summary = horizons.groupBy("estimator").agg(
        F.avg("mean_signed_error").alias("selection_signed_error"),
        F.avg("mean_absolute_error").alias("selection_absolute_error"),
        F.avg("mean_squared_error").alias("selection_squared_error"),
        F.count_distinct("horizon").alias("n_horizons"),
        F.sum("n_cells").alias("n_cells"),
    )
    return horizons, summary


def threshold_summary(cells: DataFrame, *, validate: bool = True) -> tuple[DataFrame, DataFrame]:
    if validate:
        require_complete(cells, ["estimator"])
    horizons = cells.groupBy("estimator", "horizon").agg(
        *[F.avg(name).alias(name) for name in THRESHOLD_METRICS],
        F.count(F.lit(1)).alias("n_cells"),
        F.sum("n").alias("n_loans"),
    )
    return horizons, equal_horizon_means(horizons, ["estimator"], THRESHOLD_METRICS)


def pooled_precision_recall(curves: DataFrame, panel: str = "horizon") -> DataFrame:
    """Sum the fixed-grid counts of a panel and recompute the ratios."""
    pooled = curves.groupBy("estimator", panel, "threshold").agg(
        F.sum("true_positive").alias("true_positive"),
        F.sum("false_positive").alias("false_positive"),
        F.sum("false_negative").alias("false_negative"),
        F.count_distinct("validation_year").alias("n_cells"),
    )
    tp, fp, fn = (F.col(f"{n}") for n in ("true_positive", "false_positive", "false_negative"))
    return pooled.withColumns(
        {"precision": ratio(tp, tp + fp, 1.0), "recall": F.try_divide(tp, tp + fn)}
    )


def subgroup_summary(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    groups = ["estimator", "subgroup_dimension", "subgroup_value"]
    horizons = cells.groupBy(*groups, "horizon").agg(
        *[F.avg(name).alias(name) for name in SUBGROUP_METRICS],
        F.count(F.lit(1)).alias("n_cells"),
        F.avg("n").alias("mean_n"),
        F.min("n").alias("min_n"),
    )
    summary = horizons.groupBy(*groups).agg(
        *[F.avg(name).alias(name) for name in SUBGROUP_METRICS],
        F.count_distinct("horizon").alias("n_horizons"),
        F.min("min_n").alias("min_cell_n"),
    )
    return horizons, summary


def pooled_reliability(bins: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Pool binned cells by record count."""
    n = F.col("n")
    return bins.groupBy(*groups, "probability_bin").agg(
        F.sum("n").alias("n"),
        F.min("min_probability").alias("min_probability"),
        F.max("max_probability").alias("max_probability"),
        F.count_distinct("validation_year").alias("n_cells"),
        (F.sum(F.col("mean_predicted_probability") * n) / F.sum("n")).alias(
            "mean_predicted_probability"
        ),
        (F.sum(F.col("observed_second_share") * n) / F.sum("n")).alias("observed_second_share"),
    )


def annual_shares(frame: DataFrame, positive, keys: Sequence[str] = ("year",)) -> DataFrame:
    """Predicted and, where labels exist, actual shares of every year.

    ``frame`` carries ``raw_probability``, ``probability`` and ``mixture_share``.
    """
    raw, adjusted = F.col("raw_probability"), F.col("probability")
    return frame.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_model_sample"),
        F.avg(raw).alias("raw_mean_probability"),
        F.avg(indicator(raw >= 0.5)).alias("raw_hard_share_050"),
        F.first("mixture_share").alias("mixture_share"),
        F.avg(adjusted).alias("mixture_mean_probability"),
        F.avg(indicator(adjusted >= 0.5)).alias("mixture_hard_share_050"),
        (F.avg(adjusted) - F.first("mixture_share")).alias("mixture_mean_minus_share"),
        F.when(F.count(positive) > 0, F.avg(indicator(positive))).alias("actual_second_share"),
    )


def boundary_continuity(annual: DataFrame, before: int = 2003, after: int = 2004) -> DataFrame:
    """Jump of every estimator between the last unlabelled and first labelled year."""
    present = {
        row.year for row in annual.where(F.col("year").isin(before, after)).select("year").collect()
    }
    if present != {before, after}:
        raise ValueError(f"Years {before} and {after} are both needed")

    def at(year: int, column: str):
        return F.max(F.when(F.col("year") == year, F.col(column)))

    wide = annual.agg(
        at(after, "actual_second_share").alias("_actual"),
        *[at(before, name).alias(f"{name}_before") for name in ANNUAL_ESTIMATORS],
        *[at(after, name).alias(f"{name}_after") for name in ANNUAL_ESTIMATORS],
    )
    entries = [
        F.struct(
            F.lit(name).alias("estimator"),
            F.col(f"{name}_before").alias("predicted_before"),
            F.col(f"{name}_after").alias("predicted_after"),
        )
        for name in ANNUAL_ESTIMATORS
    ]
    first, second, actual = F.col("predicted_before"), F.col("predicted_after"), F.col("_actual")
    long = wide.select("_actual", F.inline(F.array(*entries)))
    return long.select(
        "estimator",
        first.alias(f"predicted_{before}"),
        second.alias(f"predicted_{after}"),
        (second - first).alias(f"predicted_{after}_minus_{before}"),
        actual.alias(f"actual_{after}"),
        (second - actual).alias(f"predicted_{after}_minus_actual"),
        (first - actual).alias(f"predicted_{before}_minus_actual_{after}"),
    )

"""Cell metrics: proper scores, calibration, thresholds and rank metrics.

``positive`` is always a boolean column expression and ``keys`` names the
columns that identify a cell. Every function evaluates all cells together.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import clip_probability, counted, indicator, logit, mean, ratio
from ..functions.storage import written, written_with
from .mixture import SHARE_TOLERANCE, adjusted_probability, share_table
from .quantiles import score_ranks
from .solvers import START_RECORDS, CalibrationSolver, ShareSolver, counted_starts, solve

THRESHOLD = 0.5
GRID_STEPS = 241
GRID_LIMIT = 12.0


# -- proper scores -----------------------------------------------------------


def checked(aggregate: Column, positive: Column, probability: Column) -> Column:
    """The aggregate, or an error if a record has no label or no probability in [0, 1].

    The test is part of the same aggregation, so it costs no scan.
    """
    valid = positive.isNotNull() & probability.between(0.0, 1.0) & ~F.isnan(probability)
    bad = F.count_if(~F.coalesce(valid, F.lit(False)))
    message = F.concat(F.lit("Metric cells violate their checks in "), bad.cast("string"), F.lit(" records"))
    return F.when(bad == 0, aggregate).otherwise(F.raise_error(message))


def score_aggregates(positive: Column, probability: Column, weight: Column | None = None) -> list[Column]:
    """Aggregates shared by every report of one cell."""
    y = indicator(positive)
    clipped = clip_probability(probability)
    loss = -(y * F.log(clipped) + (1.0 - y) * F.log1p(-clipped))
    return [
        checked(counted(weight), positive, probability).alias("n"),
        checked(mean((probability - y) * (probability - y), weight), positive, probability).alias("brier_score"),
        mean(loss, weight).alias("log_loss"),
        mean(y, weight).alias("observed_second_share"),
        mean(probability, weight).alias("mean_predicted_second_share"),
        (mean(probability, weight) - mean(y, weight)).alias("calibration_mean_error"),
    ]


def proper_scores(
    frame: DataFrame,
    keys: Sequence[str],
    positive: Column,
    probability: str = "probability",
    weight: str | None = None,
) -> DataFrame:
    held = None if weight is None else F.col(weight)
    return frame.groupBy(*keys).agg(*score_aggregates(positive, F.col(probability), held))


def probability_violations(
    frame: DataFrame, keys: Sequence[str], positive: Column, probability: str = "probability"
) -> DataFrame:
    """Counts per cell of everything a metric cell must not contain."""
    p = F.col(probability)
    return frame.groupBy(*keys).agg(
        F.count_if(p.isNull() | F.isnan(p) | (F.abs(p) == float("inf"))).alias("n_non_finite"),
        F.count_if((p < 0) | (p > 1)).alias("n_outside_unit"),
        F.count_if(positive.isNull()).alias("n_unlabelled"),
        (F.count_if(positive) * F.count_if(~positive) == 0).alias("is_single_class"),
    )


def validate_probabilities(
    frame: DataFrame, keys: Sequence[str], positive: Column, probability: str = "probability"
) -> None:
    bad = probability_violations(frame, keys, positive, probability).where(
        (F.col("n_non_finite") > 0)
        | (F.col("n_outside_unit") > 0)
        | (F.col("n_unlabelled") > 0)
        | F.col("is_single_class")
    )
    rows = bad.limit(5).collect()
    if rows:
        raise ValueError(f"Probability cells violate their checks: {rows}")


# -- calibration -------------------------------------------------------------


CALIBRATION_TOLERANCE = 1e-10
CALIBRATION_STEPS = 100
PRECISE_BELOW, PRECISE_ABOVE = -27.0, 12.0


def calibration_coefficients(
    frame: DataFrame,
    keys: Sequence[str],
    positive: Column,
    probability: str = "probability",
    tolerance: float = CALIBRATION_TOLERANCE,
    max_iterations: int = CALIBRATION_STEPS,
    weight: str | None = None,
) -> DataFrame:
    """Intercept and slope of ``y ~ logit(p)`` for every cell.

    A pass yields objective, gradient and information of the candidate point of
    each unfinished cell, so an accepted step costs one scan. A cell with one
    class is refused; cells whose fit does not exist for other reasons get null. With ``weight``, a
    row stands for that many equal records.
    """
    score = logit(clip_probability(F.col(probability)))
    held = [] if weight is None else [F.col(weight)]
    rows = frame.select(*keys, score.alias("_x"), indicator(positive).alias("_y"), *held).persist()
    state = solve(rows, keys, [CalibrationSolver("_x", "_y", tolerance, max_iterations, weight)])
    rows.unpersist()
    intercept, slope = CalibrationSolver.coefficients(state)
    return state.select(*keys, intercept.alias("calibration_intercept"), slope.alias("calibration_slope"))


def evaluate_probabilities(
    frame: DataFrame,
    keys: Sequence[str],
    positive: Column,
    probability: str = "probability",
    weight: str | None = None,
) -> DataFrame:
    """Proper scores and calibration of labelled probability cells."""
    keys = list(keys)
    return proper_scores(frame, keys, positive, probability, weight).join(
        calibration_coefficients(frame, keys, positive, probability, weight=weight), keys
    )


# -- mixture cells -----------------------------------------------------------


def cell_numbers(frame: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, float]:
    """Number the cells, so that records carry one integer and not all keys; and the mean of their rows.

    Numbers are unique but not gapless; written, they stay what they are.
    """
    sized = frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    numbered = sized.withColumn("_cell", F.monotonically_increasing_id())
    cells, seen = written_with(numbered, {"mean": F.avg("_rows")})
    return cells.drop("_rows"), seen.get("mean") or 0.0


def solve_cells(kept: DataFrame, weight: str | None = None, size: float = 0.0) -> DataFrame:
    """Share and calibration of (cell, label, log ratio) rows, both in the same passes.

    The score of a record is its log ratio plus the logit of its cell's share. So the fit on log
    ratios has the same slope, and its intercept differs by slope times that logit: it need not wait
    for the share. Where a probability is so near to 0 or 1 that it is clipped or loses digits,
    the cell is fitted again on its probabilities. ``size`` is the mean number of rows of a cell:
    large cells start from counts.
    """
    rows = kept.withColumn("_y", indicator(F.col("_positive")))
    fit = CalibrationSolver("log_ratio", "_y", CALIBRATION_TOLERANCE, CALIBRATION_STEPS, weight)
    large = weight is None and size >= START_RECORDS
    starts = {"starts": counted_starts(rows, ["_cell"], "log_ratio", "_y")} if large else {}
    state = solve(rows, ["_cell"], [ShareSolver("log_ratio", SHARE_TOLERANCE, 60, weight), fit], **starts)
    intercept, slope = CalibrationSolver.coefficients(state)
    shift = logit(F.col("mixture_share"))
    extreme = (F.col("_least_score") + shift < PRECISE_BELOW) | (F.col("_most_score") + shift > PRECISE_ABOVE)
    solved = share_table(state, ["_cell"]).join(
        state.select(
            "_cell",
            (intercept - slope * shift).alias("calibration_intercept"),
            slope.alias("calibration_slope"),
            extreme.alias("_extreme"),
        ),
        "_cell",
    )
    again = state.where(extreme).select("_cell", "mixture_share")
    if again.isEmpty():
        return solved.drop("_extreme")
    probability = adjusted_probability(F.col("log_ratio"), F.col("mixture_share"))
    exact = calibration_coefficients(
        kept.join(again, "_cell").withColumn("probability", probability),
        ["_cell"],
        F.col("_positive"),
        weight=weight,
    )
    coefficients = exact.select("_cell", F.struct("calibration_intercept", "calibration_slope").alias("_exact"))
    joined = solved.join(coefficients, "_cell", "left")
    for name in ("calibration_intercept", "calibration_slope"):
        joined = joined.withColumn(name, F.when(F.col("_extreme"), F.col(f"_exact.{name}")).otherwise(F.col(name)))
    return joined.drop("_exact", "_extreme")


def evaluate_log_ratios(
    scored: DataFrame,
    keys: Sequence[str],
    positive: Column,
    log_ratio: str = "log_ratio",
    threshold: float = THRESHOLD,
    weight: str | None = None,
) -> DataFrame:
    """Share, adjusted probability and all metrics of every cell.

    Solvers and metrics run on (cell number, label, log ratio) rows only. With ``weight``, a row
    stands for that many records of equal label and log ratio. The
    mean adjusted probability is the posterior-averaging update at the
    likelihood optimum, so the consistency check needs no pass of its own.
    """
    if not 0.0 <= threshold <= 1.0:
        raise ValueError("threshold must lie in [0, 1]")
    keys = list(keys)
    cells, size = cell_numbers(scored, keys)
    held = None if weight is None else F.col("_n")
    kept = scored.join(cells, keys).select(
        "_cell",
        positive.alias("_positive"),
        F.col(log_ratio).alias("log_ratio"),
        *([] if weight is None else [F.col(weight).alias("_n")]),
    ).persist()
    number = ["_cell"]
    solved = solve_cells(kept, None if weight is None else "_n", size)
    adjusted = kept.join(solved.select("_cell", "mixture_share"), number).withColumn(
        "probability", adjusted_probability(F.col("log_ratio"), F.col("mixture_share"))
    )
    y = F.col("_positive")
    p = F.col("probability")
    scores = adjusted.groupBy(*number).agg(
        *score_aggregates(y, p, held), mean(indicator(p >= threshold), held).alias("hard_share_050")
    )
    difference = F.col("mixture_share") - F.col("mean_predicted_second_share")
    table = (
        scores.join(solved.drop("n"), number)
        .join(cells, number)
        .select(
            *keys,
            F.col("n").alias("n_observations"),
            F.col("observed_second_share").alias("actual_second_share"),
            "mixture_share",
            F.col("mean_predicted_second_share").alias("mean_probability"),
            "hard_share_050",
            "brier_score",
            "log_loss",
            "calibration_mean_error",
            "calibration_intercept",
            "calibration_slope",
            "mean_log_likelihood",
            "optimizer_converged",
            "optimizer_iterations",
            "mixture_at_boundary",
            difference.alias("mixture_em_difference"),
            (F.abs(difference) < SHARE_TOLERANCE).alias("em_converged"),
        )
    )
    result = written(table)
    kept.unpersist()
    return result


def cell_violations(cells: DataFrame) -> DataFrame:
    """One row per cell and broken range rule."""
    shares = (
        "actual_second_share",
        "mixture_share",
        "mean_probability",
        "hard_share_050",
        "brier_score",
    )

    def unfinite(name: str) -> Column:
        return F.isnan(name) | (F.abs(F.col(name)) == float("inf"))

    rules = {
        "horizon_positive": F.col("horizon") <= 0,
        "n_observations_positive": F.col("n_observations") <= 0,
        **{
            f"{name}_unit_interval": F.col(name).isNull()
            | unfinite(name)
            | ~F.col(name).between(0.0, 1.0)
            for name in shares
        },
        "log_loss_nonnegative": F.col("log_loss").isNull()
        | unfinite("log_loss")
        | (F.col("log_loss") < 0),
        **{
            f"{name}_finite": F.coalesce(unfinite(name), F.lit(False))
            for name in ("calibration_mean_error", "calibration_intercept", "calibration_slope")
            if name in cells.columns
        },
    }
    listed = F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()])
    return cells.withColumn("rule", F.explode(F.array_compact(listed)))


# -- thresholds --------------------------------------------------------------


def confusion_aggregates(
    positive: Column, probability: Column, threshold: float = THRESHOLD
) -> list[Column]:
    called = probability >= threshold
    y = indicator(positive)
    return [
        checked(F.count(F.lit(1)), positive, probability).alias("n"),
        F.count_if(positive & called).alias("true_positive"),
        F.count_if(~positive & called).alias("false_positive"),
        F.count_if(positive & ~called).alias("false_negative"),
        F.count_if(~positive & ~called).alias("true_negative"),
        F.avg(y).alias("observed_second_share"),
        F.avg(probability).alias("mean_probability"),
        F.avg(indicator(called)).alias("hard_second_share"),
        F.avg((probability - y) * (probability - y)).alias("brier_score"),
    ]


def confusion_ratios(counts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Accuracy, precision, recall and F1; an empty denominator gives zero."""
    tp, fp = F.col("true_positive"), F.col("false_positive")
    fn, tn = F.col("false_negative"), F.col("true_negative")
    precision, recall = F.col("precision_second"), F.col("recall_second")
    return (
        counts.withColumns(
            {
                "threshold": F.lit(float(threshold)),
                "accuracy": ratio(tp + tn, F.col("n"), 0.0),
                "precision_second": ratio(tp, tp + fp, 0.0),
                "recall_second": ratio(tp, tp + fn, 0.0),
            }
        )
        .withColumn("f1_second", ratio(2 * precision * recall, precision + recall, 0.0))
    )


def threshold_metrics(
    frame: DataFrame,
    keys: Sequence[str],
    positive: Column,
    probability: str = "probability",
    threshold: float = THRESHOLD,
    include_average_precision: bool = True,
) -> DataFrame:
    keys = list(keys)
    counts = frame.groupBy(*keys).agg(
        *confusion_aggregates(positive, F.col(probability), threshold)
    )
    metrics = confusion_ratios(counts, threshold)
    if include_average_precision:
        ranked = rank_metrics(frame, keys, positive, probability)
        metrics = metrics.join(ranked.select(*keys, "average_precision"), keys)
    return metrics


def rank_metrics(
    frame: DataFrame, keys: Sequence[str], positive: Column, probability: str = "probability"
) -> DataFrame:
    """Step-function average precision and tie-averaged ROC area per cell."""
    keys = list(keys)
    ranks = score_ranks(frame, keys, probability, positive)
    hits = F.col("positive_above") + F.col("n_positive")
    called = F.col("n_above") + F.col("n")
    misses = F.col("n") - F.col("n_positive")
    sums = ranks.groupBy(*keys).agg(
        F.sum("n_positive").alias("_p"),
        F.sum(misses).alias("_q"),
        F.sum(F.col("n_positive") * (hits / called)).alias("_precision"),
        F.sum(
            misses.cast("double") * (F.col("positive_above") + F.col("n_positive") / 2.0)
        ).alias("_area"),
    )
    return sums.select(
        *keys,
        ratio(F.col("_precision"), F.col("_p"), 0.0).alias("average_precision"),
        F.when(
            (F.col("_p") > 0) & (F.col("_q") > 0),
            F.col("_area") / (F.col("_p").cast("double") * F.col("_q")),
        ).alias("roc_auc"),
    )


def threshold_grid() -> list[float]:
    """Logit-spaced thresholds with 0, one half and 1."""
    step = 2 * GRID_LIMIT / (GRID_STEPS - 1)
    points = [-GRID_LIMIT + step * position for position in range(GRID_STEPS)]
    values = {1.0 / (1.0 + math.exp(-point)) for point in points}
    return sorted(values | {0.0, 0.5, 1.0})


def precision_recall_counts(
    frame: DataFrame,
    keys: Sequence[str],
    positive: Column,
    probability: str = "probability",
    thresholds: Sequence[float] | None = None,
) -> DataFrame:
    """Confusion counts on a fixed grid.

    Records are reduced to bucket counts first; the reverse cumulative sum then
    runs over at most one row per threshold and cell.
    """
    from pyspark.ml.feature import Bucketizer

    keys = list(keys)
    grid = threshold_grid() if thresholds is None else [float(t) for t in thresholds]
    splits = [-math.inf, *grid, math.inf]
    rows = frame.select(
        *keys, positive.alias("_y"), F.col(probability).cast("double").alias("_p")
    )
    bucketed = Bucketizer(splits=splits, inputCol="_p", outputCol="_bucket").transform(rows)
    counts = bucketed.groupBy(*keys, F.col("_bucket").cast("int").alias("_bucket")).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if("_y").alias("_hits")
    )
    points = F.array(*[F.struct(F.lit(i + 1).alias("_bucket"), F.lit(t).alias("threshold")) for i, t in enumerate(grid)])
    cells = counts.groupBy(*keys).agg(F.sum("_hits").alias("_positives"))
    skeleton = cells.select(*keys, "_positives", F.inline(points))
    at_or_above = (
        Window.partitionBy(*keys)
        .orderBy(F.col("_bucket").desc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    curve = skeleton.join(counts, [*keys, "_bucket"], "left").withColumns(
        {
            "_called": F.sum(F.coalesce("_n", F.lit(0))).over(at_or_above),
            "true_positive": F.sum(F.coalesce("_hits", F.lit(0))).over(at_or_above),
        }
    )
    tp = F.col("true_positive")
    return curve.select(
        *keys,
        "threshold",
        "true_positive",
        (F.col("_called") - tp).alias("false_positive"),
        (F.col("_positives") - tp).alias("false_negative"),
        ratio(tp, F.col("_called"), 1.0).alias("precision"),
        F.try_divide(tp, F.col("_positives")).alias("recall"),
    )


def paired_comparison(
    frame: DataFrame,
    keys: Sequence[str],
    positive: Column,
    left: str,
    right: str,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """How often exactly one of two estimators classifies a record correctly."""
    left_right = (F.col(left) >= threshold) == positive
    right_right = (F.col(right) >= threshold) == positive
    return frame.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(left_right & ~right_right).alias("n_only_left"),
        F.count_if(~left_right & right_right).alias("n_only_right"),
        (F.count_if(left_right) - F.count_if(right_right)).alias("net_left"),
    )

"""Equal-count bins, subgroups and tail quantiles of scored cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..domain import DEFAULT, REGION_LEVELS, Domain
from ..functions.expressions import bucket_right, counted, indicator, mean
from ..functions.joins import join_bounded
from .clean import region_of
from .metrics import THRESHOLD, confusion_aggregates, confusion_ratios
from .quantiles import counted_quantiles, decile_probabilities, exact_quantiles, interior_cuts

TAIL_LEVELS = {
    "min": 0.0,
    "p001": 0.001,
    "p01": 0.01,
    "median": 0.5,
    "p99": 0.99,
    "p999": 0.999,
    "max": 1.0,
}


def _quantiles(
    frame: DataFrame, keys: Sequence[str], value: str, levels: Sequence[float], weight: str | None
) -> DataFrame:
    if weight is None:
        return exact_quantiles(frame, keys, value, levels, "_q")
    return counted_quantiles(frame, keys, value, weight, levels, "_q")


def with_bins(
    frame: DataFrame, keys: Sequence[str], value: str, n_bins: int, name: str, weight: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Attach a zero-based equal-count bin; also return each cell's cuts."""
    keys = list(keys)
    levels = decile_probabilities(n_bins)
    cuts = _quantiles(frame, keys, value, levels, weight).select(
        *keys, interior_cuts(F.col("_q")).alias(f"{name}_cuts")
    )
    joined = join_bounded(frame, cuts, keys)
    bins = bucket_right(F.col(value), F.col(f"{name}_cuts"), len(levels))
    return joined.withColumn(name, bins).drop(f"{name}_cuts"), cuts


def reliability_bins(
    frame: DataFrame,
    keys: Sequence[str],
    positive: Column,
    probability: str = "probability",
    n_bins: int = 10,
    weight: str | None = None,
) -> DataFrame:
    """Observed and predicted shares of equal-count probability bins.

    With ``weight``, a row stands for that many equal records.
    """
    if n_bins < 2:
        raise ValueError("One bin is no binning")
    keys = list(keys)
    held = None if weight is None else F.col("_w")
    rows = frame.select(
        *keys,
        positive.alias("_y"),
        F.col(probability).alias("_p"),
        *([] if weight is None else [F.col(weight).alias("_w")]),
    )
    binned, _ = with_bins(rows, keys, "_p", n_bins, "_bin", None if weight is None else "_w")
    return binned.groupBy(*keys, (F.col("_bin") + 1).alias("probability_bin")).agg(
        counted(held).alias("n"),
        F.min("_p").alias("min_probability"),
        F.max("_p").alias("max_probability"),
        mean(F.col("_p"), held).alias("mean_predicted_probability"),
        mean(indicator(F.col("_y")), held).alias("observed_second_share"),
    )


def tail_metrics(
    frame: DataFrame,
    keys: Sequence[str],
    log_ratio: str = "log_ratio",
    limit: float = 10.0,
    weight: str | None = None,
) -> DataFrame:
    """Tail quantiles and extreme shares of the log ratio."""
    keys = list(keys)
    quantiles = _quantiles(frame, keys, log_ratio, list(TAIL_LEVELS.values()), weight)
    value, held = F.col(log_ratio), None if weight is None else F.col(weight)
    extremes = frame.groupBy(*keys).agg(
        mean(indicator(value > limit), held).alias("share_log_ratio_gt_10"),
        mean(indicator(value < -limit), held).alias("share_log_ratio_lt_minus_10"),
    )
    return quantiles.join(extremes, keys).select(
        *keys,
        *[
            F.get("_q", F.lit(position)).alias(f"log_ratio_{label}")
            for position, label in enumerate(TAIL_LEVELS)
        ],
        "share_log_ratio_gt_10",
        "share_log_ratio_lt_minus_10",
    )


def _dimension(name: str, value: Column) -> Column:
    return F.struct(
        F.lit(name).alias("subgroup_dimension"), value.cast("string").alias("subgroup_value")
    )


def categorical_dimensions(frame: DataFrame, domain: Domain = DEFAULT) -> list[Column]:
    """Declared codes and the region; undeclared values belong to no group."""
    entries = []
    for name in ("loan_type", "purchaser_type"):
        if name in frame.columns and name in domain.categories:
            code = F.col(name).cast("int")
            entries.append(_dimension(name, F.when(code.isin(*domain.categories[name]), code)))
    if domain.region_column in frame.columns:
        region = region_of(F.col(domain.region_column).cast("long"))
        entries.append(_dimension("region", F.when(region.isin(*REGION_LEVELS), region)))
    return entries


def _grouped(
    frame: DataFrame,
    keys: Sequence[str],
    entries: Sequence[Column],
    positive: Column,
    probability: str,
    threshold: float,
) -> DataFrame:
    rows = frame.select(
        *keys, positive.alias("_y"), F.col(probability).alias("_p"), F.inline(F.array(*entries))
    ).where(F.col("subgroup_value").isNotNull())
    return rows.groupBy(*keys, "subgroup_dimension", "subgroup_value").agg(
        *confusion_aggregates(F.col("_y"), F.col("_p"), threshold)
    )


def categorical_subgroups(
    frame: DataFrame,
    keys: Sequence[str],
    positive: Column,
    probability: str = "probability",
    *,
    threshold: float = THRESHOLD,
    domain: Domain = DEFAULT,
) -> DataFrame:
    entries = categorical_dimensions(frame, domain)
    counts = _grouped(frame, keys, entries, positive, probability, threshold)
    return confusion_ratios(counts, threshold)


def subgroup_metrics(
    frame: DataFrame,
    keys: Sequence[str],
    positive: Column,
    probability: str = "probability",
    *,
    continuous: Sequence[str] | None = None,
    threshold: float = THRESHOLD,
    domain: Domain = DEFAULT,
) -> DataFrame:
    """Metrics of all declared groups and of the deciles of each feature.

    Every record is expanded once to its dimensions and counted in one
    aggregate. Decile groups that received no record are reported with n = 0.
    """
    keys = list(keys)
    names = [name for name in (continuous or domain.continuous) if name in frame.columns]
    entries = categorical_dimensions(frame, domain)
    rows, skeleton = frame, None
    for name in names:
        rows, cuts = with_bins(rows, keys, name, 10, f"{name}_bin")
        label = f"{name}_target_decile"
        entries.append(_dimension(label, F.col(f"{name}_bin") + 1))
        positions = F.explode(F.sequence(F.lit(1), F.size(f"{name}_bin_cuts") + 1))
        groups = cuts.select(*keys, positions.alias("_position")).select(
            *keys,
            F.lit(label).alias("subgroup_dimension"),
            F.col("_position").cast("string").alias("subgroup_value"),
        )
        skeleton = groups if skeleton is None else skeleton.unionByName(groups)
    counts = _grouped(rows, keys, entries, positive, probability, threshold)
    if skeleton is not None:
        group_keys = [*keys, "subgroup_dimension", "subgroup_value"]
        empty = skeleton.join(counts.select(*group_keys), group_keys, "left_anti")
        zeros = ("n", "true_positive", "false_positive", "false_negative", "true_negative")
        empty = empty.withColumns(
            {
                name: F.lit(0).cast("long") if name in zeros else F.lit(None).cast("double")
                for name in counts.columns
                if name not in group_keys
            }
        )
        counts = counts.unionByName(empty)
    return confusion_ratios(counts, threshold)

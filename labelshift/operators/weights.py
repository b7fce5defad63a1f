"""Source-prior weights and class counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..domain import DEFAULT, Domain
from ..functions.expressions import share_true
from ..functions.joins import join_bounded


def is_positive(domain: Domain = DEFAULT):
    return F.col(domain.label) == domain.positive_class


def year_shares(
    frame: DataFrame, keys: Sequence[str] = ("year",), domain: Domain = DEFAULT
) -> DataFrame:
    """Positive share of each source year."""
    return frame.groupBy(*keys).agg(
        share_true(is_positive(domain)).alias("positive_share"), F.count(F.lit(1)).alias("n_year")
    )


def single_class_years(
    frame: DataFrame, keys: Sequence[str] = ("year",), domain: Domain = DEFAULT
) -> DataFrame:
    return year_shares(frame, keys, domain).where(
        (F.col("positive_share") <= 0) | (F.col("positive_share") >= 1)
    )


def equal_prior_weights(
    frame: DataFrame,
    keys: Sequence[str] = ("year",),
    *,
    domain: Domain = DEFAULT,
    validate: bool = True,
) -> DataFrame:
    """Give both classes half of every source year's weight.

    The share is one aggregate per year joined back, not a window over all
    records of a year, so a year holding most records is not one task's work.
    """
    shares = year_shares(frame, keys, domain)
    if validate:
        bad = shares.where((F.col("positive_share") <= 0) | (F.col("positive_share") >= 1))
        rows = bad.orderBy(*keys).limit(5).collect()
        if rows:
            raise ValueError(f"Source years must contain both classes: {rows}")
    weighted = join_bounded(frame, shares.drop("n_year"), list(keys))
    share = F.col("positive_share")
    weight = F.when(is_positive(domain), 0.5 / share).otherwise(0.5 / (1.0 - share))
    return weighted.withColumn("source_weight", weight).drop("positive_share")


def training_counts(
    frame: DataFrame, keys: Sequence[str] = (), domain: Domain = DEFAULT
) -> DataFrame:
    """Row and class counts and the number of undeclared labels."""
    label = F.col(domain.label)
    known = F.coalesce(label.isin(domain.negative_class, domain.positive_class), F.lit(False))
    return frame.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_training"),
        F.count_if(label == domain.negative_class).alias("n_first"),
        F.count_if(label == domain.positive_class).alias("n_second"),
        F.count_if(~known).alias("n_unknown"),
    )

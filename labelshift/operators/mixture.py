"""Class-share estimation of unlabelled cells from log density ratios.

Each solver step is one grouped aggregate over all cells at once. The state of the cells is a
table (:mod:`.solvers`), so neither records nor cells reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import expit, log_add_exp
from ..functions.joins import join_bounded
from .solvers import SHARE_BOUND, PosteriorSolver, ShareSolver, cell_values, solve

SHARE_TOLERANCE = 1e-8
EXP_BAND = 64.0


def adjusted_probability(log_ratio: Column, share: Column) -> Column:
    """Posterior of the positive class at a proposed class share."""
    return expit(log_ratio + F.log(share / (1.0 - share)))


def mixture_log_likelihood(log_ratio: Column, share: Column) -> Column:
    """Record log likelihood up to the negative-class density."""
    return log_add_exp(F.log1p(-share), F.log(share) + log_ratio)


def check_share(share: float) -> None:
    if not 0 < share < 1:
        raise ValueError("A mixture share lies inside (0, 1)")


def log_mean_exp(frame: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """``log(mean(exp(value)))`` per group in one scan without overflow.

    Values are summed relative to the lower edge of a band of width 64; the few
    bands of each group are then combined relative to the highest one.
    """
    band = F.floor(F.col(value) / EXP_BAND)
    banded = frame.where(F.col(value).isNotNull()).groupBy(*keys, band.alias("_band")).agg(
        F.sum(F.exp(F.col(value) - band * EXP_BAND)).alias("_sum"),
        F.count(F.lit(1)).alias("_n"),
    )
    listed = F.collect_list(F.struct(F.col("_band").alias("b"), F.col("_sum").alias("s")))
    grouped = banded.groupBy(*keys).agg(
        listed.alias("_parts"), F.max("_band").alias("_top"), F.sum("_n").alias("_n")
    )
    total = F.aggregate(
        "_parts",
        F.lit(0.0),
        lambda held, part: held + part["s"] * F.exp((part["b"] - F.col("_top")) * EXP_BAND),
    )
    return grouped.select(
        *keys, (F.log(total) + F.col("_top") * EXP_BAND - F.log("_n")).alias(name)
    )


def ratio_log_means(frame: DataFrame, keys: Sequence[str], log_ratio: str, is_positive: Column) -> DataFrame:
    """Log of the mean ratio over the negative and of the mean inverse ratio over the positive class, in one scan."""
    keys = list(keys)
    signed = F.when(is_positive, -F.col(log_ratio)).otherwise(F.col(log_ratio))
    labelled = frame.where(is_positive.isNotNull()).select(
        *keys, is_positive.alias("_positive"), signed.alias("_signed")
    )
    means = log_mean_exp(labelled, [*keys, "_positive"], "_signed", "_mean")
    both = means.groupBy(*keys).agg(
        F.max(F.when(~F.col("_positive"), F.col("_mean"))).alias("log_mean_first"),
        F.max(F.when(F.col("_positive"), F.col("_mean"))).alias("log_mean_inverse_second"),
    )
    return both.dropna(subset=["log_mean_first", "log_mean_inverse_second"])


def ratio_normalisation(
    frame: DataFrame, keys: Sequence[str], log_ratio: str, is_positive: Column
) -> DataFrame:
    """Mean ratio over the negative and mean inverse ratio over the positive class."""
    return ratio_log_means(frame, keys, log_ratio, is_positive).select(
        *keys,
        F.exp("log_mean_first").alias("mean_ratio_first"),
        F.exp("log_mean_inverse_second").alias("mean_inverse_ratio_second"),
    )


def estimate_shares(
    scored: DataFrame,
    keys: Sequence[str],
    log_ratio: str = "log_ratio",
    tolerance: float = SHARE_TOLERANCE,
    max_iterations: int = 60,
    weight: str | None = None,
) -> DataFrame:
    """Maximum-likelihood share of every cell with its diagnostics."""
    rows = scored.select(*keys, log_ratio, *([] if weight is None else [weight])).persist()
    state = solve(rows, keys, [ShareSolver(log_ratio, tolerance, max_iterations, weight)])
    rows.unpersist()
    return share_table(state, keys)


def share_table(state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shares and their diagnostics from the state of a finished run."""
    share = F.col("mixture_share")
    edge = 10 * SHARE_BOUND
    return state.select(
        *keys,
        "n",
        "mixture_share",
        "mean_log_likelihood",
        "optimizer_converged",
        "optimizer_iterations",
        ((share <= edge) | (share >= 1.0 - edge)).alias("mixture_at_boundary"),
    )


def estimate_shares_em(
    scored: DataFrame,
    keys: Sequence[str],
    log_ratio: str = "log_ratio",
    initial: float | Mapping[tuple, float] = 0.5,
    tolerance: float = SHARE_TOLERANCE,
    max_iterations: int = 10_000,
    accelerate: bool = False,
) -> DataFrame:
    """Share by repeated averaging of the posterior, all cells together.

    With ``accelerate`` each third update starts from Aitken's extrapolation of the two before.
    A cell still ends only where a plain update leaves its share in place, so the result is the
    same fixed point after far fewer scans. Given starts restrict the run to their cells.
    """
    if isinstance(initial, Mapping):
        begin = cell_values(scored, keys, initial, "em_share")
    else:
        check_share(initial)
        begin = initial
    rows = scored.select(*keys, log_ratio).persist()
    solver = PosteriorSolver(log_ratio, begin, keys, tolerance, max_iterations, accelerate)
    state = solve(rows, keys, [solver])
    rows.unpersist()
    return state.select(*keys, "em_share", "em_converged", "em_iterations")


def adjust_cells(
    scored: DataFrame,
    keys: Sequence[str],
    log_ratio: str = "log_ratio",
    estimator: Callable[..., DataFrame] = estimate_shares,
) -> DataFrame:
    """Attach each cell's share and the adjusted probability to its records."""
    shares = estimator(scored, keys, log_ratio)
    share_column = "mixture_share" if "mixture_share" in shares.columns else "em_share"
    shares = shares.select(*keys, F.col(share_column).alias("mixture_share"))
    joined = join_bounded(scored, shares, keys)
    return joined.withColumn(
        "probability", adjusted_probability(F.col(log_ratio), F.col("mixture_share"))
    )

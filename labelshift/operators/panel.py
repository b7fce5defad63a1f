"""County index panels: coverage, annual values, scales and scaled values."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.joins import require_unique

SCALE_COLUMNS = {
    "geometric": "scale_geometric",
    "ols_origin": "scale_ols_origin",
    "median_log_ratio": "scale_median_log_ratio",
    "anchor_2017": "scale_anchor_2017",
}
ANCHOR_YEAR = 2017


def coverage_keys(index: DataFrame, years: Sequence[int]) -> DataFrame:
    """Covered (fips, year) pairs and whether the county covers every year."""
    years = sorted({int(year) for year in years})
    covered = (
        index.where(F.col("year").isin(*years) & F.col("hpi").isNotNull())
        .select(F.col("fips").cast("long").alias("fips"), F.col("year").cast("int").alias("year"))
        .distinct()
    )
    complete = covered.groupBy("fips").agg(
        (F.count(F.lit(1)) == len(years)).alias("is_balanced")
    )
    return covered.join(complete, "fips")


def balanced_panel(index: DataFrame, years: Sequence[int]) -> DataFrame:
    """Rows of the counties whose index is present in every year."""
    complete = coverage_keys(index, years).where("is_balanced").select("fips").distinct()
    return (
        index.where(F.col("year").isin(*[int(year) for year in years]))
        .join(complete, "fips", "left_semi")
        .select("fips", "year", "hpi")
    )


def annualise(monthly: DataFrame, required_months: int = 12) -> DataFrame:
    """Average the monthly series into calendar years with enough months."""
    return (
        monthly.where(F.col("fips").isNotNull() & F.col("zhvi").isNotNull())
        .groupBy("fips", F.year("date").alias("year"))
        .agg(F.avg("zhvi").alias("zhvi"), F.count(F.lit(1)).alias("n_zhvi_months"))
        .where(F.col("n_zhvi_months") >= required_months)
    )


def index_value_overlap(index: DataFrame, annual: DataFrame, *, validate: bool = True) -> DataFrame:
    """One row per county-year held by both series, with their log ratio."""
    left = index.select(F.col("fips").cast("long").alias("fips"), "year", "hpi")
    right = annual.select("fips", "year", "zhvi", "n_zhvi_months")
    if validate:
        require_unique(left, ["fips", "year"], "index panel")
        require_unique(right, ["fips", "year"], "annual values")
    return (
        left.join(right, ["fips", "year"])
        .where((F.col("hpi") > 0) & (F.col("zhvi") > 0))
        .withColumns({"log_hpi": F.log("hpi"), "log_zhvi": F.log("zhvi")})
        .withColumn("log_ratio", F.col("log_zhvi") - F.col("log_hpi"))
    )


def estimate_scales(overlap: DataFrame, anchor_year: int = ANCHOR_YEAR) -> DataFrame:
    """Value-per-index-point scale of each county and its stability measures."""
    log_ratio = F.col("log_ratio")
    spread = F.var_pop("log_hpi")
    usable = (F.count(F.lit(1)) >= 2) & (spread > 0)
    return overlap.groupBy("fips").agg(
        F.count(F.lit(1)).alias("n_overlap_years"),
        F.min("year").alias("first_overlap_year"),
        F.max("year").alias("last_overlap_year"),
        F.exp(F.avg(log_ratio)).alias("scale_geometric"),
        (F.sum(F.col("hpi") * F.col("zhvi")) / F.sum(F.col("hpi") * F.col("hpi"))).alias(
            "scale_ols_origin"
        ),
        F.exp(F.median(log_ratio)).alias("scale_median_log_ratio"),
        F.exp(F.max(F.when(F.col("year") == anchor_year, log_ratio))).alias("scale_anchor_2017"),
        F.stddev_pop(log_ratio).alias("log_rmse_geometric"),
        F.stddev_pop(log_ratio).alias("log_ratio_sd"),
        F.when(usable, F.covar_pop("year", "log_ratio") / F.var_pop("year")).alias(
            "log_ratio_time_trend"
        ),
        F.when(usable, F.covar_pop("log_hpi", "log_zhvi") / spread).alias("unrestricted_log_slope"),
    )


def build_value_panel(
    index: DataFrame,
    scales: DataFrame,
    years: Iterable[int],
    method: str = "geometric",
    min_overlap_years: int = 1,
    *,
    validate: bool = True,
) -> DataFrame:
    """Apply the scale of each supported county to all its index years."""
    if method not in SCALE_COLUMNS:
        raise ValueError(f"No scale is called {method!r}; there are {', '.join(SCALE_COLUMNS)}")
    scale = F.col(SCALE_COLUMNS[method])
    eligible = scales.where(
        (F.col("n_overlap_years") >= min_overlap_years) & scale.isNotNull()
    ).select("fips", "n_overlap_years", SCALE_COLUMNS[method])
    if validate:
        require_unique(eligible, ["fips"], "scales")
    return (
        index.where(F.col("year").isin(*[int(year) for year in years]) & (F.col("hpi") > 0))
        .select(F.col("fips").cast("long").alias("fips"), "year", "hpi")
        .join(eligible, "fips")
        .withColumn("county_value", F.col("hpi") * scale)
        .withColumn("scaling_method", F.lit(method))
    )


def county_value_panel(
    index: DataFrame,
    monthly: DataFrame,
    years: Iterable[int],
    *,
    method: str = "geometric",
    min_overlap_years: int = 1,
    required_months: int = 12,
    anchor_year: int = ANCHOR_YEAR,
    validate: bool = True,
) -> DataFrame:
    """Annual values, scales and panel in one plan."""
    annual = annualise(monthly, required_months)
    scales = estimate_scales(index_value_overlap(index, annual, validate=validate), anchor_year)
    panel = build_value_panel(index, scales, years, method, min_overlap_years, validate=False)
    return panel.select("fips", "year", "hpi", "county_value")


def support_summary(scales: DataFrame, minimums: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """County counts and usable scales at each support cut-off."""
    entries = []
    for minimum in minimums:
        enough = F.col("n_overlap_years") >= minimum
        entries.append(
            F.struct(
                F.lit(int(minimum)).alias("min_overlap_years"),
                F.count_if(enough).alias("n_counties"),
                *[
                    F.count_if(enough & F.col(column).isNotNull()).alias(f"n_counties_{method}")
                    for method, column in SCALE_COLUMNS.items()
                ],
            )
        )
    return scales.agg(F.array(*entries).alias("rows")).select(F.inline("rows"))


def index_comparability(index: DataFrame, years: Sequence[int]) -> DataFrame:
    """Native against common-base levels per year over the balanced counties.

    The scale of a county is the one of its first year with a value, chosen by
    year rather than by input order.
    """
    complete = coverage_keys(index, years).where("is_balanced").select("fips").distinct()
    rows = (
        index.where(F.col("year").isin(*[int(year) for year in years]))
        .join(complete, "fips", "left_semi")
        .withColumn("scale", F.col("hpi") / F.col("hpi_1990_base"))
    )
    constant = (F.min("hpi") == F.max("hpi")) | (F.min("hpi_1990_base") == F.max("hpi_1990_base"))
    levels = rows.groupBy("year").agg(
        F.count_distinct("fips").alias("n_balanced_counties"),
        F.min("hpi").alias("native_hpi_min"),
        F.median("hpi").alias("native_hpi_median"),
        F.max("hpi").alias("native_hpi_max"),
        F.min("hpi_1990_base").alias("base_1990_hpi_min"),
        F.median("hpi_1990_base").alias("base_1990_hpi_median"),
        F.max("hpi_1990_base").alias("base_1990_hpi_max"),
        F.when(
            ~constant,
            F.try_divide(
                F.covar_pop("hpi", "hpi_1990_base"),
                F.stddev_pop("hpi") * F.stddev_pop("hpi_1990_base"),
            ),
        ).alias("native_base_1990_correlation"),
    )
    quantiles = (0.0, 0.1, 0.5, 0.9, 1.0)
    first_scale = rows.groupBy("fips").agg(
        F.min_by("scale", F.when(F.col("scale").isNotNull(), F.col("year"))).alias("scale")
    )
    spread = first_scale.agg(F.percentile("scale", F.array(*map(F.lit, quantiles))).alias("q"))
    scaled = levels.withColumn("q", spread.scalar())
    names = [f"native_to_1990_scale_p{int(100 * level):03d}" for level in quantiles]
    return scaled.withColumns(
        {name: F.get("q", F.lit(position)) for position, name in enumerate(names)}
    ).drop("q")

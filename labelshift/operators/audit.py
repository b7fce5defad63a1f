"""Attrition and coverage audits from one grouped scan of the records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..domain import DEFAULT, STAGES, Domain
from .clean import (
    label_reported,
    originated,
    positive_amounts,
    valid_geography,
    valid_loan_type,
)
from .panel import coverage_keys, index_comparability

SCAN_STAGES = STAGES[:6]
MATCH_STAGES = STAGES[6:]


def stage_masks(
    frame: DataFrame, domain: Domain = DEFAULT, unlabelled_before: int | None = None
) -> dict[str, Column]:
    """Cumulative stage predicates that need no join; null counts as false."""
    tests = (
        F.lit(True),
        originated(),
        label_reported(frame, domain, unlabelled_before),
        valid_geography(domain),
        positive_amounts(),
        valid_loan_type(),
    )
    masks, held = {}, F.lit(True)
    for stage, test in zip(SCAN_STAGES, tests, strict=True):
        held = held & F.coalesce(test, F.lit(False))
        masks[stage] = held
    return masks


def stage_cube(
    frame: DataFrame, domain: Domain = DEFAULT, unlabelled_before: int | None = None
) -> DataFrame:
    """Stage counts per (year, label, county key).

    This is the only pass over the records. Every audit table is a roll-up of
    this small cube, and county sets are joined to the cube rather than to
    records.
    """
    label = F.col(domain.label) if domain.label in frame.columns else F.lit(None)
    key = F.lit(1000.0) * F.col("state_code") + F.col("county_code")
    masks = stage_masks(frame, domain, unlabelled_before)
    return frame.groupBy(
        F.col("year").cast("int").alias("year"),
        label.cast("int").alias("label"),
        key.alias("county"),
    ).agg(*[F.count_if(mask).alias(stage) for stage, mask in masks.items()])


def match_cube(cube: DataFrame, keys: DataFrame) -> DataFrame:
    """Flag the cube's county-years against balanced and yearly key sets."""
    flags = keys.select(
        F.col("year").cast("int").alias("year"),
        F.col("fips").cast("double").alias("county"),
        F.lit(True).alias("in_year"),
    ).distinct()
    balanced = (
        keys.where("is_balanced")
        .select(F.col("fips").cast("double").alias("county"), F.lit(True).alias("in_balanced"))
        .distinct()
    )
    valid = F.col("valid_loan_type")
    matched = cube.join(flags, ["year", "county"], "left").join(balanced, ["county"], "left")
    in_year = F.coalesce("in_year", F.lit(False))
    in_balanced = F.coalesce("in_balanced", F.lit(False))
    return matched.withColumns(
        {
            "in_year": in_year,
            "in_balanced": in_balanced,
            **{stage: F.when(in_balanced, valid).otherwise(0) for stage in MATCH_STAGES},
        }
    )


def long_stages(wide: DataFrame, keys: Sequence[str], stages: Sequence[str]) -> DataFrame:
    entries = [
        F.struct(
            F.lit(STAGES.index(stage)).alias("stage_order"),
            F.lit(stage).alias("stage"),
            F.col(stage).alias("n"),
        )
        for stage in stages
    ]
    return wide.select(*keys, F.inline(F.array(*entries)))


def add_retention(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Dropped rows and retention against the previous and the raw stage."""
    ordered = Window.partitionBy(*keys).orderBy("stage_order")
    n = F.col("n")
    previous, raw = F.lag("n").over(ordered), F.first("n").over(ordered)
    return counts.withColumns(
        {
            "n_dropped": F.coalesce(previous - n, F.lit(0)).cast("long"),
            "retention_from_previous": F.when(previous > 0, n / previous).otherwise(1.0),
            "retention_from_raw": F.when(raw > 0, n / raw),
        }
    )


def stage_counts(cube: DataFrame) -> DataFrame:
    """Cumulative counts by year; works on a matched or unmatched cube."""
    stages = [stage for stage in STAGES if stage in cube.columns]
    wide = cube.groupBy("year").agg(*[F.sum(stage).alias(stage) for stage in stages])
    return add_retention(long_stages(wide, ["year"], stages), ["year"])


def class_counts(cube: DataFrame, domain: Domain = DEFAULT) -> DataFrame:
    """The same by class, for the years that report a label."""
    stages = [stage for stage in STAGES if stage in cube.columns]
    classes = (domain.negative_class, domain.positive_class)
    labelled = cube.where(F.col("label").isNotNull())
    wide = labelled.groupBy("year").agg(
        *[
            F.sum(F.when(F.col("label") == code, F.col(stage)).otherwise(0)).alias(f"{stage}_{code}")
            for code in classes
            for stage in stages
        ]
    )
    rows = [
        F.struct(F.lit(code).alias("lien_status"), *[F.col(f"{s}_{code}").alias(s) for s in stages])
        for code in classes
    ]
    by_class = wide.select("year", F.inline(F.array(*rows)))
    keys = ["year", "lien_status"]
    return add_retention(long_stages(by_class, keys, stages), keys)


def coverage(matched: DataFrame) -> DataFrame:
    """Matched records and counties per year and their rates."""
    valid = F.col("valid_loan_type")
    county = F.when((valid > 0) & F.col("county").isNotNull(), F.col("county").cast("long"))
    sums = matched.groupBy("year").agg(
        F.sum(valid).alias("n_pre_fhfa"),
        F.sum(F.when(F.col("in_balanced"), valid).otherwise(0)).alias("n_matched_balanced"),
        F.sum(F.when(F.col("in_year"), valid).otherwise(0)).alias("n_matched_year_specific"),
        F.count_distinct(county).alias("n_counties_pre_fhfa"),
        F.count_distinct(F.when(F.col("in_balanced"), county)).alias("n_counties_matched_balanced"),
        F.count_distinct(F.when(F.col("in_year"), county)).alias("n_counties_matched_year_specific"),
    )
    for suffix in ("balanced", "year_specific"):
        sums = sums.withColumns(
            {
                f"loan_match_rate_{suffix}": F.try_divide(
                    F.col(f"n_matched_{suffix}"), F.col("n_pre_fhfa")
                ),
                f"county_match_rate_{suffix}": F.try_divide(
                    F.col(f"n_counties_matched_{suffix}"), F.col("n_counties_pre_fhfa")
                ),
            }
        )
    return sums


def run_sample_audit(
    records: DataFrame,
    index: DataFrame,
    years: Sequence[int],
    *,
    domain: Domain = DEFAULT,
    unlabelled_before: int | None = None,
) -> dict[str, DataFrame]:
    """The four audit tables; records are read once, into the cube."""
    selected = records.where(F.col("year").isin(*[int(year) for year in years]))
    cube = stage_cube(selected, domain, unlabelled_before)
    matched = match_cube(cube, coverage_keys(index, years)).persist()
    return {
        "stages": stage_counts(matched),
        "classes": class_counts(matched, domain),
        "coverage": coverage(matched),
        "index_levels": index_comparability(index, years),
    }


def county_value_coverage(
    records: DataFrame,
    panel: DataFrame,
    years: Sequence[int],
    *,
    domain: Domain = DEFAULT,
    unlabelled_before: int | None = None,
) -> dict[str, DataFrame]:
    """Match rates against the year-specific value panel, overall and by class."""
    selected = records.where(F.col("year").isin(*[int(year) for year in years]))
    keys = panel.select("fips", "year").distinct().withColumn("is_balanced", F.lit(False))
    matched = match_cube(stage_cube(selected, domain, unlabelled_before), keys).persist()
    valid = F.col("valid_loan_type")
    held = F.when(F.col("in_year"), valid).otherwise(0)
    county = F.when((valid > 0) & F.col("county").isNotNull(), F.col("county").cast("long"))
    overall = matched.groupBy("year").agg(
        F.sum(valid).alias("n_pre_county_value"),
        F.sum(held).alias("n_matched_county_value"),
        F.count_distinct(county).alias("n_counties_pre_county_value"),
        F.count_distinct(F.when(F.col("in_year"), county)).alias(
            "n_counties_matched_county_value"
        ),
    ).withColumns(
        {
            "loan_match_rate_county_value": F.try_divide(
                F.col("n_matched_county_value"), F.col("n_pre_county_value")
            ),
            "county_match_rate_county_value": F.try_divide(
                F.col("n_counties_matched_county_value"), F.col("n_counties_pre_county_value")
            ),
        }
    )
    codes = (domain.negative_class, domain.positive_class)
    by_class = (
        matched.where(F.col("label").isin(*codes))
        .groupBy("year", F.col("label").alias("lien_status"))
        .agg(F.sum(valid).alias("n_pre_county_value"), F.sum(held).alias("n_matched_county_value"))
        .withColumn(
            "loan_match_rate_county_value",
            F.try_divide(F.col("n_matched_county_value"), F.col("n_pre_county_value")),
        )
    )
    return {"overall": overall, "classes": by_class}


def merge_cubes(cubes: Sequence[DataFrame]) -> DataFrame:
    """Combine the cubes of separately read batches or sources."""
    merged = cubes[0]
    for cube in cubes[1:]:
        merged = merged.unionByName(cube)
    keys = ["year", "label", "county"]
    counts = [name for name in merged.columns if name not in keys]
    return merged.groupBy(*keys).agg(*[F.sum(name).alias(name) for name in counts])

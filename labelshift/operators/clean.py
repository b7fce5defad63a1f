"""Sample restriction and derived record features."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..domain import BASE_COLUMNS, DEFAULT, REGION_STATES, STATE_LEVELS, Domain
from ..functions.expressions import mapped
from ..functions.joins import join_bounded
from ..sources.loans import canonical_columns, numeric_columns


def originated() -> Column:
    return (F.col("action_taken") == 1) & (F.col("loan_purp") == 1) & (F.col("occupancy") == 1)


def label_reported(
    frame: DataFrame, domain: Domain = DEFAULT, unlabelled_before: int | None = None
) -> Column:
    """True where the label is present or not expected."""
    if domain.label not in frame.columns:
        return F.lit(True)
    present = F.col(domain.label).isNotNull()
    if unlabelled_before is None:
        return present
    return present | (F.col("year") < unlabelled_before)


def valid_geography(domain: Domain = DEFAULT) -> Column:
    state = F.col("state_code")
    return (
        state.between(1, 56)
        & ~state.isin(*domain.excluded_states)
        & (F.col("county_code") >= 1)
    )


def positive_amounts() -> Column:
    return (F.col("app_income") >= 1) & (F.col("loan_amt") >= 1)


def valid_loan_type() -> Column:
    """Tested on the untruncated value, so 4.5 is out while 1.5 stays."""
    return F.col("loan_type").between(1, 4)


def county_key() -> Column:
    return (F.lit(1000.0) * F.col("state_code") + F.col("county_code")).cast("long")


def log_loan_to_income() -> Column:
    return F.log(F.col("loan_amt") / F.col("app_income"))


def log_value_to_loan() -> Column:
    return F.log(F.col("county_value") / (F.lit(1000.0) * F.col("loan_amt")))


def region_of(state: Column) -> Column:
    return mapped(state, REGION_STATES)


def restrict_sample(
    frame: DataFrame, domain: Domain = DEFAULT, unlabelled_before: int | None = None
) -> DataFrame:
    """All record tests as one predicate on the scan."""
    return frame.where(
        originated()
        & label_reported(frame, domain, unlabelled_before)
        & valid_geography(domain)
        & positive_amounts()
        & valid_loan_type()
    )


def pin_levels(
    frame: DataFrame, variables: Iterable[str] | None = None, domain: Domain = DEFAULT
) -> DataFrame:
    """Null out undeclared category codes; the row stays."""
    names = domain.categories if variables is None else variables
    return frame.withColumns(
        {
            name: F.when(F.col(name).isin(*domain.categories[name]), F.col(name))
            for name in names
            if name in domain.categories
        }
    )


def flag_columns(frame: DataFrame) -> DataFrame:
    return frame.withColumns(
        {
            "has_edit_status": F.col("edit_status").isNotNull(),
            "edit_status": F.coalesce(F.col("edit_status").cast("int"), F.lit(0)),
            "loan_below_10k": F.col("loan_amt") < 10,
        }
    )


def clean_loans(
    raw: DataFrame,
    panel: DataFrame | None = None,
    *,
    domain: Domain = DEFAULT,
    unlabelled_before: int | None = None,
) -> DataFrame:
    """Canonical names, sample restriction, features and flags.

    Without a county panel the restricted feature set is built and no record is
    lost for lack of a county value.
    """
    frame = numeric_columns(canonical_columns(raw))
    carried = [name for name in ("source",) if name in frame.columns]
    kept = [name for name in BASE_COLUMNS if name in frame.columns]
    frame = restrict_sample(frame, domain, unlabelled_before).select(*kept, *carried)
    frame = frame.withColumns(
        {
            "year": F.col("year").cast("int"),
            "loan_type": F.col("loan_type").cast("int"),
            "purchaser_type": F.col("purchaser_type").cast("int"),
            "fips": county_key(),
            "state_code": F.col("state_code").cast("long"),
            "log_lti": log_loan_to_income(),
        }
    )
    if domain.label in frame.columns:
        frame = frame.withColumn(domain.label, F.col(domain.label).cast("int"))
    features = ["log_lti"]
    if panel is not None:
        values = panel.select(
            F.col("fips").cast("long").alias("fips"),
            F.col("year").cast("int").alias("year"),
            "hpi",
            "county_value",
        )
        frame = join_bounded(frame, values, ["fips", "year"])
        frame = frame.withColumn("log_county_value_to_loan", log_value_to_loan())
        features.append("log_county_value_to_loan")
    frame = flag_columns(frame.dropna(subset=features))
    return pin_levels(frame, domain=domain).drop("county_code")


def geographic_support(frame: DataFrame, domain: Domain = DEFAULT) -> DataFrame:
    """State and region counts and shares per year; missing codes are a level."""
    state = F.col(domain.region_column).cast("long")
    counts = frame.groupBy("year", state.alias("state")).agg(F.count(F.lit(1)).alias("n"))
    levels = counts.select(
        "year",
        F.explode(
            F.array(
                F.struct(
                    F.lit("state").alias("geography"),
                    F.col("state").cast("string").alias("level"),
                ),
                F.struct(
                    F.lit("region").alias("geography"),
                    region_of(F.col("state")).alias("level"),
                ),
            )
        ).alias("entry"),
        "n",
    )
    totals = counts.groupBy("year").agg(F.sum("n").alias("n_year"))
    return (
        levels.groupBy("year", "entry.geography", "entry.level")
        .agg(F.sum("n").alias("n"))
        .join(totals, "year")
        .select("year", "geography", "level", "n", (F.col("n") / F.col("n_year")).alias("share"))
    )


def unmapped_states(frame: DataFrame, domain: Domain = DEFAULT) -> DataFrame:
    """State codes without a region, with their row counts."""
    state = F.col(domain.region_column).cast("long")
    known = F.coalesce(state.isin(*STATE_LEVELS), F.lit(False))
    return frame.groupBy(state.alias("state_code"), known.alias("has_region")).agg(
        F.count(F.lit(1)).alias("n")
    )

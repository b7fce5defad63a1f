"""Record-shaped views of the driver tables.

``orders`` joined to ``customer`` plays the partly labelled record table, the
line items give a county index and the order prices a monthly value series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..domain import Domain
from ..functions.expressions import clip_probability, expit, indicator
from ..functions.storage import written
from ..operators.clean import clean_loans, region_of
from ..operators.panel import county_value_panel
from ..plans.folds import Fold, fold_table, forward_fold, join_targets, reverse_folds

# The label is observed in every order year; the earliest year plays the
# unlabelled period where a query needs one.
DOMAIN = Domain(first_labelled_year=1995)
PANEL_YEARS = tuple(range(1995, 2002))
LABEL_SHIFT = -1.7346010553881064

# Literal candidate models: coefficients of fixed expressions, not fits.
CANDIDATES = (
    # specification, C, constant, log_lti, loan_type 2, purchaser, cubic, west
    ("linear__none", 0.01, 0.30, -0.90, 0.00, 0.000, 0.00, 0.00),
    ("linear__none", 1.0, 0.28, -0.95, 0.00, 0.000, 0.00, 0.00),
    ("linear__loan_type", 1.0, 0.25, -0.80, 0.15, 0.000, 0.00, 0.00),
    ("spline_lti__purchaser_type", 0.1, 0.10, -0.70, 0.00, 0.020, 0.05, 0.00),
    ("spline_lti__purchaser_type", 1.0, 0.12, -0.75, 0.00, 0.020, 0.06, 0.00),
    ("linear__none__region", 1.0, 0.30, -0.85, 0.00, 0.000, 0.00, 0.10),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def county_code(customer_key: Column) -> Column:
    return F.when(customer_key % 50 == 0, 0).otherwise(1 + customer_key % 3).cast("int")


def orders_with_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))


def loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    order, price = F.col("o_orderkey"), F.col("o_totalprice")
    chance = F.when(price < 100000, 550).otherwise(60)
    return orders_with_customers(spark, sf_dir).select(
        F.year("o_orderdate").alias("year"),
        F.when(F.col("o_orderstatus") == "P", 2).otherwise(1).alias("action_taken"),
        F.when(order % 10 < 8, 1).otherwise(3).alias("loan_purp"),
        F.when(F.col("o_custkey") % 20 == 0, 2).otherwise(1).alias("occupancy"),
        (1 + order % 3).cast("int").alias("agency_code"),
        (1 + order % 5).cast("int").alias("loan_type"),
        (price / 1000).alias("loan_amt"),
        (F.col("c_acctbal") / 50).alias("app_income"),
        (F.col("o_custkey") % 10).cast("int").alias("purchaser_type"),
        F.when(order % 7 == 0, 5).alias("edit_status"),
        (F.col("c_nationkey") + 1).alias("state_code"),
        county_code(F.col("c_custkey")).alias("county_code"),
        F.when((order * 7919) % 1000 < chance, 2).otherwise(1).alias("lien_status"),
        F.col("o_custkey").alias("resp_id"),
        F.col("o_orderkey").alias("seq_num"),
    )


def text_loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider names, zero-padded codes and missing-value texts."""
    amount = F.round(F.col("loan_amt"), 3).cast("string")
    return loans(spark, sf_dir).select(
        F.col("year").cast("string").alias("as_of_year"),
        F.col("action_taken").cast("string").alias("action_taken"),
        F.col("loan_purp").cast("string").alias("loan_purpose"),
        F.col("occupancy").cast("string").alias("owner_occupancy"),
        F.col("agency_code"),
        F.col("loan_type").cast("string").alias("loan_type"),
        F.when(F.col("seq_num") % 11 == 0, "NA").otherwise(amount).alias("loan_amount_000s"),
        F.when(F.col("app_income") < 1, "").otherwise(
            F.round(F.col("app_income"), 3).cast("string")
        ).alias("applicant_income_000s"),
        F.col("purchaser_type").cast("string").alias("purchaser_type"),
        F.coalesce(F.col("edit_status").cast("string"), F.lit("NULL")).alias("edit_status"),
        F.lpad(F.col("state_code").cast("string"), 2, "0").alias("state_code"),
        F.when(F.col("county_code") == 0, "NA")
        .otherwise(F.lpad(F.col("county_code").cast("string"), 3, "0"))
        .alias("county_code"),
        F.col("lien_status").cast("string").alias("lien_status"),
        F.col("resp_id").alias("respondent_id"),
        F.col("seq_num").alias("sequence_number"),
    )


def second_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records under another provider's names, with a private column."""
    return loans(spark, sf_dir).select(
        F.col("year").alias("activity_year"),
        "action_taken",
        F.col("loan_purp").cast("string").alias("loan_purpose"),
        F.col("occupancy").alias("occupancy_type"),
        F.col("loan_type").cast("long").alias("loan_type"),
        F.col("loan_amt").alias("loan_amount_000s"),
        F.lpad(F.col("state_code").cast("string"), 2, "0").alias("state_code"),
        "county_code",
        "purchaser_type",
        "lien_status",
        (F.col("seq_num") % 4).alias("private_flag"),
    )


def county_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average unit price per county and shipping year, on two bases."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_quantity", "l_extendedprice", F.year("l_shipdate").alias("year")
    )
    places = orders_with_customers(spark, sf_dir).select(
        "o_orderkey",
        (1000 * (F.col("c_nationkey") + 1) + county_code(F.col("c_custkey")))
        .cast("long")
        .alias("fips"),
    )
    index = (
        lines.join(places, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("fips", "year")
        .agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("hpi"))
    )
    index = written(index)  # read several times by a panel; the line items only once
    first = index.groupBy("fips").agg(F.min_by("hpi", "year").alias("first_hpi"))
    return index.join(first, "fips").select(
        "fips", "year", "hpi", F.round(100 * F.col("hpi") / F.col("first_hpi"), 6).alias("hpi_1990_base")
    )


def county_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        orders_with_customers(spark, sf_dir)
        .groupBy(
            (1000 * (F.col("c_nationkey") + 1) + county_code(F.col("c_custkey")))
            .cast("long")
            .alias("fips"),
            F.trunc("o_orderdate", "month").alias("date"),
        )
        .agg(F.avg("o_totalprice").alias("zhvi"))
    )


def value_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return county_value_panel(
        county_index(spark, sf_dir),
        county_monthly(spark, sf_dir),
        PANEL_YEARS,
        anchor_year=1998,
        validate=False,
    )


def restricted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned records of the restricted feature set."""
    return clean_loans(loans(spark, sf_dir), domain=DOMAIN)


def core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned records with the county value."""
    return clean_loans(loans(spark, sf_dir), value_panel(spark, sf_dir), domain=DOMAIN)


def labelled_folds(frame: DataFrame, window: int = 4) -> list[Fold]:
    """Reverse folds over the labelled years the data holds (one small row)."""
    row = (
        frame.where(F.col(DOMAIN.label).isNotNull())
        .agg(F.min("year").alias("first"), F.max("year").alias("last"))
        .first()
    )
    return reverse_folds(row["first"], row["last"], window)


def labelled_forward_folds(frame: DataFrame, window: int = 4) -> list[Fold]:
    """The forward fold from the first labelled years to all later ones (one small row)."""
    row = (
        frame.where(F.col(DOMAIN.label).isNotNull())
        .agg(F.min("year").alias("first"), F.max("year").alias("last"))
        .first()
    )
    cut = row["first"] + window
    return [forward_fold(range(row["first"], cut), range(cut, row["last"] + 1))]


def positive() -> Column:
    return F.col(DOMAIN.label) == DOMAIN.positive_class


def candidate_rows() -> Column:
    """The literal candidates as an array column, one entry per model."""
    names = ("specification", "regularization_c", "_k", "_x", "_t", "_p", "_c", "_w")
    return F.array(
        *[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, c, strict=True)]) for c in CANDIDATES]
    )


def candidate_score() -> Column:
    x = F.col("log_lti")
    held = F.greatest(x, F.lit(0.0))
    west = F.coalesce(region_of(F.col("state_code")) == "west", F.lit(False))
    return (
        F.col("_k")
        + F.col("_x") * x
        + F.col("_t") * indicator(F.col("loan_type") == 2)
        + F.col("_p") * F.col("purchaser_type")
        + F.col("_c") * held * held * held
        + F.col("_w") * indicator(west)
        + F.lit(0.05) * (F.col("train_start") - 1996)
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every target record of every fold under every literal candidate."""
    records = restricted(spark, sf_dir)
    folds = fold_table(spark, labelled_folds(records))
    kept = join_targets(records, folds).select(
        "fold_id",
        "train_start",
        "train_end",
        "validation_year",
        "horizon",
        "lien_status",
        "log_lti",
        "loan_type",
        "purchaser_type",
        "state_code",
        F.inline(candidate_rows()),
    )
    ratio = candidate_score()
    return kept.select(
        "specification",
        "regularization_c",
        "fold_id",
        "train_start",
        "train_end",
        "validation_year",
        "horizon",
        "lien_status",
        "log_lti",
        "loan_type",
        "purchaser_type",
        "state_code",
        ratio.alias("log_ratio"),
        expit(ratio + LABEL_SHIFT).alias("probability"),
    )


def one_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cleaned record once, under one literal candidate, keyed by year."""
    x = F.col("log_lti")
    held = F.greatest(x, F.lit(0.0))
    ratio = (
        F.lit(0.10)
        - F.lit(0.70) * x
        + F.lit(0.02) * F.col("purchaser_type")
        + F.lit(0.05) * held * held * held
    )
    return restricted(spark, sf_dir).withColumns(
        {"log_ratio": ratio, "probability": expit(ratio + LABEL_SHIFT)}
    )


CELL_KEYS = (
    "specification",
    "regularization_c",
    "fold_id",
    "train_start",
    "train_end",
    "validation_year",
    "horizon",
)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation cells of the literal candidates."""
    y, p = indicator(positive()), F.col("probability")
    clipped = clip_probability(p)
    grouped = scored(spark, sf_dir).groupBy(*CELL_KEYS).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((p - y) * (p - y)).alias("brier_score"),
        F.avg(-(y * F.log(clipped) + (1 - y) * F.log1p(-clipped))).alias("log_loss"),
        F.avg(y).alias("actual_second_share"),
        F.avg(p).alias("mean_probability"),
        F.avg(indicator(p >= 0.25)).alias("hard_share"),
        F.avg(F.col("log_ratio")).alias("mean_log_ratio"),
    )
    parts = F.split("specification", "__")
    return grouped.withColumns(
        {
            "continuous_form": F.get(parts, F.lit(0)),
            "interactions": F.get(parts, F.lit(1)),
            "geography": F.coalesce(F.get(parts, F.lit(2)), F.lit("none")),
            "mixture_share_error": F.col("mean_probability") - F.col("actual_second_share"),
        }
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partly labelled table that is not loans: text quality by length."""
    text, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ratio = F.lit(0.4) * (F.log(F.length("text") + 1.0) - 6.0)
    return text.join(labels, "doc_id", "left").select(
        "doc_id",
        "lang",
        "source",
        "quality",
        F.length("text").cast("long").alias("n_characters"),
        ratio.alias("log_ratio"),
        expit(ratio).alias("probability"),
    )

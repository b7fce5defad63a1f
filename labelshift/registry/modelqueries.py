"""Queries of weights, features, estimators, metrics, bins and reports."""

from __future__ import annotations

from dataclasses import replace
from functools import lru_cache

from pyspark.sql import functions as F

from ..domain import Domain
from ..functions.expressions import expit
from ..functions.local import small_table
from ..models import logistic, persistence, trees
from ..operators import aggregate, bins, features, metrics, mixture, quantiles, results, weights
from ..plans.folds import fold_table, join_targets
from ..plans.specifications import (
    BOOSTING_SURVIVORS,
    COARSE_C,
    BoostingParameters,
    FeatureSpec,
    boosting_refinements,
    parse_specification,
    restricted_specifications,
    structure_grid,
)
from ..workflows import reports, selection
from . import inputs
from .book import query, r, workspace
from .inputs import CELL_KEYS, DOMAIN, labelled_folds, positive

NEWTON_STEPS = 12
SHARE_SLOPE = "(exp(log_ratio) - 1) / (1 - s + s * exp(log_ratio))"


def share_parts(source: str, key: str, steps: int = NEWTON_STEPS) -> dict[str, str]:
    """Unrolled Newton steps of the share likelihood, one part per step."""
    parts = {"share0": f"SELECT {key}, 0.5::DOUBLE AS s FROM {source} GROUP BY {key}"}
    for k in range(steps):
        parts[f"share{k + 1}"] = f"""SELECT {key}, least(greatest(any_value(s) + avg(t) / avg(t * t), 1e-9), 1 - 1e-9) AS s
    FROM (SELECT o.{key}, s, {SHARE_SLOPE} AS t FROM {source} o JOIN share{k} p ON o.{key} = p.{key}) g GROUP BY {key}"""
    return parts


SHARE = f"share{NEWTON_STEPS}"
YEAR_SHARE = share_parts("one", "year")
ADJUSTED = f"""SELECT o.*, s AS mixture_share, 1 / (1 + exp(-(log_ratio + ln(s / (1 - s))))) AS q FROM one o
    JOIN {SHARE} p ON o.year = p.year"""


def calibration_parts(source: str, key: str, p: str, steps: int = 12) -> dict[str, str]:
    """Unrolled two-parameter Newton steps of the calibration fit."""
    x = f"ln({p} / (1 - {p}))"
    parts = {
        "fit0": f"""SELECT {key}, ln(avg(CAST(y AS INTEGER)) / (1 - avg(CAST(y AS INTEGER)))) AS a, 0.0::DOUBLE AS b
    FROM {source} GROUP BY {key}"""
    }
    for k in range(steps):
        parts[f"fit{k + 1}"] = f"""SELECT {key}, a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS a,
    b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS b FROM (SELECT {key}, any_value(a) AS a, any_value(b) AS b,
      sum(y - m) AS g0, sum(x * (y - m)) AS g1, sum(m * (1 - m)) AS h00, sum(m * (1 - m) * x) AS h01,
      sum(m * (1 - m) * x * x) AS h11 FROM (SELECT {key}, a, b, x, y, 1 / (1 + exp(-(a + b * x))) AS m
        FROM (SELECT o.{key}, a, b, {x} AS x, CAST(y AS INTEGER) AS y FROM {source} o JOIN fit{k} f
          ON o.{key} = f.{key}) i) j GROUP BY {key}) g"""
    return parts


# -- weights -------------------------------------------------------------------


@query(
    "agg18_equal_prior_weights",
    """SELECT year, lien_status, count(*) AS n, round(count(*) * CASE lien_status WHEN 2 THEN 0.5 / any_value(share)
    ELSE 0.5 / (1 - any_value(share)) END, 6) AS class_weight FROM clean c JOIN (SELECT year AS y,
      avg(CASE WHEN lien_status = 2 THEN 1.0 ELSE 0.0 END) AS share FROM clean GROUP BY year) s ON c.year = s.y
    GROUP BY year, lien_status""",
)
def _(spark, sf):
    weighted = weights.equal_prior_weights(inputs.restricted(spark, sf), domain=DOMAIN)
    return weighted.groupBy("year", "lien_status").agg(
        F.count(F.lit(1)).alias("n"), F.sum("source_weight").alias("class_weight")
    )


@query(
    "win4_year_share_on_records",
    """SELECT seq_num, round(CASE lien_status WHEN 2 THEN 0.5 / share ELSE 0.5 / (1 - share) END, 6) AS source_weight
    FROM (SELECT *, avg(CASE WHEN lien_status = 2 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY year) AS share
      FROM clean) g""",
)
def _(spark, sf):
    weighted = weights.equal_prior_weights(inputs.restricted(spark, sf), domain=DOMAIN)
    return weighted.select("seq_num", "source_weight")


# -- features ------------------------------------------------------------------

FIT = """SELECT fold_id, avg(log_lti) AS mean, stddev_pop(log_lti) AS sd, quantile_cont(log_lti, 0.05) AS k1,
    quantile_cont(log_lti, 0.35) AS k2, quantile_cont(log_lti, 0.65) AS k3, quantile_cont(log_lti, 0.95) AS k4
    FROM clean JOIN sources ON clean.year = sources.year GROUP BY fold_id"""


def basis(first: str) -> str:
    return f"""(power(greatest(log_lti - {first}, 0), 3)
      - (k4 - {first}) / (k4 - k3) * power(greatest(log_lti - k3, 0), 3)
      + (k3 - {first}) / (k4 - k3) * power(greatest(log_lti - k4, 0), 3)) / ((k4 - k1) * (k4 - k1))"""


BASIS = f"""SELECT fold_id, avg(log_lti) AS m1, stddev_pop(log_lti) AS s1, avg(b2) AS m2, stddev_pop(b2) AS s2,
    avg(b3) AS m3, stddev_pop(b3) AS s3 FROM (SELECT f.fold_id, log_lti, {basis('k1')} AS b2, {basis('k2')} AS b3
      FROM clean JOIN sources ON clean.year = sources.year JOIN fit f ON f.fold_id = sources.fold_id) g GROUP BY fold_id"""
FEATURES = {"fit": FIT, "basis_fit": BASIS}
TARGET_ROWS = """SELECT t.fold_id, t.validation_year, c.*, (log_lti - mean) / sd AS z FROM clean c
    JOIN targets t ON c.year = t.validation_year JOIN fit f ON f.fold_id = t.fold_id"""


def expanded(spark, sf, name: str):
    """Target records with the fold-fitted features of a restricted specification."""
    spec = parse_specification(name)
    records = inputs.restricted(spark, sf)
    folds = labelled_folds(records)
    train = logistic.training_rows(records, folds, domain=DOMAIN)
    fitted = features.fit_feature_parameters(train, spec, domain=DOMAIN)
    joined = features.join_parameters(selection.target_rows(records, folds, DOMAIN), fitted)
    columns = features.feature_columns(spec, features.column_parameters(), DOMAIN)
    named = [column.alias(f"f_{name}") for name, column in columns.items()]
    return joined.select("fold_id", "validation_year", "seq_num", *named)


def feature_means(frame, names):
    return frame.groupBy("fold_id", "validation_year").agg(
        *[F.avg(f"f_{name}").alias(name) for name in names]
    )


@query(
    "fea1_standardised",
    "SELECT fold_id, validation_year, seq_num, round(z, 6) AS log_lti FROM target_rows",
    target_rows=TARGET_ROWS,
    **FEATURES,
)
def _(spark, sf):
    frame = expanded(spark, sf, "restricted__linear__none")
    return frame.select("fold_id", "validation_year", "seq_num", F.col("f_log_lti").alias("log_lti"))


@query(
    "fea2_cubic_basis",
    f"""SELECT t.fold_id, t.validation_year, seq_num, round((log_lti - m1) / s1, 6) AS log_lti_rcs_1,
    round(({basis('k1')} - m2) / s2, 6) AS log_lti_rcs_2, round(({basis('k2')} - m3) / s3, 6) AS log_lti_rcs_3
    FROM clean c JOIN targets t ON c.year = t.validation_year JOIN fit f ON f.fold_id = t.fold_id
    JOIN basis_fit b ON b.fold_id = t.fold_id""",
    **FEATURES,
)
def _(spark, sf):
    frame = expanded(spark, sf, "restricted__spline_lti__none")
    names = [f"log_lti_rcs_{i}" for i in (1, 2, 3)]
    return frame.select(
        "fold_id", "validation_year", "seq_num", *[F.col(f"f_{n}").alias(n) for n in names]
    )


@query(
    "bin7_spline_knots",
    "SELECT fold_id, round(k1, 6) AS k1, round(k2, 6) AS k2, round(k3, 6) AS k3, round(k4, 6) AS k4 FROM fit",
    **FEATURES,
)
def _(spark, sf):
    records = inputs.restricted(spark, sf)
    train = logistic.training_rows(records, labelled_folds(records), domain=DOMAIN)
    knots = quantiles.exact_quantiles(
        train, ["fold_id"], "log_lti", features.SPLINE_QUANTILES, "knots"
    )
    return knots.select("fold_id", *[F.get("knots", F.lit(i)).alias(f"k{i + 1}") for i in range(4)])


LEVELS = [("loan_type", level) for level in (2, 3, 4)] + [("purchaser_type", level) for level in range(1, 10)]


@query(
    "fea3_reference_indicators",
    f"""SELECT fold_id, validation_year, {', '.join(f'round(avg(CASE WHEN {n} = {v} THEN 1.0 ELSE 0.0 END), 6) AS {n}_{v}'
      for n, v in LEVELS)} FROM target_rows GROUP BY ALL""",
    target_rows=TARGET_ROWS,
    **FEATURES,
)
def _(spark, sf):
    return feature_means(
        expanded(spark, sf, "restricted__linear__none"), [f"{n}_{v}" for n, v in LEVELS]
    )


@query(
    "fea4_forest_features",
    f"""SELECT year, round(avg(log_lti::FLOAT::DOUBLE), 5) AS log_lti,
    round(avg(log_county_value_to_loan::FLOAT::DOUBLE), 5) AS log_county_value_to_loan,
    {', '.join(f'round(avg(CASE WHEN {n} = {v} THEN 1.0 ELSE 0.0 END), 5) AS {n}_{v}'
      for n, v in [('loan_type', 1), ('purchaser_type', 0), *LEVELS])} FROM core GROUP BY year""",
)
def _(spark, sf):
    columns = features.forest_columns(DOMAIN)
    frame = inputs.core(spark, sf).select("year", *[c.alias(f"f_{n}") for n, c in columns.items()])
    return frame.groupBy("year").agg(*[F.round(F.avg(f"f_{n}"), 5).alias(n) for n in columns])


@query(
    "fea5_boosting_features",
    f"""SELECT seq_num, {r('log_lti', 'log_county_value_to_loan')}, CAST(purchaser_type AS DOUBLE) AS purchaser_type,
    CAST(loan_type - 1 AS DOUBLE) AS loan_type FROM core""",
)
def _(spark, sf):
    columns = features.boosting_columns("core", DOMAIN)
    return inputs.core(spark, sf).select("seq_num", *[c.alias(n) for n, c in columns.items()])


@query(
    "fea6_interactions",
    f"""SELECT fold_id, validation_year, {', '.join(
      f'round(avg(z * CASE WHEN {n} = {v} THEN 1.0 ELSE 0.0 END), 6) AS log_lti_x_{n}_{v}' for n, v in LEVELS)}
    FROM target_rows GROUP BY ALL""",
    target_rows=TARGET_ROWS,
    **FEATURES,
)
def _(spark, sf):
    names = [f"log_lti_x_{n}_{v}" for n, v in LEVELS]
    return feature_means(expanded(spark, sf, "restricted__linear__both"), names)


@query(
    "fea6_spline_interactions",
    f"""SELECT t.fold_id, t.validation_year, {', '.join(
      f'round(avg(({basis("k1")} - m2) / s2 * CASE WHEN purchaser_type = {v} THEN 1.0 ELSE 0.0 END), 6)'
      f' AS log_lti_rcs_2_x_purchaser_type_{v}' for v in range(1, 10))}
    FROM clean c JOIN targets t ON c.year = t.validation_year JOIN fit f ON f.fold_id = t.fold_id
    JOIN basis_fit b ON b.fold_id = t.fold_id GROUP BY ALL""",
    **FEATURES,
)
def _(spark, sf):
    names = [f"log_lti_rcs_2_x_purchaser_type_{v}" for v in range(1, 10)]
    return feature_means(
        expanded(spark, sf, "restricted__spline_lti__purchaser_type_spline_lti"), names
    )


@query(
    "fea7_region_indicators",
    """SELECT fold_id, validation_year, round(avg(CASE WHEN region = 'northeast' THEN 1.0 ELSE 0.0 END), 6) AS region_northeast,
    round(avg(CASE WHEN region = 'midwest' THEN 1.0 ELSE 0.0 END), 6) AS region_midwest,
    round(avg(CASE WHEN region = 'west' THEN 1.0 ELSE 0.0 END), 6) AS region_west
    FROM (SELECT *, CASE WHEN state_code IN (9,23,25) THEN 'northeast' WHEN state_code IN (17,18,19,20) THEN 'midwest'
      WHEN state_code IN (2,4,6,8,15,16) THEN 'west' ELSE 'south' END AS region FROM target_rows) g GROUP BY ALL""",
    target_rows=TARGET_ROWS,
    **FEATURES,
)
def _(spark, sf):
    names = [f"region_{name}" for name in ("northeast", "midwest", "west")]
    return feature_means(expanded(spark, sf, "restricted__linear__none__region"), names)


@query(
    "fea8_year_indicators",
    """SELECT fold_id, sum(CASE WHEN year = train_start + 1 THEN 100.0 ELSE 0 END)::DOUBLE AS year_1,
    sum(CASE WHEN year = train_start + 2 THEN 100.0 ELSE 0 END)::DOUBLE AS year_2,
    sum(CASE WHEN year = train_start + 3 THEN 100.0 ELSE 0 END)::DOUBLE AS year_3 FROM (SELECT s.fold_id, s.train_start, c.year
      FROM clean c JOIN sources s ON c.year = s.year) g GROUP BY fold_id""",
)
def _(spark, sf):
    records = inputs.restricted(spark, sf)
    train = logistic.training_rows(records, labelled_folds(records), domain=DOMAIN)
    block = features.year_indicators(4)
    return train.groupBy("fold_id").agg(*[F.sum(c).alias(n) for n, c in block.items()])


# -- estimators checked by SQL -----------------------------------------------------

LITERAL = logistic.LogisticModel(
    variant="known_source_prior",
    spec=FeatureSpec("linear", "loan_type", feature_set="restricted"),
    regularization_c=1.0,
    fold_id="literal",
    train_years=(1996, 1997),
    parameters={"log_lti__mean": 0.4, "log_lti__sd": 1.2},
    feature_names=(
        "log_lti",
        *[f"purchaser_type_{level}" for level in range(1, 10)],
        *[f"loan_type_{level}" for level in (2, 3, 4)],
        *[f"log_lti_x_loan_type_{level}" for level in (2, 3, 4)],
    ),
    coefficients=(-0.9, *[0.01 * level for level in range(1, 10)], 0.1, -0.1, 0.2, 0.05, 0.0, -0.05),
    intercept=0.15,
)
LITERAL_SQL = """0.15 - 0.9 * z + 0.01 * purchaser_type + CASE loan_type WHEN 2 THEN 0.1 + 0.05 * z
    WHEN 3 THEN -0.1 WHEN 4 THEN 0.2 - 0.05 * z ELSE 0 END"""


@query(
    "est3_class_probability",
    """SELECT year, lien_status, round(avg(probability), 6) AS mean_second, round(avg(1 - probability), 6) AS mean_first
    FROM one GROUP BY ALL""",
)
def _(spark, sf):
    listed = F.array(1 - F.col("probability"), F.col("probability"))
    frame = inputs.one_model(spark, sf)
    return frame.groupBy("year", "lien_status").agg(
        F.avg(trees.class_probability(listed, (1, 2), 2)).alias("mean_second"),
        F.avg(trees.class_probability(listed, (1, 2), 1)).alias("mean_first"),
    )


@query(
    "est7_linear_log_ratio",
    f"SELECT seq_num, round({LITERAL_SQL}, 6) AS log_ratio FROM (SELECT *, (log_lti - 0.4) / 1.2 AS z FROM clean) g",
)
def _(spark, sf):
    return LITERAL.log_ratio(inputs.restricted(spark, sf)).select("seq_num", "log_ratio")


@query(
    "est10_mixture_share",
    f"""SELECT s.year, n, round(s.s, 6) AS mixture_share, s.s <= 1e-8 OR s.s >= 1 - 1e-8 AS mixture_at_boundary
    FROM {SHARE} s JOIN (SELECT year, count(*) AS n FROM one GROUP BY year) c ON s.year = c.year""",
    **YEAR_SHARE,
)
def _(spark, sf):
    shares = mixture.estimate_shares(inputs.one_model(spark, sf), ["year"])
    return shares.select("year", "n", "mixture_share", "mixture_at_boundary")


EM_PARTS = {"em0": "SELECT year, 0.5::DOUBLE AS s FROM one GROUP BY year"} | {
    f"em{k + 1}": f"""SELECT o.year, avg(1 / (1 + exp(-(log_ratio + ln(s / (1 - s)))))) AS s FROM one o
    JOIN em{k} p ON o.year = p.year GROUP BY o.year"""
    for k in range(10)
}


@query("est11_posterior_averaging_steps", "SELECT year, round(s, 6) AS em_share FROM em10", **EM_PARTS)
def _(spark, sf):
    """The first ten updates one by one; the converged shares are below."""
    frame = inputs.one_model(spark, sf)
    steps = mixture.estimate_shares_em(frame, ["year"], tolerance=0.0, max_iterations=10)
    return steps.select("year", "em_share")


@query(
    "est11_posterior_averaging",
    f"SELECT year, round(s, 5) AS em_share, true AS em_converged FROM {SHARE}",
    **YEAR_SHARE,
)
def _(spark, sf):
    """Posterior averaging run to convergence meets the likelihood optimum."""
    shares = mixture.estimate_shares_em(inputs.one_model(spark, sf), ["year"], tolerance=1e-9, accelerate=True)
    return shares.select("year", F.round("em_share", 5).alias("em_share"), "em_converged")


@query(
    "est12_adjusted_probability",
    """SELECT year, round(avg(1 / (1 + exp(-(log_ratio + ln(0.18 / 0.82))))), 6) AS mean_probability,
    round(avg(ln(0.82 + 0.18 * exp(log_ratio))), 6) AS mean_log_likelihood FROM one GROUP BY year""",
)
def _(spark, sf):
    value, share = F.col("log_ratio"), F.lit(0.18)
    return inputs.one_model(spark, sf).groupBy("year").agg(
        F.avg(mixture.adjusted_probability(value, share)).alias("mean_probability"),
        F.avg(mixture.mixture_log_likelihood(value, share)).alias("mean_log_likelihood"),
    )


@query(
    "est13_log_mean_exp",
    "SELECT year, loan_type, round(ln(avg(exp(log_ratio * 20))), 6) AS value FROM one GROUP BY ALL",
)
def _(spark, sf):
    frame = inputs.one_model(spark, sf).withColumn("scaled", F.col("log_ratio") * 20)
    return mixture.log_mean_exp(frame, ["year", "loan_type"], "scaled", "value")


@query(
    "est14_calibration",
    "SELECT year, round(a, 6) AS calibration_intercept, round(b, 6) AS calibration_slope FROM fit12",
    **calibration_parts("one", "year", "probability"),
)
def _(spark, sf):
    return metrics.calibration_coefficients(inputs.one_model(spark, sf), ["year"], positive())


@query(
    "est16_ratio_means",
    """SELECT year, round(avg(CASE WHEN NOT y THEN exp(log_ratio) END), 6) AS mean_ratio_first,
    round(avg(CASE WHEN y THEN exp(-log_ratio) END), 6) AS mean_inverse_ratio_second FROM one GROUP BY year""",
)
def _(spark, sf):
    return mixture.ratio_normalisation(
        inputs.one_model(spark, sf), ["year"], "log_ratio", positive()
    )


UNLABELLED_DOCS = "SELECT lang, log_ratio FROM docs WHERE quality IS NULL"


@query(
    "est17_unlabelled_adjustment",
    f"""SELECT o.lang, count(*) AS n, round(any_value(s), 6) AS mixture_share,
    round(avg(1 / (1 + exp(-(log_ratio + ln(s / (1 - s)))))), 6) AS mean_probability
    FROM unlabelled o JOIN {SHARE} p ON o.lang = p.lang GROUP BY o.lang""",
    unlabelled=UNLABELLED_DOCS,
    **share_parts("unlabelled", "lang"),
)
def _(spark, sf):
    texts = inputs.documents(spark, sf).where("quality IS NULL").drop("probability")
    return mixture.adjust_cells(texts, ["lang"]).groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"),
        F.first("mixture_share").alias("mixture_share"),
        F.avg("probability").alias("mean_probability"),
    )


# -- cell metrics --------------------------------------------------------------------

SCORES = """count(*) AS n, round(avg(power(p - CAST(y AS INTEGER), 2)), 6) AS brier_score,
    round(avg(CASE WHEN y THEN -ln(p) ELSE -ln(1 - p) END), 6) AS log_loss,
    round(avg(CAST(y AS INTEGER)), 6) AS observed_second_share, round(avg(p), 6) AS mean_predicted_second_share,
    round(avg(p) - avg(CAST(y AS INTEGER)), 6) AS calibration_mean_error"""


@query(
    "evl1_proper_scores",
    f"SELECT specification, regularization_c, train_start, validation_year, {SCORES} FROM "
    "(SELECT *, probability AS p FROM scored) g GROUP BY specification, regularization_c, train_start, validation_year",
)
def _(spark, sf):
    keys = ["specification", "regularization_c", "train_start", "validation_year"]
    return metrics.proper_scores(inputs.scored(spark, sf), keys, positive())


@query(
    "evl1_document_scores",
    f"SELECT lang, {SCORES} FROM (SELECT *, probability AS p FROM docs WHERE quality IS NOT NULL) g GROUP BY lang",
)
def _(spark, sf):
    texts = inputs.documents(spark, sf).where("quality IS NOT NULL")
    return metrics.proper_scores(texts, ["lang"], F.col("quality") == 1)


def confusion_sql(p: str, threshold: float) -> str:
    return f"""count(*) AS n, count(*) FILTER (y AND {p} >= {threshold}) AS true_positive,
    count(*) FILTER (NOT y AND {p} >= {threshold}) AS false_positive,
    count(*) FILTER (y AND {p} < {threshold}) AS false_negative,
    count(*) FILTER (NOT y AND {p} < {threshold}) AS true_negative,
    avg(CAST(y AS INTEGER)) AS observed_second_share, avg({p}) AS mean_probability,
    avg(CASE WHEN {p} >= {threshold} THEN 1.0 ELSE 0.0 END) AS hard_second_share,
    avg(power({p} - CAST(y AS INTEGER), 2)) AS brier_score"""


def ratios_sql(keys: str, table: str, threshold: float, extra: str = "") -> str:
    precision = "CASE WHEN true_positive + false_positive = 0 THEN 0.0 ELSE true_positive / (true_positive + false_positive)::DOUBLE END"
    recall = "CASE WHEN true_positive + false_negative = 0 THEN 0.0 ELSE true_positive / (true_positive + false_negative)::DOUBLE END"
    return f"""SELECT {keys}, n, true_positive, false_positive, false_negative, true_negative, observed_second_share,
    mean_probability, hard_second_share, brier_score, {threshold}::DOUBLE AS threshold,
    CASE WHEN n = 0 THEN 0.0 ELSE (true_positive + true_negative) / n::DOUBLE END AS accuracy,
    pr AS precision_second, rc AS recall_second, CASE WHEN pr + rc = 0 THEN 0.0 ELSE 2 * pr * rc / (pr + rc) END AS f1_second
    {extra} FROM (SELECT *, {precision} AS pr, {recall} AS rc FROM {table}) g"""


RATIO_NAMES = (
    "observed_second_share", "mean_probability", "hard_second_share", "brier_score", "threshold", "accuracy",
    "precision_second", "recall_second", "f1_second",
)
COUNT_NAMES = "n, true_positive, false_positive, false_negative, true_negative"
ESTIMATOR_ROWS = """SELECT CASE specification WHEN 'linear__none' THEN 'raw_logistic' ELSE 'known_source_prior_mixture' END
    AS estimator, * FROM scored WHERE regularization_c = 1 AND specification IN ('linear__none', 'linear__loan_type')"""
ESTIMATOR_KEYS = "estimator, fold_id, train_start, train_end, validation_year, horizon"
ESTIMATOR_LIST = ESTIMATOR_KEYS.split(", ")
CONFUSION = f"SELECT {ESTIMATOR_KEYS}, {confusion_sql('probability', 0.25)} FROM estimator_rows GROUP BY {ESTIMATOR_KEYS}"
AP = f"""SELECT {ESTIMATOR_KEYS}, sum(k * hits / seen::DOUBLE) / sum(k) AS average_precision FROM (
    SELECT *, sum(k) OVER w AS hits, sum(m) OVER w AS seen FROM (SELECT {ESTIMATOR_KEYS}, probability,
      count(*) AS m, count(*) FILTER (y) AS k FROM estimator_rows GROUP BY {ESTIMATOR_KEYS}, probability) i
    WINDOW w AS (PARTITION BY {ESTIMATOR_KEYS} ORDER BY probability DESC ROWS UNBOUNDED PRECEDING)) j
    GROUP BY {ESTIMATOR_KEYS}"""
THRESHOLD_CELLS = ratios_sql(ESTIMATOR_KEYS, "confusion", 0.25)
THRESHOLD_PARTS = {
    "estimator_rows": ESTIMATOR_ROWS,
    "confusion": CONFUSION,
    "threshold_cells": THRESHOLD_CELLS,
    "average_precisions": AP,
}


def estimator_rows(spark, sf):
    name = F.when(F.col("specification") == "linear__none", "raw_logistic").otherwise(
        "known_source_prior_mixture"
    )
    return (
        inputs.scored(spark, sf)
        .where(
            (F.col("regularization_c") == 1)
            & F.col("specification").isin("linear__none", "linear__loan_type")
        )
        .withColumn("estimator", name)
    )


def threshold_cells(spark, sf, include_average_precision=True):
    return metrics.threshold_metrics(
        estimator_rows(spark, sf),
        ESTIMATOR_LIST,
        positive(),
        threshold=0.25,
        include_average_precision=include_average_precision,
    )


@query(
    "evl2_threshold_metrics",
    f"SELECT {ESTIMATOR_KEYS}, {COUNT_NAMES}, {r(*RATIO_NAMES)} FROM threshold_cells",
    **THRESHOLD_PARTS,
)
def _(spark, sf):
    return threshold_cells(spark, sf, include_average_precision=False)


@query(
    "evl3_average_precision",
    f"SELECT {ESTIMATOR_KEYS}, {r('average_precision')} FROM average_precisions",
    **THRESHOLD_PARTS,
)
def _(spark, sf):
    ranked = metrics.rank_metrics(estimator_rows(spark, sf), ESTIMATOR_LIST, positive())
    return ranked.drop("roc_auc")


GRID = ", ".join(f"({value!r}::DOUBLE)" for value in metrics.threshold_grid())
CURVE = f"""SELECT {ESTIMATOR_KEYS}, threshold, count(*) FILTER (y AND probability >= threshold) AS true_positive,
    count(*) FILTER (NOT y AND probability >= threshold) AS false_positive,
    count(*) FILTER (y AND probability < threshold) AS false_negative
    FROM estimator_rows CROSS JOIN grid GROUP BY {ESTIMATOR_KEYS}, threshold"""
CURVE_PARTS = {"estimator_rows": ESTIMATOR_ROWS, "grid": f"SELECT * FROM (VALUES {GRID}) v(threshold)", "curve": CURVE}
CURVE_RATIOS = """round(CASE WHEN true_positive + false_positive = 0 THEN 1.0
      ELSE true_positive / (true_positive + false_positive)::DOUBLE END, 6) AS precision,
    round(CASE WHEN true_positive + false_negative > 0 THEN true_positive / (true_positive + false_negative)::DOUBLE END, 6)
      AS recall"""


@query(
    "evl4_precision_recall_counts",
    f"""SELECT {ESTIMATOR_KEYS}, round(threshold, 6) AS threshold, true_positive, false_positive, false_negative,
    {CURVE_RATIOS} FROM curve""",
    **CURVE_PARTS,
)
def _(spark, sf):
    return metrics.precision_recall_counts(estimator_rows(spark, sf), ESTIMATOR_LIST, positive())


@query(
    "win2_reverse_cumulative_counts",
    f"""SELECT loan_type, round(threshold, 6) AS threshold, true_positive, false_positive, false_negative, {CURVE_RATIOS}
    FROM (SELECT loan_type, threshold, count(*) FILTER (y AND probability >= threshold) AS true_positive,
      count(*) FILTER (NOT y AND probability >= threshold) AS false_positive,
      count(*) FILTER (y AND probability < threshold) AS false_negative FROM one CROSS JOIN grid GROUP BY ALL) g""",
    grid=CURVE_PARTS["grid"],
)
def _(spark, sf):
    return metrics.precision_recall_counts(inputs.one_model(spark, sf), ["loan_type"], positive())


@query(
    "bin6_threshold_grid",
    "SELECT round(threshold, 6) AS threshold, count(*) FILTER (probability >= threshold) AS n_called"
    " FROM docs CROSS JOIN grid WHERE quality IS NOT NULL GROUP BY threshold",
    grid=CURVE_PARTS["grid"],
)
def _(spark, sf):
    texts = inputs.documents(spark, sf).where("quality IS NOT NULL").withColumn("all", F.lit(1))
    curve = metrics.precision_recall_counts(texts, ["all"], F.col("quality") == 1)
    return curve.select(
        "threshold", (F.col("true_positive") + F.col("false_positive")).alias("n_called")
    )


@query(
    "evl5_mixture_cells",
    f"""SELECT a.year, n, round(actual, 6) AS actual_second_share, round(share, 6) AS mixture_share,
    round(mean_q, 6) AS mean_probability, round(hard, 6) AS hard_share_050, round(brier, 6) AS brier_score,
    round(loss, 6) AS log_loss, round(mean_q - actual, 6) AS calibration_mean_error,
    round(a, 6) AS calibration_intercept, round(b, 6) AS calibration_slope, share <= 1e-8 AS mixture_at_boundary
    FROM (SELECT year, count(*) AS n, avg(CAST(y AS INTEGER)) AS actual, any_value(mixture_share) AS share,
      avg(q) AS mean_q, avg(CASE WHEN q >= 0.5 THEN 1.0 ELSE 0.0 END) AS hard,
      avg(power(q - CAST(y AS INTEGER), 2)) AS brier, avg(CASE WHEN y THEN -ln(q) ELSE -ln(1 - q) END) AS loss
      FROM adjusted GROUP BY year) a JOIN fit12 f ON a.year = f.year""",
    adjusted=ADJUSTED,
    **YEAR_SHARE,
    **calibration_parts("adjusted", "year", "q"),
)
def _(spark, sf):
    frame = inputs.one_model(spark, sf)
    cells = metrics.evaluate_log_ratios(frame, ["year"], positive())
    return cells.select(
        "year",
        F.col("n_observations").alias("n"),
        "actual_second_share",
        "mixture_share",
        "mean_probability",
        "hard_share_050",
        "brier_score",
        "log_loss",
        "calibration_mean_error",
        "calibration_intercept",
        "calibration_slope",
        "mixture_at_boundary",
    )


# -- bins and subgroups ------------------------------------------------------------------


def cut_parts(source: str, keys: str, value: str, name: str) -> dict[str, str]:
    levels = ", ".join(repr(level) for level in quantiles.decile_probabilities(10))
    joined = " AND ".join(f"o.{k} = c.{k}" for k in keys.split(", "))
    return {
        f"{name}_cuts": f"""SELECT DISTINCT {keys}, cut FROM (SELECT {keys}, unnest(quantile_cont({value}, [{levels}])) AS cut
      FROM {source} GROUP BY {keys}) g""",
        f"{name}_rows": f"""SELECT o.*, (SELECT count(*) FROM {name}_cuts c WHERE {joined} AND c.cut <= o.{value}) AS bin
      FROM {source} o""",
    }


BINS = f"""SELECT {ESTIMATOR_KEYS}, CAST(bin + 1 AS INTEGER) AS probability_bin, count(*) AS n, min(probability) AS min_probability,
    max(probability) AS max_probability, avg(probability) AS mean_predicted_probability,
    avg(CAST(y AS INTEGER)) AS observed_second_share FROM p_rows GROUP BY {ESTIMATOR_KEYS}, bin"""
BIN_PARTS = {
    "estimator_rows": ESTIMATOR_ROWS,
    **cut_parts("estimator_rows", ESTIMATOR_KEYS, "probability", "p"),
    "bins": BINS,
}
BIN_NAMES = ("min_probability", "max_probability", "mean_predicted_probability", "observed_second_share")


@query(
    "bin1_reliability_bins",
    f"SELECT {ESTIMATOR_KEYS}, probability_bin, n, {r(*BIN_NAMES)} FROM bins",
    **BIN_PARTS,
)
def _(spark, sf):
    return bins.reliability_bins(estimator_rows(spark, sf), ESTIMATOR_LIST, positive())


@query(
    "agg30_pooled_reliability",
    """SELECT horizon, probability_bin, sum(n)::BIGINT AS n, round(min(min_probability), 6) AS min_probability,
    round(max(max_probability), 6) AS max_probability, count(DISTINCT validation_year) AS n_cells,
    round(sum(mean_predicted_probability * n) / sum(n), 6) AS mean_predicted_probability,
    round(sum(observed_second_share * n) / sum(n), 6) AS observed_second_share FROM bins GROUP BY 1, 2""",
    **BIN_PARTS,
)
def _(spark, sf):
    table = bins.reliability_bins(estimator_rows(spark, sf), ESTIMATOR_LIST, positive())
    return aggregate.pooled_reliability(table, ["horizon"])


ONE_ROWS = "SELECT year, log_lti, probability, y, loan_type, purchaser_type, state_code FROM one"
DECILES = f"""SELECT year, 'log_lti_target_decile' AS subgroup_dimension, (bin + 1)::VARCHAR AS subgroup_value,
    {confusion_sql('probability', 0.25)} FROM d_rows GROUP BY year, bin"""
DECILE_PARTS = {"one_rows": ONE_ROWS, **cut_parts("one_rows", "year", "log_lti", "d"), "deciles": DECILES}
GROUPS = f"""SELECT year, subgroup_dimension, subgroup_value, {confusion_sql('probability', 0.25)} FROM (
    SELECT year, probability, y, 'loan_type' AS subgroup_dimension, loan_type::VARCHAR AS subgroup_value FROM one
    UNION ALL SELECT year, probability, y, 'purchaser_type', purchaser_type::VARCHAR FROM one
    UNION ALL SELECT year, probability, y, 'region', CASE WHEN state_code IN (9,23,25) THEN 'northeast'
      WHEN state_code IN (17,18,19,20) THEN 'midwest' WHEN state_code IN (2,4,6,8,15,16) THEN 'west' ELSE 'south' END
    FROM one) g GROUP BY ALL"""
GROUP_KEYS = "year, subgroup_dimension, subgroup_value"


@query(
    "bin2_target_deciles",
    f"SELECT {GROUP_KEYS}, {COUNT_NAMES}, {r(*RATIO_NAMES)} FROM ({ratios_sql(GROUP_KEYS, 'deciles', 0.25)}) t",
    **DECILE_PARTS,
)
def _(spark, sf):
    groups = bins.subgroup_metrics(
        inputs.one_model(spark, sf), ["year"], positive(), threshold=0.25, domain=DOMAIN
    )
    return groups.where("subgroup_dimension = 'log_lti_target_decile'")


@query(
    "bin3_categorical_subgroups",
    f"SELECT {GROUP_KEYS}, {COUNT_NAMES}, {r(*RATIO_NAMES)} FROM ({ratios_sql(GROUP_KEYS, 'groups', 0.25)}) t",
    groups=GROUPS,
)
def _(spark, sf):
    return bins.categorical_subgroups(
        inputs.one_model(spark, sf), ["year"], positive(), threshold=0.25, domain=DOMAIN
    )


@query(
    "bin4_all_subgroups",
    f"""SELECT {GROUP_KEYS}, {COUNT_NAMES}, {r(*RATIO_NAMES)} FROM ({ratios_sql(GROUP_KEYS, 'groups', 0.25)}
    UNION ALL {ratios_sql(GROUP_KEYS, 'deciles', 0.25)}) t""",
    groups=GROUPS,
    **DECILE_PARTS,
)
def _(spark, sf):
    return bins.subgroup_metrics(
        inputs.one_model(spark, sf), ["year"], positive(), threshold=0.25, domain=DOMAIN
    )


TAILS = ", ".join(
    f"round(quantile_cont(log_ratio, {level}), 6) AS log_ratio_{label}" for label, level in bins.TAIL_LEVELS.items()
)


@query(
    "bin5_ratio_tails",
    f"""SELECT train_start, validation_year, {TAILS},
    round(avg(CASE WHEN log_ratio > 10 THEN 1.0 ELSE 0.0 END), 6) AS share_log_ratio_gt_10,
    round(avg(CASE WHEN log_ratio < -10 THEN 1.0 ELSE 0.0 END), 6) AS share_log_ratio_lt_minus_10
    FROM scored GROUP BY train_start, validation_year""",
)
def _(spark, sf):
    return bins.tail_metrics(inputs.scored(spark, sf), ["train_start", "validation_year"])


@query(
    "evl7_diagnostic_cells",
    f"""SELECT m.*, n_bins, {', '.join(f'log_ratio_{label}' for label in bins.TAIL_LEVELS)} FROM
    (SELECT {ESTIMATOR_KEYS}, {SCORES} FROM (SELECT *, probability AS p FROM estimator_rows) g GROUP BY {ESTIMATOR_KEYS}) m
    JOIN (SELECT {ESTIMATOR_KEYS}, {TAILS} FROM estimator_rows GROUP BY {ESTIMATOR_KEYS}) t
      USING ({ESTIMATOR_KEYS}) JOIN (SELECT {ESTIMATOR_KEYS}, count(*) AS n_bins FROM bins GROUP BY {ESTIMATOR_KEYS}) b
      USING ({ESTIMATOR_KEYS})""",
    **BIN_PARTS,
)
def _(spark, sf):
    tables = reports.diagnostic_cells(
        estimator_rows(spark, sf).persist(),
        ESTIMATOR_LIST,
        positive(),
        log_ratio="log_ratio",
        calibrated=False,
    )
    counted = tables["bins"].groupBy(*ESTIMATOR_LIST).agg(F.count(F.lit(1)).alias("n_bins"))
    tails = tables["ratio_tails"].drop("share_log_ratio_gt_10", "share_log_ratio_lt_minus_10")
    return reports.merge_records(ESTIMATOR_LIST, [tables["metrics"], tails, counted])


THRESHOLD_NAMES = aggregate.THRESHOLD_METRICS


@query(
    "agg27_threshold_summary",
    f"""SELECT estimator, {', '.join(f'round(avg({n}), 6) AS {n}' for n in THRESHOLD_NAMES)},
    count(DISTINCT horizon) AS n_horizons, sum(n_cells)::BIGINT AS n_cells FROM (SELECT t.estimator, t.horizon,
      {', '.join(f'avg({n}) AS {n}' for n in THRESHOLD_NAMES)}, count(*) AS n_cells
      FROM threshold_cells t JOIN average_precisions a ON t.estimator = a.estimator AND t.fold_id = a.fold_id
        AND t.validation_year = a.validation_year GROUP BY 1, 2) g GROUP BY estimator""",
    **THRESHOLD_PARTS,
)
def _(spark, sf):
    return aggregate.threshold_summary(threshold_cells(spark, sf), validate=False)[1]


@query(
    "agg28_pooled_precision_recall",
    f"""SELECT estimator, horizon, round(threshold, 6) AS threshold, true_positive, false_positive, false_negative,
    n_cells, {CURVE_RATIOS} FROM (SELECT estimator, horizon, threshold, sum(true_positive)::BIGINT AS true_positive,
      sum(false_positive)::BIGINT AS false_positive, sum(false_negative)::BIGINT AS false_negative,
      count(DISTINCT validation_year) AS n_cells FROM curve GROUP BY 1, 2, 3) g""",
    **CURVE_PARTS,
)
def _(spark, sf):
    curves = metrics.precision_recall_counts(
        estimator_rows(spark, sf), ESTIMATOR_LIST, positive()
    )
    return aggregate.pooled_precision_recall(curves)


SUBGROUP_NAMES = aggregate.SUBGROUP_METRICS
ESTIMATOR_GROUP = f"""SELECT {ESTIMATOR_KEYS}, 'loan_type' AS subgroup_dimension, loan_type::VARCHAR AS subgroup_value,
    {confusion_sql('probability', 0.25)} FROM estimator_rows GROUP BY {ESTIMATOR_KEYS}, loan_type"""


@query(
    "agg29_subgroup_summary",
    f"""SELECT estimator, subgroup_dimension, subgroup_value,
    {', '.join(f'round(avg({n}), 6) AS {n}' for n in SUBGROUP_NAMES)}, count(DISTINCT horizon) AS n_horizons,
    min(min_n) AS min_cell_n FROM (SELECT estimator, subgroup_dimension, subgroup_value, horizon,
      {', '.join(f'avg({n}) AS {n}' for n in SUBGROUP_NAMES)}, min(n) AS min_n FROM group_cells GROUP BY 1, 2, 3, 4) g
    GROUP BY 1, 2, 3""",
    estimator_rows=ESTIMATOR_ROWS,
    estimator_groups=ESTIMATOR_GROUP,
    group_cells=ratios_sql(f"{ESTIMATOR_KEYS}, subgroup_dimension, subgroup_value", "estimator_groups", 0.25),
)
def _(spark, sf):
    frame = estimator_rows(spark, sf).drop("purchaser_type", "state_code")
    groups = bins.categorical_subgroups(
        frame, ESTIMATOR_LIST, positive(), threshold=0.25, domain=DOMAIN
    )
    return aggregate.subgroup_summary(groups)[1]


ANNUAL = """SELECT year, count(*) AS n_model_sample, avg(probability) AS raw_mean_probability,
    avg(CASE WHEN probability >= 0.5 THEN 1.0 ELSE 0.0 END) AS raw_hard_share_050,
    any_value(mixture_share) AS mixture_share, avg(q) AS mixture_mean_probability,
    avg(CASE WHEN q >= 0.5 THEN 1.0 ELSE 0.0 END) AS mixture_hard_share_050,
    avg(q) - any_value(mixture_share) AS mixture_mean_minus_share,
    CASE WHEN year >= 1996 THEN avg(CAST(y AS INTEGER)) END AS actual_second_share FROM adjusted GROUP BY year"""
ANNUAL_PARTS = {"adjusted": ADJUSTED, "annual_shares": ANNUAL, **YEAR_SHARE}
ANNUAL_NAMES = (
    "raw_mean_probability", "raw_hard_share_050", "mixture_share", "mixture_mean_probability",
    "mixture_hard_share_050", "mixture_mean_minus_share", "actual_second_share",
)


def annual(spark, sf):
    label = F.when(F.col("year") >= 1996, F.col("lien_status"))
    frame = inputs.one_model(spark, sf).withColumn("lien_status", label)
    adjusted = mixture.adjust_cells(frame.withColumnRenamed("probability", "raw_probability"), ["year"])
    return aggregate.annual_shares(adjusted, positive())


@query(
    "agg31_annual_shares",
    f"SELECT year, n_model_sample, {r(*ANNUAL_NAMES)} FROM annual_shares",
    **ANNUAL_PARTS,
)
def _(spark, sf):
    return annual(spark, sf)


@query(
    "agg32_boundary_continuity",
    " UNION ALL ".join(
        f"""SELECT '{name}' AS estimator, round(max(CASE WHEN year = 1995 THEN {name} END), 6) AS predicted_1995,
    round(max(CASE WHEN year = 1996 THEN {name} END), 6) AS predicted_1996,
    round(max(CASE WHEN year = 1996 THEN {name} END) - max(CASE WHEN year = 1995 THEN {name} END), 6) AS predicted_1996_minus_1995,
    round(max(CASE WHEN year = 1996 THEN actual_second_share END), 6) AS actual_1996,
    round(max(CASE WHEN year = 1996 THEN {name} - actual_second_share END), 6) AS predicted_1996_minus_actual,
    round(max(CASE WHEN year = 1995 THEN {name} END) - max(CASE WHEN year = 1996 THEN actual_second_share END), 6)
      AS predicted_1995_minus_actual_1996 FROM annual_shares"""
        for name in aggregate.ANNUAL_ESTIMATORS
    ),
    **ANNUAL_PARTS,
)
def _(spark, sf):
    return aggregate.boundary_continuity(annual(spark, sf), 1995, 1996)


PAIRED = """SELECT a.validation_year, a.train_start, a.y, a.probability AS pa, b.probability AS pb FROM
    (SELECT * FROM keyed WHERE specification = 'linear__none' AND regularization_c = 1) a JOIN
    (SELECT * FROM keyed WHERE specification = 'linear__loan_type') b
    ON a.train_start = b.train_start AND a.validation_year = b.validation_year AND a.seq_num = b.seq_num"""


@query(
    "rpt8_paired_comparison",
    """SELECT year, count(*) AS n, count(*) FILTER ((pa >= 0.25) = y AND (pb >= 0.25) <> y) AS n_only_left,
    count(*) FILTER ((pa >= 0.25) <> y AND (pb >= 0.25) = y) AS n_only_right,
    count(*) FILTER ((pa >= 0.25) = y) - count(*) FILTER ((pb >= 0.25) = y) AS net_left,
    round((sum(CASE WHEN y THEN ra END) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0)
      / (count(*) FILTER (y) * count(*) FILTER (NOT y)), 6) AS roc_auc
    FROM (SELECT *, rank() OVER (PARTITION BY year ORDER BY pa) + (count(*) OVER (PARTITION BY year, pa) - 1) / 2.0 AS ra
      FROM pairs) g GROUP BY year""",
    pairs="""SELECT year, y, 1 / (1 + exp(-(0.28 - 0.95 * log_lti - 1.7346010553881064))) AS pa,
    probability AS pb FROM one""",
)
def _(spark, sf):
    first = F.lit(0.28) - F.lit(0.95) * F.col("log_lti") + F.lit(inputs.LABEL_SHIFT)
    frame = inputs.one_model(spark, sf).withColumn("other", expit(first))
    paired = metrics.paired_comparison(frame, ["year"], positive(), "other", "probability", 0.25)
    ranked = metrics.rank_metrics(frame, ["year"], positive(), "other").select("year", "roc_auc")
    return paired.join(ranked, "year")


@query(
    "rpt7_release_crosswalk",
    """SELECT year, resp_id, seq_num, round(probability, 6) AS prob_second_lien,
    CASE WHEN probability >= 0.5 THEN 2 ELSE 1 END AS lien_status_predicted_050, 'literal_1' AS model_version FROM one""",
)
def _(spark, sf):
    path = f"{workspace(spark)}/crosswalk"
    reports.write_crosswalk(
        reports.release_crosswalk(inputs.one_model(spark, sf), "literal_1", DOMAIN), path
    )
    return spark.read.parquet(path)


# -- fitted models: rows and invariants only ----------------------------------------------

LINEAR = parse_specification("restricted__linear__none")
SPLINE = parse_specification("restricted__spline_lti__purchaser_type")


def training(spark, sf):
    records = inputs.restricted(spark, sf).persist()
    return records, labelled_folds(records)


# One standardised input and no categories: a fit of two parameters, which SQL
# can follow step by step. The fits below it use all features.
PLAIN = Domain(first_labelled_year=1995, categories={})
RIDGE_STEPS = 12
PENALTIES = (0.0001, 0.01, 1.0, 100.0)


def ridge_parts(values: tuple[float, ...], weighted: bool = False) -> dict[str, str]:
    """Unrolled ridge-logistic Newton steps of every fold and penalty."""
    listed = ", ".join(f"({value!r}::DOUBLE)" for value in values)
    weight = "CASE WHEN y THEN 0.5 / share ELSE 0.5 / (1 - share) END" if weighted else "1.0::DOUBLE"
    parts = {
        "fit": FIT,
        "year_share": """SELECT year, avg(CASE WHEN lien_status = 2 THEN 1.0 ELSE 0.0 END) AS share FROM clean
    GROUP BY year""",
        "train_z": f"""SELECT fold_id, z, y, {weight} AS w FROM (SELECT s.fold_id, (log_lti - mean) / sd AS z,
      lien_status = 2 AS y, share FROM clean c JOIN sources s ON c.year = s.year JOIN fit f ON f.fold_id = s.fold_id
      JOIN year_share q ON q.year = c.year) g""",
        "ridge0": f"SELECT fold_id, c, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM folds CROSS JOIN (VALUES {listed}) v(c)",
    }
    for k in range(RIDGE_STEPS):
        parts[f"ridge{k + 1}"] = f"""SELECT fold_id, c, a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS a,
    b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS b FROM (SELECT fold_id, c, any_value(a) AS a, any_value(b) AS b,
      sum(w * (y - m)) AS g0, sum(w * z * (y - m)) - any_value(b) / c AS g1, sum(w * m * (1 - m)) AS h00,
      sum(w * m * (1 - m) * z) AS h01, sum(w * m * (1 - m) * z * z) + 1 / c AS h11
      FROM (SELECT t.fold_id, c, a, b, z, w, CAST(y AS INTEGER) AS y, 1 / (1 + exp(-(a + b * z))) AS m
        FROM train_z t JOIN ridge{k} r ON t.fold_id = r.fold_id) i GROUP BY fold_id, c) j"""
    return parts


RIDGE = f"ridge{RIDGE_STEPS}"


def plain_table(spark, models):
    rows = [
        (m.fold_id, m.regularization_c, m.intercept, m.coefficients[0], m.converged, m.n_training)
        for m in models
    ]
    return small_table(
        spark,
        rows,
        "fold_id string, regularization_c double, intercept double, slope double,"
        " converged boolean, n_training long",
    )


@query(
    "est1_ridge_path",
    f"""SELECT r.fold_id, c AS regularization_c, round(a, 6) + 0.0 AS intercept, round(b, 6) + 0.0 AS slope, TRUE AS converged,
    n_training FROM {RIDGE} r JOIN (SELECT fold_id, count(*) AS n_training FROM train_z GROUP BY fold_id) n
    ON r.fold_id = n.fold_id""",
    **ridge_parts(PENALTIES),
)
def _(spark, sf):
    records, folds = training(spark, sf)
    return plain_table(spark, logistic.fit_grid(records, folds, LINEAR, PENALTIES, domain=PLAIN))


@query(
    "est2_selected_model",
    f"""SELECT year, lien_status, count(*) AS n, round(avg(1 / (1 + exp(-(a + b * (log_lti - mean) / sd)))), 6) AS mean_probability
    FROM clean CROSS JOIN (SELECT r.a, r.b, f.mean, f.sd FROM {RIDGE} r JOIN fit f ON r.fold_id = f.fold_id
      JOIN folds d ON d.fold_id = r.fold_id WHERE d.train_start = 1998) m GROUP BY 1, 2""",
    **ridge_parts((0.1,)),
)
def _(spark, sf):
    records, _ = training(spark, sf)
    fitted = logistic.fit_model(records, LINEAR, 0.1, (1998, 1999, 2000, 2001), domain=PLAIN)
    probability = expit(fitted.linear_predictor())
    return records.groupBy("year", "lien_status").agg(
        F.count(F.lit(1)).alias("n"), F.avg(probability).alias("mean_probability")
    )


RATIO_MEANS = """round(avg(CASE WHEN NOT y THEN exp(offset_a + b * z) END), 6) AS mean_ratio_first,
    round(avg(CASE WHEN y THEN exp(-(offset_a + b * z)) END), 6) AS mean_inverse_ratio_second"""


def ratio_table(spark, models):
    rows = [
        (m.fold_id, m.intercept, m.coefficients[0], m.mean_ratio_first, m.mean_inverse_ratio_second)
        for m in models
    ]
    return small_table(
        spark,
        rows,
        "fold_id string, log_ratio_offset double, slope double, mean_ratio_first double,"
        " mean_inverse_ratio_second double",
    )


@query(
    "est4_known_source_prior",
    f"""SELECT fold_id, round(any_value(offset_a), 6) + 0.0 AS log_ratio_offset, round(any_value(b), 6) + 0.0 AS slope,
    {RATIO_MEANS} FROM (SELECT t.*, r.a AS offset_a, r.b FROM train_z t JOIN {RIDGE} r ON t.fold_id = r.fold_id) g
    GROUP BY fold_id""",
    **ridge_parts((0.1,), weighted=True),
)
def _(spark, sf):
    records, folds = training(spark, sf)
    return ratio_table(
        spark,
        logistic.fit_grid(
            records, folds, LINEAR, (0.1,), variant="known_source_prior", domain=PLAIN
        ),
    )


@query(
    "est5_pooled_ratio",
    f"""SELECT fold_id, round(any_value(offset_a), 6) + 0.0 AS log_ratio_offset, round(any_value(b), 6) + 0.0 AS slope,
    {RATIO_MEANS} FROM (SELECT t.*, b, -ln(avg(CASE WHEN NOT y THEN exp(b * z) END) OVER (PARTITION BY t.fold_id)) AS offset_a
      FROM train_z t JOIN {RIDGE} r ON t.fold_id = r.fold_id) g GROUP BY fold_id""",
    **ridge_parts((0.1,)),
)
def _(spark, sf):
    records, folds = training(spark, sf)
    return ratio_table(
        spark,
        logistic.fit_grid(records, folds, LINEAR, (0.1,), variant="pooled", domain=PLAIN),
    )


@query(
    "sel1_candidate_cells",
    f"""SELECT t.fold_id, r.c AS regularization_c, t.validation_year, t.horizon, count(*) AS n_validation,
    round(avg(power(p - CAST(y AS INTEGER), 2)), 6) AS brier_score, round(avg(CAST(y AS INTEGER)), 6) AS observed_second_share,
    round(avg(p), 6) AS mean_predicted_second_share FROM (SELECT t.fold_id, t.validation_year, t.horizon, r.c,
      lien_status = 2 AS y, 1 / (1 + exp(-(a + b * (log_lti - mean) / sd))) AS p FROM clean c
      JOIN targets t ON c.year = t.validation_year JOIN fit f ON f.fold_id = t.fold_id
      JOIN {RIDGE} r ON r.fold_id = t.fold_id) t JOIN (SELECT DISTINCT c FROM {RIDGE}) r ON r.c = t.c GROUP BY ALL""",
    **ridge_parts((0.01, 1.0)),
)
def _(spark, sf):
    records, folds = training(spark, sf)
    first = selection.evaluate_raw_grid(records, folds[-1:], {LINEAR: (0.01, 1.0)}, domain=PLAIN)
    cells = selection.evaluate_raw_grid(records, folds, {LINEAR: (0.01, 1.0)}, first, PLAIN)
    return cells.select(
        "fold_id",
        "regularization_c",
        "validation_year",
        "horizon",
        "n_validation",
        "brier_score",
        "observed_second_share",
        "mean_predicted_second_share",
    )


OPTIMA = """SELECT s.fold_id, p.c AS regularization_c, count(*) AS n_training,
    count(*) FILTER (lien_status = 2) AS n_second, 0.0::DOUBLE AS largest_gradient, TRUE AS converged
    FROM clean c JOIN sources s ON c.year = s.year CROSS JOIN (VALUES {values}) p(c) GROUP BY 1, 2"""


def optima(*values: float) -> str:
    return OPTIMA.format(values=", ".join(f"({value!r}::DOUBLE)" for value in values))


def optimum_table(spark, records, folds, models, equal_prior=False):
    """Certificates: the penalised gradient of each fit at its coefficients, from the records.

    Training records are counted and the gradient of every feature, the intercept and the year
    effects is summed anew, by feature columns and not by level moments; all must be zero.
    """
    spec, names = models[0].spec, models[0].feature_names
    window = max(len(m.year_effects) for m in models)
    table = small_table(
        spark,
        [
            (m.fold_id, m.regularization_c, m.converged, m.raw_intercept, list(m.coefficients), [0.0, *m.year_effects])
            for m in models
        ],
        "fold_id string, regularization_c double, converged boolean, _a double, _b array<double>, _e array<double>",
    )
    train = logistic.training_rows(records, folds, equal_prior=equal_prior, domain=DOMAIN)
    rows = features.join_parameters(train, {m.fold_id: m.parameters for m in models}).join(F.broadcast(table), "fold_id")
    columns = features.feature_columns(spec, features.column_parameters(), DOMAIN)
    effect = F.coalesce(F.get("_e", F.col("year_position")), F.lit(0.0))
    z = F.col("_a") + effect
    for i, name in enumerate(names):
        z = z + F.get("_b", F.lit(i)) * columns[name]
    second = positive()
    residual = F.col("source_weight") * (second.cast("double") - 1 / (1 + F.exp(-z)))
    c, scale = F.col("regularization_c"), features.YEAR_EFFECT_SCALE
    gradients = [F.sum(residual)]
    gradients += [F.sum(residual * columns[name]) - F.first(F.get("_b", F.lit(i)) / c) for i, name in enumerate(names)]
    gradients += [
        F.sum(F.when(F.col("year_position") == k, residual * scale).otherwise(0.0)) - F.first(F.get("_e", F.lit(k)) / scale / c)
        for k in range(1, window + 1)
    ]
    return rows.groupBy("fold_id", "regularization_c", "converged").agg(
        F.count(F.lit(1)).alias("n_training"),
        F.count_if(second).alias("n_second"),
        F.array_max(F.array(*[F.abs(g) for g in gradients])).alias("largest_gradient"),
    )


@query("est1_ridge_path_optima", optima(*PENALTIES))
def _(spark, sf):
    records, folds = training(spark, sf)
    models = logistic.fit_grid(records, folds, SPLINE, PENALTIES, domain=DOMAIN)
    return optimum_table(spark, records, folds, models)


@query("est4_known_source_prior_optima", optima(0.1))
def _(spark, sf):
    records, folds = training(spark, sf)
    models = logistic.fit_grid(records, folds, SPLINE, (0.1,), variant="known_source_prior", domain=DOMAIN)
    return optimum_table(spark, records, folds, models, equal_prior=True)


@query("est6_year_effect_optima", optima(0.1))
def _(spark, sf):
    records, folds = training(spark, sf)
    models = logistic.fit_grid(records, folds, SPLINE, (0.1,), variant="year_fixed_effect", domain=DOMAIN)
    return optimum_table(spark, records, folds, models)


@query("sel4_geographic_optima", optima(0.1))
def _(spark, sf):
    records, folds = training(spark, sf)
    region = parse_specification("restricted__spline_lti__purchaser_type__region")
    return optimum_table(spark, records, folds, logistic.fit_grid(records, folds, region, (0.1,), domain=DOMAIN))


@query("sel5_spline_interaction_optima", optima(0.1))
def _(spark, sf):
    records, folds = training(spark, sf)
    spec = parse_specification("restricted__spline_lti__purchaser_type_spline_lti")
    return optimum_table(spark, records, folds, logistic.fit_grid(records, folds, spec, (0.1,), domain=DOMAIN))


@query(
    "agg33_source_year_shares",
    """SELECT s.fold_id, c.year AS source_year, count(*) AS n_source,
    round(avg(CASE WHEN lien_status = 2 THEN 1.0 ELSE 0.0 END), 6) AS observed_second_share,
    round(ln(avg(CASE WHEN lien_status = 2 THEN 1.0 ELSE 0.0 END) / (1 - avg(CASE WHEN lien_status = 2 THEN 1.0 ELSE 0.0 END))), 6)
      AS observed_logit_share, TRUE AS gap_adds_up FROM clean c JOIN sources s ON c.year = s.year GROUP BY 1, 2""",
)
def _(spark, sf):
    records, folds = training(spark, sf)
    models = logistic.fit_grid(records, folds, LINEAR, (1.0,), variant="year_fixed_effect", domain=DOMAIN)
    gap = F.col("fitted_year_intercept") - F.col("observed_logit_share") - F.col("log_ratio_offset")
    return reports.year_intercepts(records, models, DOMAIN).select(
        "fold_id",
        "source_year",
        "n_source",
        "observed_second_share",
        "observed_logit_share",
        (F.abs(gap - F.col("normalization_gap")) < 1e-9).alias("gap_adds_up"),
    )


@query(
    "est15_coefficients_by_window",
    f"""SELECT d.train_start, v.feature, round(CASE v.feature WHEN 'intercept' THEN r.a ELSE r.b END, 6) + 0.0 AS coefficient
    FROM {RIDGE} r JOIN folds d ON d.fold_id = r.fold_id CROSS JOIN (VALUES ('intercept'), ('slope')) v(feature)""",
    **ridge_parts((0.1,)),
)
def _(spark, sf):
    records, folds = training(spark, sf)
    table = selection.coefficient_stability(records, folds, {LINEAR: 0.1}, PLAIN)
    feature = F.when(F.col("feature") == "intercept", "intercept").otherwise("slope")
    return table.select("train_start", feature.alias("feature"), "coefficient")


@query(
    "snk7_stored_model_scores",
    """SELECT year, count(*) AS n, 0.0::DOUBLE AS largest_difference, 'known_source_prior' AS variant, TRUE AS same_identity
    FROM clean GROUP BY year""",
)
def _(spark, sf):
    """A model read back scores every record as the fitted one does."""
    records, _ = training(spark, sf)
    years = (1998, 1999, 2000, 2001)
    fitted = logistic.fit_model(records, SPLINE, 0.1, years, variant="known_source_prior", domain=DOMAIN)
    counts = weights.training_counts(records.where(F.col("year").isin(*years)), (), DOMAIN).first()
    path = f"{workspace(spark)}/model"
    persistence.save_logistic(spark, fitted, path, (counts.n_training, counts.n_first, counts.n_second))
    restored = persistence.load_logistic(spark, path, fitted.model_id)
    difference = F.abs(fitted.linear_predictor() - restored.linear_predictor())
    return records.groupBy("year").agg(
        F.count(F.lit(1)).alias("n"), F.max(difference).alias("largest_difference"),
        F.lit(restored.variant).alias("variant"),
        F.lit(restored.model_id == fitted.model_id and restored.converged == fitted.converged).alias("same_identity"),
    )


@query("est1_ridge_path_full")
def _(spark, sf):
    records, folds = training(spark, sf)
    return logistic.fit_table(spark, logistic.fit_grid(records, folds, SPLINE, PENALTIES, domain=DOMAIN))


@query("est4_known_source_prior_full")
def _(spark, sf):
    records, folds = training(spark, sf)
    models = logistic.fit_grid(
        records, folds, SPLINE, (0.1,), variant="known_source_prior", domain=DOMAIN
    )
    return logistic.fit_table(spark, models)


@query("est6_year_effect_ratio")
def _(spark, sf):
    records, folds = training(spark, sf)
    models = logistic.fit_grid(
        records, folds, LINEAR, (0.1,), variant="year_fixed_effect", domain=DOMAIN
    )
    return logistic.fit_table(spark, models)


@query("agg33_source_year_intercepts")
def _(spark, sf):
    records, folds = training(spark, sf)
    models = logistic.fit_grid(
        records, folds, LINEAR, (1.0,), variant="year_fixed_effect", domain=DOMAIN
    )
    return reports.year_intercepts(records, models, DOMAIN)


@query("est15_coefficient_stability")
def _(spark, sf):
    records, folds = training(spark, sf)
    region = parse_specification("restricted__linear__none__region")
    return selection.coefficient_stability(records, folds, {region: 0.1}, DOMAIN)


STUMP_CUTS = tuple(round(-1.5 + 0.25 * step, 2) for step in range(16))
STUMP = BoostingParameters(2, 1.0, 1, 1.0, 20)


def stump_parts(l2: float) -> dict[str, str]:
    """All splits of one tree with two leaves: cuts of the input, and level sets ordered by their value."""
    listed = ", ".join(f"({cut!r}::DOUBLE)" for cut in STUMP_CUTS)
    level = """SELECT '{c}' AS feature, {place} AS rank, v, row_number() OVER (ORDER BY g / (h + {l2} + 0.001), v) AS place,
      n, g, h FROM (SELECT {c} AS v, count(*) AS n, sum(g) AS g, sum(h) AS h FROM stump_rows GROUP BY 1) q"""
    levels = " UNION ALL ".join(level.format(c=c, l2=l2, place=i) for i, c in enumerate(DOMAIN.categories, 1))
    return {
        "stump_shares": """SELECT year, avg(CASE WHEN lien_status = 2 THEN 1.0 ELSE 0.0 END) AS share FROM clean
      GROUP BY year""",
        "stump_weights": """SELECT c.*, CASE WHEN lien_status = 2 THEN 0.5 / share ELSE 0.5 / (1 - share) END AS w,
      CASE WHEN lien_status = 2 THEN 1.0 ELSE 0.0 END AS y FROM clean c JOIN stump_shares s ON s.year = c.year
      WHERE c.year BETWEEN 1998 AND 2001""",
        "stump_base": "SELECT sum(w * y) / sum(w) AS p FROM stump_weights",
        "stump_rows": "SELECT *, w * (p - y) AS g, w * p * (1 - p) AS h FROM stump_weights CROSS JOIN stump_base",
        "stump_totals": "SELECT count(*) AS n, sum(g) AS g, sum(h) AS h FROM stump_rows",
        "stump_levels": levels,
        "stump_splits": f"""SELECT 0 AS rank, 'log_lti' AS feature, cut, NULL::BIGINT AS place, count(*) AS n, sum(g) AS g,
        sum(h) AS h FROM stump_rows JOIN (VALUES {listed}) v(cut) ON log_lti <= cut GROUP BY cut
      UNION ALL SELECT a.rank, a.feature, NULL, a.place, sum(b.n), sum(b.g), sum(b.h)
        FROM stump_levels a JOIN stump_levels b ON a.feature = b.feature AND b.place <= a.place
        GROUP BY a.rank, a.feature, a.place""",
        "stump_best": f"""SELECT s.*, t.g - s.g AS rg, t.h - s.h AS rh FROM stump_splits s CROSS JOIN stump_totals t
      WHERE s.n >= 20 AND t.n - s.n >= 20
      ORDER BY s.g * s.g / (s.h + {l2}) + (t.g - s.g) * (t.g - s.g) / (t.h - s.h + {l2}) DESC, rank, cut, s.place LIMIT 1""",
    }


def stump_scores(l2: float) -> str:
    own = " ".join(f"WHEN '{c}' THEN c.{c}" for c in DOMAIN.categories)
    return f"""SELECT c.year, c.lien_status, count(*) AS n, round(avg(ln(p / (1 - p)) +
      CASE WHEN CASE WHEN b.feature = 'log_lti' THEN c.log_lti <= b.cut ELSE l.place <= b.place END
           THEN -b.g / (b.h + {l2}) ELSE -b.rg / (b.rh + {l2}) END), 6) + 0.0 AS mean_log_ratio
    FROM clean c CROSS JOIN stump_best b CROSS JOIN stump_base
      LEFT JOIN stump_levels l ON l.feature = b.feature AND l.v = CASE b.feature {own} END
    GROUP BY 1, 2"""


def mean_ratios(fitted, records):
    return fitted.log_ratio(records).groupBy("year", "lien_status").agg(
        F.count(F.lit(1)).alias("n"), F.avg("log_ratio").alias("mean_log_ratio")
    )


def stump(l2):
    def run(spark, sf):
        records, _ = training(spark, sf)
        parameters = replace(STUMP, l2_regularization=l2)
        fitted = trees.fit_boosting(
            records, parameters, (1998, 1999, 2000, 2001), feature_set="restricted", domain=DOMAIN, cuts=[STUMP_CUTS]
        )
        return mean_ratios(fitted, records)

    return run


for _l2, _name in ((0.0, "est8_one_split"), (100.0, "est8_one_split_penalty")):
    query(_name, stump_scores(_l2), **stump_parts(_l2))(stump(_l2))


@query("est8_boosting_ratio")
def _(spark, sf):
    records, _ = training(spark, sf)
    parameters = replace(structure_grid()[1], min_samples_leaf=20)
    fitted = trees.fit_boosting(
        records, parameters, (1998, 1999, 2000, 2001), feature_set="restricted", domain=DOMAIN
    )
    return mean_ratios(fitted, records)


@query("est9_forest_ratio")
def _(spark, sf):
    records = inputs.core(spark, sf).persist()
    return mean_ratios(trees.fit_forest(records, (1998, 1999, 2000, 2001), domain=DOMAIN), records)


@query("snk7_stored_model")
def _(spark, sf):
    records, _ = training(spark, sf)
    years = (1998, 1999, 2000, 2001)
    fitted = logistic.fit_model(
        records, SPLINE, 0.1, years, variant="known_source_prior", domain=DOMAIN
    )
    counts = weights.training_counts(records.where(F.col("year").isin(*years)), (), DOMAIN).first()
    path = f"{workspace(spark)}/model"
    persistence.save_logistic(
        spark, fitted, path, (counts.n_training, counts.n_first, counts.n_second)
    )
    restored = persistence.load_logistic(spark, path, fitted.model_id)
    return logistic.coefficient_table(spark, [restored])


@query("evl6_ratio_variants")
def _(spark, sf):
    records, folds = training(spark, sf)
    return reports.run_mixture_validation(records, folds, LINEAR, 0.1, DOMAIN)["cells"]


@query("rpt1_mixture_validation")
def _(spark, sf):
    records, folds = training(spark, sf)
    return reports.run_mixture_validation(records, folds, SPLINE, 0.1, DOMAIN)["summary"]


@query("rpt2_calibration_report")
def _(spark, sf):
    records, folds = training(spark, sf)
    scored = reports.scored_estimators(records, folds, SPLINE, 0.1, DOMAIN)
    return reports.run_calibration_report(scored, domain=DOMAIN)["horizons"]


@query("rpt3_mixture_calibration")
def _(spark, sf):
    records, folds = training(spark, sf)
    scored = reports.scored_estimators(records, folds, SPLINE, 0.1, DOMAIN)
    tables = reports.run_calibration_report(scored, probability="probability", domain=DOMAIN)
    return tables["ratio_tails"]


@query("rpt4_threshold_report")
def _(spark, sf):
    records, folds = training(spark, sf)
    scored = reports.scored_estimators(records, folds, SPLINE, 0.1, DOMAIN)
    return reports.run_threshold_report(scored, domain=DOMAIN)["threshold_summary"]


def forward_scored(spark, sf):
    records, _ = training(spark, sf)
    return reports.scored_estimators(records, inputs.labelled_forward_folds(records), SPLINE, 0.1, DOMAIN)


@query("rpt2_forward_calibration")
def _(spark, sf):
    return reports.run_calibration_report(forward_scored(spark, sf), domain=DOMAIN)["forward_summary"]


@query("rpt3_forward_calibration")
def _(spark, sf):
    scored = forward_scored(spark, sf)
    return reports.run_calibration_report(scored, probability="probability", domain=DOMAIN)["forward_summary"]


@query("rpt4_forward_thresholds")
def _(spark, sf):
    return reports.run_threshold_report(forward_scored(spark, sf), domain=DOMAIN)["threshold_summary"]


@query("rpt5_historical_application")
def _(spark, sf):
    domain = Domain(first_labelled_year=1996)
    records = inputs.restricted(spark, sf)
    label = F.when(F.col("year") >= 1996, F.col("lien_status"))
    records = records.withColumn("lien_status", label).persist()
    years = tuple(range(1995, 2002))
    application = reports.run_historical_application(
        records, SPLINE, 0.1, (1996, 1997, 1998, 1999), years, before=1995, after=1996, domain=domain
    )
    return application["annual"]


APPLIED = f"""SELECT c.year, c.lien_status = 2 AS y, 1 / (1 + exp(-(r.a + r.b * (log_lti - mean) / sd))) AS probability,
    k.a + k.b * (log_lti - mean) / sd AS log_ratio FROM clean c CROSS JOIN (SELECT f.* FROM fit f JOIN folds d
      ON d.fold_id = f.fold_id WHERE d.train_start = 1996) f JOIN {RIDGE} r ON r.fold_id = f.fold_id
    JOIN known{RIDGE_STEPS} k ON k.fold_id = f.fold_id"""
KNOWN_PARTS = {
    name.replace("ridge", "known").replace("train_z", "known_z"): text.replace(" ridge", " known")
    .replace("train_z", "known_z")
    for name, text in ridge_parts((0.1,), weighted=True).items()
    if name.startswith(("ridge", "train_z"))
}


@query(
    "rpt5_application_series",
    f"""SELECT year, count(*) AS n_model_sample, round(avg(probability), 6) AS raw_mean_probability,
    round(avg(CASE WHEN probability >= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS raw_hard_share_050,
    round(any_value(s), 6) AS mixture_share, round(avg(q), 6) AS mixture_mean_probability,
    round(avg(CASE WHEN q >= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS mixture_hard_share_050,
    round(CASE WHEN year >= 1996 THEN avg(CAST(y AS INTEGER)) END, 6) AS actual_second_share
    FROM (SELECT o.year, o.y, o.probability, p.s, 1 / (1 + exp(-(log_ratio + ln(p.s / (1 - p.s))))) AS q
      FROM applied o JOIN {SHARE} p ON o.year = p.year) g GROUP BY year""",
    applied=APPLIED,
    **ridge_parts((0.1,)),
    **KNOWN_PARTS,
    **share_parts("applied", "year"),
)
def _(spark, sf):
    domain = Domain(first_labelled_year=1996, categories={})
    label = F.when(F.col("year") >= 1996, F.col("lien_status"))
    records = inputs.restricted(spark, sf).withColumn("lien_status", label).persist()
    application = reports.run_historical_application(
        records,
        LINEAR,
        0.1,
        (1996, 1997, 1998, 1999),
        tuple(range(1995, 2002)),
        before=1995,
        after=1996,
        domain=domain,
    )
    return application["annual"].drop("mixture_mean_minus_share")


VALIDATED = f"""SELECT t.fold_id || '|' || t.validation_year AS cell, t.fold_id, t.train_start, t.train_end,
    t.validation_year, t.horizon, lien_status = 2 AS y, 1 / (1 + exp(-(r.a + r.b * (log_lti - mean) / sd))) AS probability,
    k.a + k.b * (log_lti - mean) / sd AS log_ratio FROM clean c JOIN targets t ON c.year = t.validation_year
    JOIN fit f ON f.fold_id = t.fold_id JOIN {RIDGE} r ON r.fold_id = t.fold_id
    JOIN known{RIDGE_STEPS} k ON k.fold_id = t.fold_id"""
CELL_FIELDS = "fold_id, train_start, train_end, validation_year, horizon"
VALIDATED_PARTS = {"validated": VALIDATED, **ridge_parts((0.1,)), **KNOWN_PARTS}


@query(
    "rpt1_validated_shares",
    f"""SELECT {CELL_FIELDS}, count(*) AS n_validation, round(avg(CAST(y AS INTEGER)), 6) AS actual_second_share,
    round(avg(probability), 6) AS raw_mean_probability,
    round(avg(CASE WHEN probability >= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS raw_hard_share,
    round(any_value(s), 6) AS mixture_share_known_source_prior,
    round(avg(power(q - CAST(y AS INTEGER), 2)), 6) AS adjusted_brier_known_source_prior,
    any_value(s) <= 1e-8 OR any_value(s) >= 1 - 1e-8 AS at_boundary_known_source_prior
    FROM (SELECT o.*, p.s, 1 / (1 + exp(-(log_ratio + ln(p.s / (1 - p.s))))) AS q FROM validated o
      JOIN {SHARE} p ON o.cell = p.cell) g GROUP BY {CELL_FIELDS}""",
    **VALIDATED_PARTS,
    **share_parts("validated", "cell"),
)
def _(spark, sf):
    records, folds = training(spark, sf)
    cells = reports.run_mixture_validation(records, folds, LINEAR, 0.1, PLAIN)["cells"]
    return cells.select(
        *CELL_FIELDS.split(", "),
        "n_validation",
        "actual_second_share",
        "raw_mean_probability",
        "raw_hard_share",
        "mixture_share_known_source_prior",
        "adjusted_brier_known_source_prior",
        "at_boundary_known_source_prior",
    )


@query(
    "rpt2_calibration_cells",
    f"""SELECT g.fold_id, g.train_start, g.train_end, g.validation_year, g.horizon, n, brier_score, log_loss,
    observed_second_share, mean_predicted_second_share, calibration_mean_error, round(a, 6) + 0.0 AS calibration_intercept,
    round(b, 6) + 0.0 AS calibration_slope FROM (SELECT cell, {CELL_FIELDS}, {SCORES} FROM (SELECT *, probability AS p
      FROM validated) v GROUP BY cell, {CELL_FIELDS}) g JOIN fit12 f ON g.cell = f.cell""",
    **VALIDATED_PARTS,
    **calibration_parts("validated", "cell", "probability"),
)
def _(spark, sf):
    records, folds = training(spark, sf)
    scored = reports.scored_estimators(records, folds, LINEAR, 0.1, PLAIN)
    return reports.run_calibration_report(scored, domain=PLAIN)["metrics"]


@query(
    "evl6_pooled_variant",
    f"""SELECT {CELL_FIELDS}, count(*) AS n_validation, round(any_value(s), 6) AS mixture_share_pooled,
    round(avg(power(q - CAST(y AS INTEGER), 2)), 6) AS adjusted_brier_pooled
    FROM (SELECT o.*, p.s, 1 / (1 + exp(-(log_ratio + ln(p.s / (1 - p.s))))) AS q FROM pooled o
      JOIN {SHARE} p ON o.cell = p.cell) g GROUP BY {CELL_FIELDS}""",
    pooled=f"""SELECT v.cell, {', '.join(f'v.{name}' for name in CELL_FIELDS.split(', '))}, v.y, n.mean_offset + v.slope AS log_ratio
      FROM (SELECT t.fold_id || '|' || t.validation_year AS cell, t.*, lien_status = 2 AS y, r.b * (log_lti - mean) / sd AS slope
        FROM clean c JOIN targets t ON c.year = t.validation_year JOIN fit f ON f.fold_id = t.fold_id
        JOIN {RIDGE} r ON r.fold_id = t.fold_id) v
      JOIN (SELECT t.fold_id, -ln(avg(exp(b * z))) AS mean_offset FROM train_z t JOIN {RIDGE} r ON t.fold_id = r.fold_id
        WHERE NOT y GROUP BY t.fold_id) n ON n.fold_id = v.fold_id""",
    **ridge_parts((0.1,)),
    **share_parts("pooled", "cell"),
)
def _(spark, sf):
    records, folds = training(spark, sf)
    cells = reports.run_mixture_validation(records, folds, LINEAR, 0.1, PLAIN)["cells"]
    return cells.select(*CELL_FIELDS.split(", "), "n_validation", "mixture_share_pooled", "adjusted_brier_pooled")


@query(
    "rpt3_ratio_tail_cells",
    f"""SELECT {CELL_FIELDS}, {TAILS},
    round(avg(CASE WHEN log_ratio > 10 THEN 1.0 ELSE 0.0 END), 6) AS share_log_ratio_gt_10,
    round(avg(CASE WHEN log_ratio < -10 THEN 1.0 ELSE 0.0 END), 6) AS share_log_ratio_lt_minus_10
    FROM validated GROUP BY {CELL_FIELDS}""",
    **VALIDATED_PARTS,
)
def _(spark, sf):
    records, folds = training(spark, sf)
    scored = reports.scored_estimators(records, folds, LINEAR, 0.1, PLAIN)
    return reports.run_calibration_report(scored, probability="probability", domain=PLAIN)["ratio_tails"]


@query(
    "rpt3_adjusted_cells",
    f"""SELECT {CELL_FIELDS}, {SCORES} FROM (SELECT o.*, 1 / (1 + exp(-(log_ratio + ln(p.s / (1 - p.s))))) AS p
      FROM validated o JOIN {SHARE} p ON o.cell = p.cell) g GROUP BY {CELL_FIELDS}""",
    **VALIDATED_PARTS,
    **share_parts("validated", "cell"),
)
def _(spark, sf):
    records, folds = training(spark, sf)
    scored = reports.scored_estimators(records, folds, LINEAR, 0.1, PLAIN)
    tables = reports.run_calibration_report(scored, probability="probability", domain=PLAIN)
    return tables["metrics"].drop("calibration_intercept", "calibration_slope")


REPORT_ROWS = f"""SELECT 'raw_logistic' AS estimator, {CELL_FIELDS}, y, probability FROM validated
    UNION ALL SELECT 'known_source_prior_mixture', {', '.join(f'o.{name}' for name in CELL_FIELDS.split(', '))}, o.y,
      1 / (1 + exp(-(log_ratio + ln(p.s / (1 - p.s))))) FROM validated o JOIN {SHARE} p ON o.cell = p.cell"""


@query(
    "rpt4_threshold_cells",
    f"""SELECT {', '.join(f't.{name}' for name in ESTIMATOR_LIST)}, {COUNT_NAMES}, {r(*RATIO_NAMES)},
    round(average_precision, 6) AS average_precision FROM threshold_cells t JOIN average_precisions a
      ON t.estimator = a.estimator AND t.fold_id = a.fold_id AND t.validation_year = a.validation_year""",
    estimator_rows=REPORT_ROWS,
    confusion=f"""SELECT {ESTIMATOR_KEYS}, {confusion_sql('probability', 0.5)} FROM estimator_rows
      GROUP BY {ESTIMATOR_KEYS}""",
    threshold_cells=ratios_sql(ESTIMATOR_KEYS, "confusion", 0.5),
    average_precisions=AP,
    **VALIDATED_PARTS,
    **share_parts("validated", "cell"),
)
def _(spark, sf):
    records, folds = training(spark, sf)
    scored = reports.scored_estimators(records, folds, LINEAR, 0.1, PLAIN)
    return reports.run_threshold_report(scored, domain=PLAIN)["threshold_cells"]


SEARCHED = (0.001, 0.01, 0.1, 1.0, 10.0)


@query(
    "sel3_coarse_and_refined",
    """SELECT c AS regularization_c, round(avg(b), 6) AS selection_brier, count(*) AS n_horizons, sum(k)::BIGINT AS n_cells
    FROM searched WHERE c IN (0.01, 1.0) OR abs(c - 0.1 * (SELECT best FROM chosen)) < 1e-9
      OR abs(c - 10 * (SELECT best FROM chosen)) < 1e-9 GROUP BY c""",
    searched=f"""SELECT c, horizon, avg(brier) AS b, count(*) AS k FROM (SELECT t.fold_id, t.validation_year, t.horizon, r.c,
      avg(power(1 / (1 + exp(-(a + b * (log_lti - mean) / sd))) - CASE WHEN lien_status = 2 THEN 1 ELSE 0 END, 2)) AS brier
      FROM clean c JOIN targets t ON c.year = t.validation_year JOIN fit f ON f.fold_id = t.fold_id
      JOIN ridge12 r ON r.fold_id = t.fold_id GROUP BY ALL) g GROUP BY c, horizon""",
    chosen="""SELECT arg_min(c, score) AS best FROM (SELECT c, avg(b) AS score FROM searched WHERE c IN (0.01, 1.0)
      GROUP BY c) h""",
    **ridge_parts(SEARCHED),
)
def _(spark, sf):
    records, folds = training(spark, sf)
    outputs = selection.run_raw_selection(
        records,
        folds,
        (1998, 1999, 2000, 2001),
        specifications=[LINEAR],
        coarse_c=(0.01, 1.0),
        domain=PLAIN,
    )
    return outputs["summary"].select(
        F.round("regularization_c", 6).alias("regularization_c"), "selection_brier", "n_horizons", "n_cells"
    )


@query(
    "sel6_searched_penalties",
    """SELECT c AS regularization_c, round(avg(b), 6) AS selection_brier, count(*) AS n_horizons, sum(k)::BIGINT AS n_cells
    FROM mixed WHERE c IN (0.01, 1.0) OR abs(c - 0.1 * (SELECT best FROM preferred)) < 1e-9
      OR abs(c - 10 * (SELECT best FROM preferred)) < 1e-9 GROUP BY c""",
    known_rows="""SELECT t.fold_id || '|' || t.validation_year || '|' || r.c AS cell, t.horizon, r.c, lien_status = 2 AS y,
      r.a + r.b * (log_lti - mean) / sd AS log_ratio FROM clean c JOIN targets t ON c.year = t.validation_year
      JOIN fit f ON f.fold_id = t.fold_id JOIN ridge12 r ON r.fold_id = t.fold_id""",
    mixed=f"""SELECT c, horizon, avg(brier) AS b, count(*) AS k FROM (SELECT o.cell, o.c, o.horizon,
      avg(power(1 / (1 + exp(-(log_ratio + ln(p.s / (1 - p.s))))) - CAST(y AS INTEGER), 2)) AS brier
      FROM known_rows o JOIN {SHARE} p ON o.cell = p.cell GROUP BY ALL) g GROUP BY c, horizon""",
    preferred="""SELECT arg_min(c, score) AS best FROM (SELECT c, avg(b) AS score FROM mixed WHERE c IN (0.01, 1.0)
      GROUP BY c) h""",
    **ridge_parts(SEARCHED, weighted=True),
    **share_parts("known_rows", "cell"),
)
def _(spark, sf):
    records, folds = training(spark, sf)
    outputs = selection.run_mixture_selection(
        records,
        folds,
        LINEAR,
        (1995, 1996, 1997, 1998),
        (1999, 2000, 2001),
        specifications=[LINEAR],
        coarse_c=(0.01, 1.0),
        domain=PLAIN,
    )
    return outputs["summary"].select(
        F.round("regularization_c", 6).alias("regularization_c"), "selection_brier", "n_horizons", "n_cells"
    )


@lru_cache(maxsize=1)
def forest_report(spark, sf):
    records = inputs.core(spark, sf).persist()
    return reports.run_forest_comparison(records, labelled_folds(records), DOMAIN)


@query("rpt6_forest_mixture")
def _(spark, sf):
    return forest_report(spark, sf)["metrics"]


@query("rpt6_forest_bins")
def _(spark, sf):
    return forest_report(spark, sf)["bins"]


@query("rpt6_forward_forest")
def _(spark, sf):
    records = inputs.core(spark, sf).persist()
    return reports.run_forest_comparison(records, inputs.labelled_forward_folds(records), DOMAIN)["metrics"]


@query("sel1_candidate_grid")
def _(spark, sf):
    records, folds = training(spark, sf)
    candidates = {spec: COARSE_C for spec in restricted_specifications()}
    first = selection.evaluate_raw_grid(records, folds[-1:], candidates, domain=DOMAIN)
    return selection.evaluate_raw_grid(records, folds, candidates, first, DOMAIN)


@query("sel3_raw_selection")
def _(spark, sf):
    records, folds = training(spark, sf)
    outputs = selection.run_raw_selection(
        records, folds, (1998, 1999, 2000, 2001), specifications=restricted_specifications(), domain=DOMAIN
    )
    return outputs["summary"]


@query("sel4_geographic_challengers")
def _(spark, sf):
    records, folds = training(spark, sf)
    core_cells = selection.evaluate_raw_grid(records, folds, {LINEAR: (1.0,)}, domain=DOMAIN)
    outputs = selection.run_geographic_challengers(
        records, folds, core_cells, LINEAR, 1.0, domain=DOMAIN
    )
    return outputs["increment"]


@query("sel5_spline_challenger")
def _(spark, sf):
    records, folds = training(spark, sf)
    core_cells = selection.evaluate_raw_grid(records, folds, {LINEAR: (1.0,)}, domain=DOMAIN)
    outputs = selection.run_spline_challenger(
        records, folds, core_cells, LINEAR, 1.0, domain=DOMAIN
    )
    return outputs["comparison"]


@query("sel6_mixture_selection")
def _(spark, sf):
    records, folds = training(spark, sf)
    outputs = selection.run_mixture_selection(
        records,
        folds,
        LINEAR,
        (1995, 1996, 1997, 1998),
        (1999, 2000, 2001),
        specifications=restricted_specifications(),
        domain=DOMAIN,
    )
    return outputs["summary"]


# The whole plan; only the least leaf follows the size of these tables.
LEAST_LEAF = 20
STRUCTURES = [replace(p, min_samples_leaf=LEAST_LEAF) for p in structure_grid()]


@lru_cache(maxsize=1)  # one search for the queries of its tables
def challenger(spark, sf):
    records, folds = training(spark, sf)
    forward = inputs.labelled_forward_folds(records)[0]
    return selection.run_boosting_challenger(
        records,
        folds,
        forward.train_years,
        forward.target_years,
        structures=STRUCTURES,
        feature_set="restricted",
        domain=DOMAIN,
    )


@query("sel8_boosting_challenger")
def _(spark, sf):
    return challenger(spark, sf)["summary"]


@query("sel8_refitted_winner")
def _(spark, sf):
    records, _ = training(spark, sf)
    return mean_ratios(challenger(spark, sf)["model"], records)


@query("sel8_boosting_diagnostics")
def _(spark, sf):
    return challenger(spark, sf)["diagnostics"]["metrics"]


def staged(records, folds, feature_set):
    """Survivors and refinements of the whole plan as two finished stages."""
    options = {"feature_set": feature_set, "domain": DOMAIN}
    latest = max(folds, key=lambda fold: fold.train_start)
    screen = selection.evaluate_boosting_grid(records, [latest], STRUCTURES, **options)
    top = results.top_candidates(aggregate.boosting_summary(screen)[1], BOOSTING_SURVIVORS, "parameter_id").collect()
    survivors = [p for p in STRUCTURES if p.identifier in {row.parameter_id for row in top}]
    first = selection.evaluate_boosting_grid(records, folds, survivors, **options)
    best = results.top_candidates(aggregate.boosting_summary(first)[1], 1, "parameter_id").first().parameter_id
    refined = boosting_refinements(next(p for p in survivors if p.identifier == best))
    second = selection.evaluate_boosting_grid(records, folds, refined, **options)
    return selection.staged_tables(
        first,
        second,
        expected_candidates=len(survivors) + len(refined),
        expected_cells=sum(len(fold.target_years) for fold in folds),
    )


@query("sel9_staged_tables")
def _(spark, sf):
    records, folds = training(spark, sf)
    return staged(records, folds, "restricted")["decision"]


@query("sel9_staged_core_tables")
def _(spark, sf):
    records = inputs.core(spark, sf).persist()
    return staged(records, labelled_folds(records), "core")["decision"]


@query("sel12_family_grid")
def _(spark, sf):
    records = inputs.core(spark, sf).persist()
    configurations = [
        {"family": "logistic", "specification": LINEAR.name, "C": (0.1, 1.0)},
        {"family": "hist_gradient_boosting", "specification": "core", "parameters": STRUCTURES[0]},
        {"family": "random_forest", "specification": "one_hot_categories"},
    ]
    store = f"{workspace(spark)}/cells"
    selection.run_grid(records, labelled_folds(records), configurations[:1], DOMAIN, store)
    return selection.run_grid(records, labelled_folds(records), configurations, DOMAIN, store)

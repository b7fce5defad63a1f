"""Queries of folds, plans, cells, roll-ups, comparisons and picks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate, results
from ..plans import folds as fold_plans
from ..plans import specifications as specs
from . import inputs
from .book import query, r
from .inputs import CANDIDATES

KEYS = ["specification", "regularization_c", "train_start", "validation_year", "horizon"]
SUMMARY = """SELECT specification, continuous_form, interactions, geography, regularization_c,
    avg(mean_brier) AS selection_brier, count(DISTINCT horizon) AS n_horizons, sum(n_cells)::BIGINT AS n_cells
    FROM horizons GROUP BY ALL"""
HORIZONS = """SELECT specification, continuous_form, interactions, geography, regularization_c, horizon,
    avg(brier_score) AS mean_brier, count(*) AS n_cells, min(brier_score) AS min_brier, max(brier_score) AS max_brier
    FROM cells GROUP BY ALL"""
WITH_SUMMARY = {"summary": SUMMARY, "horizons": HORIZONS}


def records(spark, sf):
    return inputs.restricted(spark, sf)


def folds(spark, sf):
    return fold_plans.reverse_fold_table(records(spark, sf).where(F.col("lien_status").isNotNull()))


def year_sizes(spark, sf):
    return records(spark, sf).groupBy("year").agg(F.count(F.lit(1)).alias("n_records"))


FOLD_SIZES = """SELECT f.fold_id, f.train_start, f.train_end, n_target_years, n_source, n_target FROM
    (SELECT fold_id, train_start, train_end, count(*) AS n_target_years, sum(n)::BIGINT AS n_target
      FROM targets t JOIN sizes s ON t.validation_year = s.year GROUP BY ALL) f
    JOIN (SELECT fold_id, sum(n)::BIGINT AS n_source FROM sources t JOIN sizes s ON t.year = s.year GROUP BY ALL) g
    ON f.fold_id = g.fold_id"""
SIZES = "SELECT year, count(*) AS n FROM clean GROUP BY year"


@query(
    "fld1_reverse_folds",
    "SELECT fold_id, train_start, train_end, validation_year, horizon, n AS n_records"
    " FROM targets JOIN sizes ON validation_year = year",
    sizes=SIZES,
)
def _(spark, sf):
    targets = fold_plans.fold_targets(folds(spark, sf)).drop("direction")
    sizes = year_sizes(spark, sf).withColumnRenamed("year", "validation_year")
    return targets.join(sizes, "validation_year")


@query(
    "fld2_forward_fold",
    """SELECT 'forward__train_1995_1996__target_1997_2001' AS fold_id, CASE WHEN year < 1997 THEN 'source'
    ELSE 'target' END AS role, year, CASE WHEN year > 1996 THEN CAST(year - 1996 AS INTEGER) END AS horizon, n
    FROM sizes""",
    sizes=SIZES,
)
def _(spark, sf):
    sizes = year_sizes(spark, sf).persist()
    years = sorted(row.year for row in sizes.collect())
    fold = fold_plans.forward_fold([y for y in years if y < 1997], [y for y in years if y > 1996])
    table = fold_plans.fold_table(spark, [fold])
    targets = fold_plans.fold_targets(table).select(
        "fold_id", F.lit("target").alias("role"), F.col("validation_year").alias("year"), "horizon"
    )
    sources = fold_plans.fold_sources(table).select(
        "fold_id", F.lit("source").alias("role"), "year", F.lit(None).cast("int").alias("horizon")
    )
    return targets.unionByName(sources).join(sizes.withColumnRenamed("n_records", "n"), "year")


@query(
    "fld3_fold_rules",
    f"""SELECT fold_id, rule, n_source FROM ({FOLD_SIZES}) f CROSS JOIN
    (VALUES ('horizon_mismatch'), ('horizon_not_positive')) v(rule)
    UNION ALL SELECT fold_id, 'years_overlap', n_source FROM ({FOLD_SIZES}) f WHERE train_start % 2 = 1""",
    sizes=SIZES,
)
def _(spark, sf):
    """Folds with spoiled horizons, and with shared years where the start is odd."""
    plan = folds(spark, sf)
    start = F.array_min("train_years")
    spoiled = plan.withColumns(
        {
            "horizons": F.transform("horizons", lambda h: h - 1),
            "target_years": F.when(
                start % 2 == 1, F.array_append("target_years", start)
            ).otherwise(F.col("target_years")),
        }
    )
    sizes = (
        fold_plans.fold_sources(plan)
        .join(year_sizes(spark, sf), "year")
        .groupBy("fold_id")
        .agg(F.sum("n_records").alias("n_source"))
    )
    return fold_plans.fold_violations(spoiled).join(sizes, "fold_id")


@query(
    "jon14_candidate_plan",
    f"""SELECT f.fold_id, f.train_start, f.train_end, n_target_years AS n_targets, specification, n_source FROM ({FOLD_SIZES}) f
    CROSS JOIN (SELECT a || '__' || b AS specification FROM (VALUES ('linear'), ('spline_lti'), ('spline_both')) x(a)
      CROSS JOIN (VALUES ('none'), ('loan_type'), ('purchaser_type'), ('both')) y(b)
      UNION ALL SELECT 'spline_lti__purchaser_type_spline_lti') c""",
    sizes=SIZES,
)
def _(spark, sf):
    entries = [{"specification": s.name} for s in specs.candidate_specifications()]
    plan = specs.grid_plan(folds(spark, sf), entries)
    return plan.join(source_sizes(spark, sf), "fold_id").withColumn(
        "n_targets", F.col("n_targets").cast("long")
    )


def source_sizes(spark, sf):
    return (
        fold_plans.fold_sources(folds(spark, sf))
        .join(year_sizes(spark, sf), "year")
        .groupBy("fold_id")
        .agg(F.sum("n_records").alias("n_source"))
    )


@query(
    "fea9_decoded_specifications",
    """SELECT specification, continuous_form, interactions, geography, 'core' AS feature_set, TRUE AS is_valid,
    sum(n)::BIGINT AS n FROM cells GROUP BY ALL
    UNION ALL SELECT 'linear__purchaser_type_spline_lti', 'linear', 'purchaser_type_spline_lti', 'none', 'core',
    FALSE, sum(n)::BIGINT FROM cells""",
)
def _(spark, sf):
    cells = inputs.cells(spark, sf).select("specification", "n").persist()
    spoiled = cells.withColumn("specification", F.lit("linear__purchaser_type_spline_lti"))
    named = cells.unionByName(spoiled).groupBy("specification").agg(F.sum("n").alias("n"))
    return specs.decode_specifications(named)


@query(
    "fea10_candidate_grids",
    """SELECT feature_set, specification, n_folds, n_records FROM
    (SELECT 'core' AS feature_set, a || '__' || b AS specification FROM (VALUES ('linear'), ('spline_lti'), ('spline_both')) x(a)
      CROSS JOIN (VALUES ('none'), ('loan_type'), ('purchaser_type'), ('both')) y(b)
      UNION ALL SELECT 'restricted', 'restricted__' || a || '__' || b FROM (VALUES ('linear'), ('spline_lti')) x(a)
      CROSS JOIN (VALUES ('none'), ('loan_type'), ('purchaser_type'), ('both')) y(b)) g
    CROSS JOIN (SELECT count(*) AS n_folds, sum(n_source)::BIGINT AS n_records FROM (SELECT fold_id,
      sum(n)::BIGINT AS n_source FROM sources t JOIN sizes s ON t.year = s.year GROUP BY ALL) h) k""",
    sizes=SIZES,
)
def _(spark, sf):
    sizes = source_sizes(spark, sf).persist()
    plan = None
    for feature_set in ("core", "restricted"):
        part = specs.coarse_plan(folds(spark, sf), feature_set).join(sizes, "fold_id")
        plan = part if plan is None else plan.unionByName(part)
    return plan.groupBy("feature_set", "specification").agg(
        F.count(F.lit(1)).alias("n_folds"), F.sum("n_source").alias("n_records")
    )


# -- roll-ups ----------------------------------------------------------------


@query(
    "agg19_two_stage_means",
    """SELECT specification, regularization_c, round(avg(b), 6) AS brier_score, round(avg(l), 6) AS log_loss,
    count(DISTINCT horizon) AS n_horizons, sum(k)::BIGINT AS n_cells FROM (SELECT specification, regularization_c,
      horizon, avg(brier_score) AS b, avg(log_loss) AS l, count(*) AS k FROM cells GROUP BY ALL) h GROUP BY ALL""",
)
def _(spark, sf):
    cells = inputs.cells(spark, sf).persist()
    keys = ["specification", "regularization_c"]
    return aggregate.two_stage_means(cells, keys, ["brier_score", "log_loss"])[1]


@query(
    "agg20_brier_horizons",
    f"""SELECT specification, continuous_form, interactions, geography, regularization_c, horizon, n_cells,
    {r('mean_brier', 'min_brier', 'max_brier')} FROM horizons""",
    horizons=HORIZONS,
)
def _(spark, sf):
    return aggregate.brier_summary(inputs.cells(spark, sf), validate=False)[0]


@query(
    "agg20_brier_summary",
    f"""SELECT specification, continuous_form, interactions, geography, regularization_c,
    {r('selection_brier')}, n_horizons, n_cells FROM summary""",
    **WITH_SUMMARY,
)
def _(spark, sf):
    return aggregate.brier_summary(inputs.cells(spark, sf).persist())[1]


@query(
    "agg21_mixture_summary",
    """SELECT specification, continuous_form, interactions, regularization_c, round(avg(b), 6) AS selection_brier,
    round(avg(l), 6) AS selection_log_loss, round(avg(e), 6) AS selection_share_error,
    count(DISTINCT horizon) AS n_horizons, sum(k)::BIGINT AS n_cells
    FROM (SELECT specification, continuous_form, interactions, regularization_c, horizon, avg(brier_score) AS b,
      avg(log_loss) AS l, avg(mixture_share_error) AS e, count(*) AS k FROM cells GROUP BY ALL) h GROUP BY ALL""",
)
def _(spark, sf):
    return aggregate.mixture_summary(inputs.cells(spark, sf).persist())[1]


def boosting_cells(spark, sf):
    """Literal candidates under boosting parameter names."""
    number = F.round(F.col("regularization_c") * 100).cast("int")
    return inputs.cells(spark, sf).select(
        F.lit(7).alias("max_leaf_nodes"),
        F.lit(0.05).alias("learning_rate"),
        (F.length("specification") * 10 + number).alias("max_iter"),
        F.col("regularization_c").alias("l2_regularization"),
        F.lit(1000).alias("min_samples_leaf"),
        F.col("brier_score").alias("adjusted_brier"),
        "mixture_share_error",
        "train_start",
        "validation_year",
        "horizon",
    ).withColumn("parameter_id", specs.boosting_identifier())


L2_LABEL = "CASE regularization_c WHEN 0.01 THEN '0p01' WHEN 0.1 THEN '0p1' ELSE '1' END"
ITERATIONS = "CAST(length(specification) * 10 + round(regularization_c * 100) AS INTEGER)"
BOOSTING_ID = f"'leaves_7__lr_0p05__iter_' || {ITERATIONS} || '__l2_' || {L2_LABEL} || '__minleaf_1000'"
BOOSTING = f"""SELECT {BOOSTING_ID} AS parameter_id, {ITERATIONS} AS max_iter, regularization_c AS l2_regularization,
    avg(b) AS selection_brier, avg(e) AS selection_share_error, count(DISTINCT horizon) AS n_horizons,
    sum(k)::BIGINT AS n_cells FROM (SELECT specification, regularization_c, horizon, avg(brier_score) AS b,
      avg(mixture_share_error) AS e, count(*) AS k FROM cells GROUP BY ALL) h GROUP BY specification, regularization_c"""


@query(
    "agg22_boosting_summary",
    f"""SELECT parameter_id, 7 AS max_leaf_nodes, CAST(0.05 AS DOUBLE) AS learning_rate, max_iter, l2_regularization,
    1000 AS min_samples_leaf, {r('selection_brier', 'selection_share_error')}, n_horizons, n_cells FROM boosting""",
    boosting=BOOSTING,
)
def _(spark, sf):
    return aggregate.boosting_summary(boosting_cells(spark, sf), validate=False)[1]


def family_cells(spark, sf):
    cells = inputs.cells(spark, sf)
    parameters = F.to_json(F.create_map(F.lit("C"), F.col("regularization_c")))
    seed = F.when(F.col("interactions") == "purchaser_type", 17)
    return cells.withColumns(
        {
            "family": F.lit("logistic"),
            "hyperparameters": parameters,
            "random_seed": seed,
            "configuration_id": F.concat_ws("__", F.lit("logistic"), "specification", parameters),
            "mixture_share": F.col("mean_probability"),
        }
    )


NUMBER = "CASE regularization_c WHEN 0.01 THEN '0.01' WHEN 0.1 THEN '0.1' ELSE '1.0' END"


@query(
    "agg23_family_summary",
    f"""SELECT 'logistic__' || specification || '__{{"C":' || {NUMBER} || '}}' AS configuration_id,
    'logistic' AS family, specification, '{{"C":' || {NUMBER} || '}}' AS hyperparameters,
    CASE WHEN interactions = 'purchaser_type' THEN 17 END AS random_seed, round(avg(b), 6) AS selection_brier,
    round(avg(l), 6) AS mean_log_loss, count(*) AS n_horizons, sum(k)::BIGINT AS n_cells
    FROM (SELECT specification, interactions, regularization_c, horizon, avg(brier_score) AS b, avg(log_loss) AS l,
      count(*) AS k FROM cells GROUP BY ALL) h GROUP BY specification, interactions, regularization_c""",
)
def _(spark, sf):
    return aggregate.family_summary(family_cells(spark, sf))[1]


def metric_cells(spark, sf):
    """Cells in the layout of a metric report."""
    return inputs.cells(spark, sf).where("specification = 'linear__loan_type'").select(
        "horizon",
        "validation_year",
        "n",
        "brier_score",
        "log_loss",
        F.col("actual_second_share").alias("observed_second_share"),
        F.col("mean_probability").alias("mean_predicted_second_share"),
        F.col("mixture_share_error").alias("calibration_mean_error"),
        F.col("mean_log_ratio").alias("calibration_intercept"),
        F.col("hard_share").alias("calibration_slope"),
    )


METRIC_MEANS = ", ".join(
    f"avg({old}) AS {new}"
    for old, new in (
        ("brier_score", "brier_score"),
        ("log_loss", "log_loss"),
        ("actual_second_share", "observed_second_share"),
        ("mean_probability", "mean_predicted_second_share"),
        ("mixture_share_error", "calibration_mean_error"),
        ("mean_log_ratio", "calibration_intercept"),
        ("hard_share", "calibration_slope"),
    )
)
METRIC_HORIZONS = f"""SELECT horizon, {METRIC_MEANS}, count(*) AS n_cells, sum(n)::BIGINT AS n_loans FROM cells
    WHERE specification = 'linear__loan_type' GROUP BY horizon"""
METRIC_NAMES = aggregate.CELL_METRICS


@query(
    "agg24_reverse_horizons",
    f"SELECT horizon, {r(*METRIC_NAMES)}, n_cells, n_loans FROM metric_horizons",
    metric_horizons=METRIC_HORIZONS,
)
def _(spark, sf):
    return aggregate.reverse_metric_summary(metric_cells(spark, sf))[0]


@query(
    "agg24_reverse_overall",
    f"""SELECT {', '.join(f'round(avg({n}), 6) AS {n}' for n in METRIC_NAMES)}, count(DISTINCT horizon) AS n_horizons,
    sum(n_cells)::BIGINT AS n_cells, 'equal_within_horizon_then_equal_across_horizons' AS weighting
    FROM metric_horizons""",
    metric_horizons=METRIC_HORIZONS,
)
def _(spark, sf):
    return aggregate.reverse_metric_summary(metric_cells(spark, sf))[1]


@query(
    "agg25_forward_overall",
    f"""SELECT {r(*METRIC_NAMES)}, n_cells, 'equal_across_validation_years' AS weighting FROM (SELECT {METRIC_MEANS},
    count(*) AS n_cells FROM cells WHERE specification = 'linear__loan_type') g""",
)
def _(spark, sf):
    return aggregate.forward_metric_summary(metric_cells(spark, sf))


SHARE_SOURCES = {
    name: source
    for name, source in zip(
        aggregate.SHARE_ESTIMATORS,
        ("mean_probability", "hard_share", "brier_score", "log_loss", "mean_probability * 0.9", "hard_share * 0.5",
         "brier_score * 2", "log_loss * 0.5"),
        strict=True,
    )
}
SHARE_ROWS = " UNION ALL ".join(
    f"SELECT '{name}' AS estimator, horizon, {source} - actual_second_share AS e FROM cells"
    for name, source in SHARE_SOURCES.items()
)


@query(
    "agg26_share_errors",
    """SELECT estimator, round(avg(s), 6) AS selection_signed_error, round(avg(a), 6) AS selection_absolute_error,
    round(avg(q), 6) AS selection_squared_error, count(DISTINCT horizon) AS n_horizons, sum(k)::BIGINT AS n_cells
    FROM (SELECT estimator, horizon, avg(e) AS s, avg(abs(e)) AS a, avg(e * e) AS q, count(*) AS k FROM share_rows
      GROUP BY ALL) h GROUP BY estimator""",
    share_rows=SHARE_ROWS,
)
def _(spark, sf):
    columns = {
        aggregate.SHARE_ESTIMATORS[name]: F.expr(source) for name, source in SHARE_SOURCES.items()
    }
    return aggregate.share_error_summary(inputs.cells(spark, sf).withColumns(columns))[1]


# -- comparisons -------------------------------------------------------------


def pick(spark, sf, specification: str, c: float):
    return results.select_candidate(inputs.cells(spark, sf), F.lit(specification), F.lit(c))


def picked(specification: str, c: float, metric: str = "brier_score") -> str:
    return (
        f"(SELECT train_start, validation_year, horizon, {metric} AS m FROM cells"
        f" WHERE specification = '{specification}' AND abs(regularization_c - {c}) < 1e-9)"
    )


def comparison_sql(primary: str, short: str, others: dict[str, tuple[str, float]], base: tuple[str, float]) -> str:
    columns = [f"round(p.m, 6) AS {primary}_brier"]
    joins = []
    for i, (name, candidate) in enumerate(others.items()):
        columns += [
            f"round(o{i}.m, 6) AS {name}_brier",
            f"round(p.m - o{i}.m, 6) AS {short}_minus_{name}_brier",
        ]
        joins.append(
            f"JOIN {picked(*candidate)} o{i} ON p.train_start = o{i}.train_start"
            f" AND p.validation_year = o{i}.validation_year AND p.horizon = o{i}.horizon"
        )
    return (
        f"SELECT p.train_start, p.validation_year, p.horizon, {', '.join(columns)}"
        f" FROM {picked(*base)} p {' '.join(joins)}"
    )


A, B, C, D = ("linear__none", 1.0), ("linear__loan_type", 1.0), ("spline_lti__purchaser_type", 0.1), ("linear__none", 0.01)


@query(
    "jon5_cell_metric_merge",
    f"""SELECT p.train_start, p.validation_year, p.horizon, round(p.m, 6) AS base_loss, round(o.m, 6) AS other_loss,
    round(p.m - o.m, 6) AS base_minus_other FROM {picked(*A, 'log_loss')} p JOIN {picked(*C, 'log_loss')} o
    ON p.train_start = o.train_start AND p.validation_year = o.validation_year AND p.horizon = o.horizon""",
)
def _(spark, sf):
    return results.merge_cell_metrics(
        pick(spark, sf, *A),
        "log_loss",
        "base_loss",
        {"other_loss": (pick(spark, sf, *C), "log_loss")},
        {"other_loss": "base_minus_other"},
    )


@query("jon6_boosting_vs_logistic", comparison_sql("boosting", "boosting", {"logistic": B}, A))
def _(spark, sf):
    return results.estimator_comparison(
        pick(spark, sf, *A), "boosting", {"logistic": pick(spark, sf, *B)}
    )


@query("jon7_forest_comparison", comparison_sql("forest", "forest", {"logistic": B, "boosting": C}, A))
def _(spark, sf):
    others = {"logistic": pick(spark, sf, *B), "boosting": pick(spark, sf, *C)}
    return results.estimator_comparison(pick(spark, sf, *A), "forest", others)


@query(
    "jon8_reselected_comparison",
    comparison_sql("reselected_logistic", "reselected", {"existing_logistic": B, "boosting": C, "forest": D}, A),
)
def _(spark, sf):
    others = {
        "existing_logistic": pick(spark, sf, *B),
        "boosting": pick(spark, sf, *C),
        "forest": pick(spark, sf, *D),
    }
    return results.estimator_comparison(
        pick(spark, sf, *A), "reselected_logistic", others, short_name="reselected"
    )


@query(
    "jon9_geographic_increment",
    f"""SELECT a.train_start, a.validation_year, a.horizon, round(a.m, 6) AS core_brier, 'region' AS geography,
    'linear__none__region' AS specification, CAST(1.0 AS DOUBLE) AS regularization_c, round(b.m, 6) AS geography_brier,
    round(b.m - a.m, 6) AS brier_difference_from_core FROM {picked(*A)} a JOIN {picked('linear__none__region', 1.0)} b
    ON a.train_start = b.train_start AND a.validation_year = b.validation_year""",
)
def _(spark, sf):
    cells = inputs.cells(spark, sf).persist()
    geographic = cells.where("geography <> 'none'")
    summary = aggregate.brier_summary(geographic)[1]
    core = results.select_candidate(cells, F.lit(A[0]), F.lit(A[1]))
    return results.geographic_increment(core, geographic, summary)


@query(
    "jon10_challenger_counts",
    f"""SELECT count(*) FILTER (b.m < a.m) AS n_cells_challenger_improves, count(*) AS n_cells,
    round(avg(b.m - a.m), 6) AS mean_brier_difference FROM {picked(*A)} a JOIN {picked(*C)} b
    ON a.train_start = b.train_start AND a.validation_year = b.validation_year""",
)
def _(spark, sf):
    compared = results.challenger_cells(
        pick(spark, sf, *A), pick(spark, sf, *C), "challenger_brier"
    )
    return results.challenger_summary(compared)


LISTED = "SELECT specification, regularization_c, train_start, validation_year, horizon FROM cells"
DONE = "brier_score < (SELECT median(brier_score) FROM cells)"


def below_median(cells):
    return cells.where(F.col("brier_score") < cells.agg(F.median("brier_score")).scalar())


@query("jon11_missing_cells", f"{LISTED} WHERE NOT {DONE}")
def _(spark, sf):
    cells = inputs.cells(spark, sf).persist()
    plan = fold_plans.fold_targets(folds(spark, sf)).select(
        "train_start", "validation_year", "horizon", F.inline(inputs.candidate_rows())
    )
    return results.missing_cells(plan.select(*KEYS), below_median(cells), KEYS)


@query(
    "jon12_complete_cells",
    f"""SELECT train_start, validation_year FROM cells WHERE specification = 'linear__none' AND regularization_c = 1
    AND train_start IN (SELECT train_start FROM cells WHERE {DONE} AND specification = 'linear__loan_type')
    AND (train_start, validation_year) IN (SELECT (train_start, validation_year) FROM cells
      WHERE {DONE} AND specification = 'linear__loan_type')""",
)
def _(spark, sf):
    cells = inputs.cells(spark, sf).persist()
    keys = ["train_start", "validation_year"]
    metrics = results.select_candidate(cells, F.lit("linear__none"), F.lit(1.0))
    bins = below_median(cells).where("specification = 'linear__loan_type'")
    estimators = cells.withColumn("estimator", F.col("interactions"))
    declared = results.cells_with_estimators(
        estimators, keys, ["none", "loan_type", "purchaser_type"]
    )
    return results.complete_cells([metrics, bins, declared], keys)


@query(
    "jon15_plan_differences",
    f"""SELECT specification, regularization_c, train_start, validation_year, horizon, n_planned, n_found,
    CASE WHEN n_planned = 0 THEN 'unexpected' WHEN n_found = 0 THEN 'missing' WHEN n_found > 1 THEN 'duplicate'
      ELSE 'complete' END AS status
    FROM (SELECT specification, regularization_c, train_start, validation_year, horizon,
      CASE WHEN geography = 'none' THEN 1 ELSE 0 END::BIGINT AS n_planned,
      (CASE WHEN {DONE} THEN 1 ELSE 0 END + CASE WHEN {DONE} AND horizon = 1 THEN 1 ELSE 0 END)::BIGINT AS n_found
      FROM cells) g WHERE n_planned + n_found > 0""",
)
def _(spark, sf):
    cells = inputs.cells(spark, sf).persist()
    done = below_median(cells)
    found = done.unionByName(done.where("horizon = 1"))
    return results.plan_differences(cells.where("geography = 'none'"), found, KEYS)


@query(
    "jon16_table_parity",
    f"""SELECT specification, regularization_c, train_start, validation_year, horizon,
    round(brier_score, 6) AS brier_score_left,
    CASE WHEN horizon < 3 THEN round(brier_score + CASE WHEN horizon = 2 THEN 0.001 ELSE 0 END, 6) END
      AS brier_score_right FROM cells WHERE horizon >= 2""",
)
def _(spark, sf):
    cells = inputs.cells(spark, sf).persist()
    changed = cells.where("horizon < 3").withColumn(
        "brier_score",
        F.col("brier_score") + F.when(F.col("horizon") == 2, 0.001).otherwise(0.0),
    )
    return results.table_differences(cells, changed, KEYS, ["brier_score"], 1e-9, 1e-12)


# -- picks, unions and orders --------------------------------------------------


@query(
    "win3_best_penalty",
    """SELECT specification, continuous_form, interactions, geography, regularization_c,
    round(selection_brier, 6) AS selection_brier, n_horizons, n_cells FROM (SELECT *, row_number() OVER
      (PARTITION BY specification ORDER BY selection_brier, regularization_c) AS k FROM summary) g WHERE k = 1""",
    **WITH_SUMMARY,
)
def _(spark, sf):
    summary = aggregate.brier_summary(inputs.cells(spark, sf), validate=False)[1]
    return results.best_rows(summary, ["specification"], ["selection_brier", "regularization_c"])


@query(
    "top1_survivors",
    """SELECT parameter_id, round(selection_brier, 6) AS selection_brier, n_cells FROM boosting
    ORDER BY boosting.selection_brier, parameter_id LIMIT 2""",
    boosting=BOOSTING,
)
def _(spark, sf):
    summary = aggregate.boosting_summary(boosting_cells(spark, sf), validate=False)[1]
    return results.top_candidates(summary, 2, "parameter_id").select(
        "parameter_id", "selection_brier", "n_cells"
    )


@query(
    "top2_forced_incumbent",
    """SELECT specification, regularization_c, round(selection_brier, 6) AS selection_brier,
    specification = 'spline_lti__purchaser_type' AS incumbent_forced FROM (SELECT *, row_number() OVER
      (PARTITION BY specification ORDER BY selection_brier, regularization_c) AS k FROM summary) g WHERE k = 1
    ORDER BY specification = 'spline_lti__purchaser_type' DESC, g.selection_brier, specification LIMIT 3""",
    **WITH_SUMMARY,
)
def _(spark, sf):
    summary = aggregate.brier_summary(inputs.cells(spark, sf), validate=False)[1]
    kept = results.screen_survivors(summary, specs.INCUMBENT, 3, validate=False)
    return kept.select("specification", "regularization_c", "selection_brier", "incumbent_forced")


@query(
    "top3_decision",
    """SELECT specification, regularization_c, round(selection_brier, 6) AS selection_brier, n_cells,
    'raw_brier_equal_horizon_weight' AS selection_metric, '1995-1998' AS training_years FROM summary
    ORDER BY summary.selection_brier, specification LIMIT 1""",
    **WITH_SUMMARY,
)
def _(spark, sf):
    summary = aggregate.brier_summary(inputs.cells(spark, sf), validate=False)[1]
    facts = {
        "selection_metric": "raw_brier_equal_horizon_weight",
        "training_years": "1995-1998",
    }
    return results.decision_row(summary, ["specification", "regularization_c"], facts).select(
        "specification", "regularization_c", "selection_brier", "n_cells", *facts
    )


@query(
    "srt1_ordered_cells",
    f"""SELECT specification, regularization_c, horizon, validation_year, train_start, {r('brier_score')} FROM cells
    ORDER BY specification, regularization_c, horizon, validation_year, train_start""",
)
def _(spark, sf):
    order = ["specification", "regularization_c", "horizon", "validation_year", "train_start"]
    return results.sorted_cells(inputs.cells(spark, sf), order).select(*order, "brier_score")


@query(
    "set1_stage_union",
    f"""SELECT CASE WHEN horizon = 1 THEN 'screen' ELSE 'refinement' END AS stage, specification, regularization_c,
    train_start, validation_year, {r('brier_score')} FROM cells""",
)
def _(spark, sf):
    cells = inputs.cells(spark, sf).select(*KEYS, "brier_score").persist()
    screen = cells.where("horizon = 1").withColumn("stage", F.lit("screen"))
    rest = cells.where("horizon > 1").withColumn("stage", F.lit("refinement"))
    return results.union_distinct([screen, rest], KEYS).drop("horizon")


@query(
    "set2_keep_last",
    """SELECT specification, regularization_c, train_start, validation_year, horizon, batch,
    round(brier_score, 6) AS brier_score FROM (SELECT *, 1 AS batch FROM cells WHERE horizon > 1
      UNION ALL SELECT * REPLACE (brier_score + 1 AS brier_score), 2 AS batch FROM cells WHERE horizon < 3) g
    QUALIFY row_number() OVER (PARTITION BY specification, regularization_c, train_start, validation_year, horizon
      ORDER BY batch DESC) = 1""",
)
def _(spark, sf):
    cells = inputs.cells(spark, sf).select(*KEYS, "brier_score").persist()
    first = cells.where("horizon > 1").withColumn("batch", F.lit(1))
    second = cells.where("horizon < 3").withColumns(
        {"brier_score": F.col("brier_score") + 1, "batch": F.lit(2)}
    )
    return results.latest_by_key(first.unionByName(second), KEYS, "batch")


@query(
    "set3_overlap_check",
    """SELECT specification, regularization_c, train_start, validation_year, horizon, 2::BIGINT AS n FROM cells
    WHERE horizon = 2""",
)
def _(spark, sf):
    cells = inputs.cells(spark, sf).select(*KEYS).persist()
    both = cells.where("horizon > 1").unionByName(cells.where("horizon < 3"))
    return results.duplicated_keys(both, KEYS)


@query(
    "evl8_family_translation",
    f"""SELECT {BOOSTING_ID} AS parameter_id, 7 AS max_leaf_nodes, CAST(0.05 AS DOUBLE) AS learning_rate,
    {ITERATIONS} AS max_iter, regularization_c AS l2_regularization, 1000 AS min_samples_leaf, train_start, train_end,
    validation_year, horizon, n AS n_validation, round(actual_second_share, 6) AS actual_second_share,
    round(mean_probability, 6) AS mixture_share,
    round(mixture_share_error, 6) AS mixture_share_error, round(mean_probability, 6) AS mean_adjusted_probability,
    round(brier_score, 6) AS adjusted_brier, round(log_loss, 6) AS adjusted_log_loss,
    round(hard_share, 6) AS adjusted_hard_share_050, {ITERATIONS} AS n_iter_fitted FROM cells""",
)
def _(spark, sf):
    number = F.round(F.col("regularization_c") * 100).cast("int")
    parameters = F.to_json(
        F.struct(
            F.lit(7).alias("max_leaf_nodes"),
            F.lit(0.05).alias("learning_rate"),
            (F.length("specification") * 10 + number).alias("max_iter"),
            F.col("regularization_c").alias("l2_regularization"),
            F.lit(1000).alias("min_samples_leaf"),
        )
    )
    cells = inputs.cells(spark, sf).withColumns(
        {
            "hyperparameters": parameters,
            "mixture_share": F.col("mean_probability"),
            "hard_share_050": F.col("hard_share"),
            "target_year": F.col("validation_year"),
            "n_observations": F.col("n"),
        }
    )
    return results.translate_family_cells(cells)


# -- selection plans -----------------------------------------------------------


@query(
    "sel2_refinement_values",
    """SELECT specification, best_c AS best_coarse_c, round(best_c * f, 6) AS regularization_c
    FROM (SELECT specification, arg_min(regularization_c, selection_brier) AS best_c FROM summary GROUP BY 1) g
    CROSS JOIN (VALUES (0.1::DOUBLE), (10.0::DOUBLE)) v(f)""",
    **WITH_SUMMARY,
)
def _(spark, sf):
    summary = aggregate.brier_summary(inputs.cells(spark, sf), validate=False)[1]
    return specs.refinement_grid(summary)


STRUCTURES = """SELECT n AS max_leaf_nodes, lr AS learning_rate, 200 AS max_iter, 1.0::DOUBLE AS l2_regularization,
    1000 AS min_samples_leaf, 'leaves_' || n || '__lr_' || CASE WHEN lr = 0.05 THEN '0p05' ELSE '0p1' END
      || '__iter_200__l2_1__minleaf_1000' AS parameter_id
    FROM (VALUES (7), (15), (31)) a(n) CROSS JOIN (VALUES (0.05::DOUBLE), (0.1::DOUBLE)) b(lr)"""
FOLD_PLAN = """SELECT fold_id, train_start, train_end, count(*)::INTEGER AS n_targets FROM targets GROUP BY ALL"""
STRUCTURE_SCORES = """SELECT parameter_id, avg(c.brier_score + (hash_order * 0.001)) AS selection_brier
    FROM (SELECT *, max_leaf_nodes * learning_rate AS hash_order FROM structures) s CROSS JOIN cells c GROUP BY ALL"""
PLAN_PARTS = {"structures": STRUCTURES, "fold_plan": FOLD_PLAN, "scores": STRUCTURE_SCORES}
PLAN_COLUMNS = "p.fold_id, p.train_start, p.n_targets, s.parameter_id, max_leaf_nodes, learning_rate, max_iter, l2_regularization, min_samples_leaf"


def structure_scores(spark, sf):
    """Scores of the declared structures derived from the literal cells."""
    base = inputs.cells(spark, sf).agg(F.avg("brier_score")).scalar()
    grid = specs.grid_plan(folds(spark, sf), specs.parameter_entries(specs.structure_grid()))
    structures = grid.select(*specs.PARAMETER_NAMES).distinct()
    bonus = F.col("max_leaf_nodes") * F.col("learning_rate") * 0.001
    return structures.withColumns(
        {"parameter_id": specs.boosting_identifier(), "selection_brier": base + bonus}
    )


@query(
    "sel7_structure_grid",
    f"""SELECT {PLAN_COLUMNS}, p.train_end, n_source FROM fold_plan p JOIN (SELECT fold_id, sum(n)::BIGINT AS n_source
    FROM sources t JOIN sizes z ON t.year = z.year GROUP BY ALL) q ON p.fold_id = q.fold_id CROSS JOIN structures s""",
    sizes=SIZES,
    **PLAN_PARTS,
)
def _(spark, sf):
    plan = specs.grid_plan(folds(spark, sf), specs.parameter_entries(specs.structure_grid()))
    return plan.withColumn("parameter_id", specs.boosting_identifier()).join(
        source_sizes(spark, sf), "fold_id"
    )


@query(
    "sel14_screen_plan",
    f"""SELECT {PLAN_COLUMNS}, p.train_end, 'screen' AS stage FROM fold_plan p CROSS JOIN structures s
    WHERE p.train_start = (SELECT max(train_start) FROM fold_plan)""",
    **PLAN_PARTS,
)
def _(spark, sf):
    return specs.boosting_screen_plan(folds(spark, sf))


@query(
    "sel14_survivor_plan",
    f"""SELECT {PLAN_COLUMNS}, p.train_end, 'survivors' AS stage FROM fold_plan p CROSS JOIN structures s
    WHERE s.parameter_id IN (SELECT parameter_id FROM scores ORDER BY selection_brier, parameter_id LIMIT 2)""",
    **PLAN_PARTS,
)
def _(spark, sf):
    return specs.boosting_survivor_plan(folds(spark, sf), structure_scores(spark, sf))


@query(
    "sel14_refinement_plan",
    """SELECT p.fold_id, p.train_start, p.n_targets, max_leaf_nodes, learning_rate, v.max_iter, v.l2_regularization,
    min_samples_leaf, 'leaves_' || max_leaf_nodes || '__lr_' || CASE WHEN learning_rate = 0.05 THEN '0p05' ELSE '0p1' END
      || '__iter_' || v.max_iter || '__l2_' || v.label || '__minleaf_1000' AS parameter_id, 'refinement' AS stage
    FROM fold_plan p CROSS JOIN (SELECT * FROM structures WHERE parameter_id = (SELECT parameter_id FROM scores
      ORDER BY selection_brier, parameter_id LIMIT 1)) s
    CROSS JOIN (VALUES (100, 1.0::DOUBLE, '1'), (400, 1.0::DOUBLE, '1'), (200, 0.0::DOUBLE, '0'),
      (200, 10.0::DOUBLE, '10')) v(max_iter, l2_regularization, label)""",
    **PLAN_PARTS,
)
def _(spark, sf):
    return specs.boosting_refinement_plan(folds(spark, sf), structure_scores(spark, sf))


@query(
    "sel11_neighbourhood_plan",
    """SELECT p.fold_id, p.train_start, p.n_targets, v.specification, v.n_values, 'first_order' AS stage, n_source
    FROM fold_plan p JOIN (SELECT fold_id, sum(n)::BIGINT AS n_source FROM sources t JOIN sizes z ON t.year = z.year
      GROUP BY ALL) q ON p.fold_id = q.fold_id
    CROSS JOIN (VALUES ('spline_lti__purchaser_type', 3), ('linear__purchaser_type', 1),
      ('spline_both__purchaser_type', 1), ('spline_lti__none', 1), ('spline_lti__loan_type', 1),
      ('spline_lti__both', 1), ('spline_lti__purchaser_type_spline_lti', 1)) v(specification, n_values)""",
    sizes=SIZES,
    **PLAN_PARTS,
)
def _(spark, sf):
    plan = specs.neighbourhood_plan(folds(spark, sf)).join(source_sizes(spark, sf), "fold_id")
    return plan.withColumn("n_values", F.size("c_values")).drop("c_values")


@query(
    "sel15_coarse_plan",
    """SELECT p.fold_id, p.train_start, p.train_end, p.n_targets, a || '__' || b AS specification, 'coarse' AS stage,
    'core' AS feature_set, 4 AS n_values, n_source FROM fold_plan p JOIN (SELECT fold_id, sum(n)::BIGINT AS n_source
      FROM sources t JOIN sizes z ON t.year = z.year GROUP BY ALL) q ON p.fold_id = q.fold_id
    CROSS JOIN (VALUES ('linear'), ('spline_lti'), ('spline_both')) x(a)
    CROSS JOIN (VALUES ('none'), ('loan_type'), ('purchaser_type'), ('both')) y(b)""",
    sizes=SIZES,
    **PLAN_PARTS,
)
def _(spark, sf):
    plan = specs.coarse_plan(folds(spark, sf)).join(source_sizes(spark, sf), "fold_id")
    return plan.withColumn("n_values", F.size("c_values")).drop("c_values")


@query(
    "sel15_refinement_plan",
    """SELECT p.fold_id, p.train_start, p.train_end, p.n_targets, g.specification, round(best_c * 0.1, 6) AS low_c,
    round(best_c * 10, 6) AS high_c, 'refinement' AS stage, 'core' AS feature_set FROM fold_plan p
    CROSS JOIN (SELECT specification, arg_min(regularization_c, selection_brier) AS best_c FROM summary
      WHERE geography = 'none' GROUP BY 1) g""",
    **PLAN_PARTS,
    **WITH_SUMMARY,
)
def _(spark, sf):
    summary = aggregate.brier_summary(inputs.cells(spark, sf), validate=False)[1]
    plan = specs.refinement_plan(folds(spark, sf), summary)
    return plan.select(
        "*", F.get("c_values", F.lit(0)).alias("low_c"), F.get("c_values", F.lit(1)).alias("high_c")
    ).drop("c_values")


@query(
    "sel10_stage_decision",
    """SELECT specification, regularization_c, round(selection_brier, 6) AS selection_brier, n_cells,
    'raw_brier_equal_horizon_weight' AS selection_metric FROM summary
    ORDER BY summary.selection_brier, specification LIMIT 1""",
    **WITH_SUMMARY,
)
def _(spark, sf):
    """Coarse and refinement stages must not overlap and must fill their plan."""
    from ..workflows.selection import combine_stages

    cells = inputs.cells(spark, sf).persist()
    coarse = cells.where("regularization_c >= 1")
    refinement = cells.where("regularization_c < 1")
    combined = combine_stages(coarse, refinement, cells.select(*KEYS))
    return combined["decision"].select(
        "specification", "regularization_c", "selection_brier", "n_cells", "selection_metric"
    )


@query(
    "sel13_published_checks",
    f"""SELECT 'changed' AS problem, count(*) FILTER (horizon = 2) AS n FROM cells
    UNION ALL SELECT 'missing', count(*) FILTER (horizon >= 3) FROM cells
    UNION ALL SELECT 'duplicate', 0 FROM cells WHERE horizon = 1 HAVING count(*) > 0
    UNION ALL SELECT 'wrong_winner', 0 FROM cells WHERE horizon = 1 HAVING count(*) > 0""",
)
def _(spark, sf):
    from ..workflows.selection import published_problems

    cells = inputs.cells(spark, sf).persist()
    stored = cells.where("horizon < 3").withColumn(
        "brier_score",
        F.col("brier_score") + F.when(F.col("horizon") == 2, 0.001).otherwise(0.0),
    )
    return published_problems(cells, stored, KEYS, ["brier_score"])

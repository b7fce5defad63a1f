import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from labelshift.domain import Domain
from labelshift.models import logistic, persistence, trees
from labelshift.operators import features, metrics, weights
from labelshift.operators.weights import is_positive
from labelshift.plans.folds import Fold, fold_table
from labelshift.plans.specifications import BoostingParameters, FeatureSpec
from labelshift.workflows import reports, selection

LINEAR = FeatureSpec("linear", "none")
FOLD = Fold((2005, 2006), (2004,), "reverse")


def seeded(n, year, seed):
    """Labelled draws whose published scores the logistic family must match."""
    draw = np.random.default_rng(seed)
    columns = {"log_lti": draw.normal(size=n), "log_county_value_to_loan": draw.normal(size=n)}
    columns["purchaser_type"] = draw.integers(0, 10, size=n)
    columns["loan_type"] = draw.integers(1, 5, size=n)
    score = 0.85 * columns["log_lti"] - 0.35 * columns["log_county_value_to_loan"] - 1.7
    score += 0.12 * (columns["purchaser_type"] == 1) + 0.18 * (columns["loan_type"] == 2)
    columns["lien_status"] = 1 + (draw.random(n) < 1.0 / (1.0 + np.exp(-score)))
    return [
        (year, i, int(r[4]), float(r[0]), float(r[1]), int(r[2]), int(r[3]), 6)
        for i, r in enumerate(zip(*columns.values()))
    ]


@pytest.fixture(scope="module")
def sample(spark):
    rows = seeded(800, 2005, 17) + seeded(800, 2006, 29) + seeded(600, 2004, 41)
    return spark.createDataFrame(
        rows,
        "year int, id int, lien_status int, log_lti double, log_county_value_to_loan double,"
        " purchaser_type int, loan_type int, state_code int",
    ).persist()


@pytest.fixture(scope="module")
def fitted(sample):
    return logistic.fit_grid(sample, [FOLD], LINEAR, [0.1], variant="known_source_prior")[0]


def test_published_logistic_scores(sample, fitted):
    target = fitted.log_ratio(sample.where("year = 2004"))
    head = [r.log_ratio for r in target.orderBy("id").limit(5).collect()]
    expected = [-1.29157278, 0.01227075, -1.29477809, -0.07736976, -1.59695703]
    assert head == pytest.approx(expected, rel=1e-6)
    cell = metrics.evaluate_log_ratios(target, ["year"], is_positive()).first()
    assert cell.mixture_share == pytest.approx(0.22120957952512443, rel=1e-6)
    assert cell.brier_score == pytest.approx(0.13520568867330718, rel=1e-6)
    assert cell.mean_probability == pytest.approx(0.22120958002594743, rel=1e-6)
    assert cell.hard_share_050 == pytest.approx(0.07333333333333333)


@pytest.mark.parametrize(
    "spec",
    [
        FeatureSpec("linear", "both"),
        FeatureSpec("spline_both", "loan_type"),
        FeatureSpec("spline_lti", "purchaser_type_spline_lti"),
    ],
)
def test_grid_solver_equals_mllib(sample, spec):
    train = sample.where("year > 2004")
    model = logistic.fit_grid(train, [FOLD], spec, [0.5])[0]
    columns = features.feature_columns(spec, features.literal_parameters(model.parameters))
    frame = train.select(
        (F.col("lien_status") - 1).cast("double").alias("label"),
        array_to_vector(F.array(*columns.values())).alias("features"),
    )
    peer = LogisticRegression(
        regParam=1 / (0.5 * train.count()), standardization=False, tol=1e-12, maxIter=500
    ).fit(frame)
    assert model.converged
    assert model.intercept == pytest.approx(peer.intercept, abs=1e-4)
    assert list(model.coefficients) == pytest.approx(peer.coefficients.toArray(), abs=1e-4)


def test_feature_counts_and_names(sample):
    names = [t.name for t in features.feature_terms(FeatureSpec("linear", "both"))]
    assert len(names) == 38 == len(set(names))
    assert "purchaser_type_0" not in names and "loan_type_1" not in names
    names = [t.name for t in features.feature_terms(FeatureSpec("spline_lti", "purchaser_type_spline_lti"))]
    assert len(names) == 52
    assert "log_lti_rcs_3_x_purchaser_type_9" in names and "log_lti_x_purchaser_type_1" not in names
    assert "log_county_value_to_loan_x_purchaser_type_1" in names
    names = [t.name for t in features.feature_terms(FeatureSpec("linear", "none", "region"))]
    assert len(names) == 17 and "region_south" not in names and "region_west" in names


def test_grid_scores_equal_single_model_scores(sample):
    spec = FeatureSpec("spline_both", "both", "region")
    varied = sample.withColumn("state_code", F.when(F.col("id") % 2 == 0, 6).otherwise(36))
    folds = [FOLD, Fold((2004, 2005), (2006,), "forward")]
    models = logistic.fit_grid(varied, folds, spec, [0.1, 10.0])
    assert len(models) == 4 and all(m.converged for m in models)
    targets = selection.target_rows(varied, folds)
    grid = logistic.score_grid(targets, models)
    for model in models:
        part = grid.where(F.col("model_id") == model.model_id)
        again = model.log_ratio(part, "again")
        assert again.agg(F.max(F.abs(F.col("again") - F.col("log_ratio")))).first()[0] < 1e-9
    assert grid.count() == 2 * 600 + 2 * 800


def test_scaling_is_not_refitted(sample, fitted):
    shifted = sample.withColumn("log_lti", F.col("log_lti") + 10)
    columns = features.feature_columns(LINEAR, features.literal_parameters(fitted.parameters))
    assert shifted.agg(F.avg(columns["log_lti"])).first()[0] > 5


def test_cubic_basis_has_linear_tails(spark):
    frame = spark.createDataFrame([(3.0,), (4.0,), (5.0,)], "x double")
    terms = features.cubic_basis(F.col("x"), [F.lit(k) for k in (-2.0, -0.5, 0.5, 2.0)])
    rows = np.array(frame.select(*[t.alias(f"t{i}") for i, t in enumerate(terms)]).collect())
    assert np.diff(rows, n=2, axis=0) == pytest.approx(0.0, abs=1e-12)


def test_knots_are_exact_training_quantiles(sample):
    train = logistic.training_rows(sample, [FOLD])
    fit = features.fit_feature_parameters(train, FeatureSpec("spline_both", "none"))[FOLD.fold_id]
    values = [r.log_lti for r in train.select("log_lti").collect()]
    knots = [fit[name] for name in features.knot_names("log_lti")]
    assert knots == pytest.approx(np.quantile(values, features.SPLINE_QUANTILES))


def test_unusable_inputs_are_rejected(sample):
    bad = sample.withColumn("loan_type", F.when(F.col("id") == 3, 99).otherwise(F.col("loan_type")))
    with pytest.raises(ValueError, match="loan_type_unknown"):
        logistic.fit_grid(bad, [FOLD], LINEAR, [1.0])
    with pytest.raises(ValueError, match="no spread"):
        logistic.fit_grid(sample.withColumn("log_lti", F.lit(1.0)), [FOLD], LINEAR, [1.0])
    with pytest.raises(ValueError, match="coinciding"):
        tied = sample.withColumn("log_lti", F.when(F.col("id") == 1, 2.0).otherwise(1.0))
        logistic.fit_grid(tied, [FOLD], FeatureSpec("spline_lti", "none"), [1.0])
    with pytest.raises(ValueError, match="positive"):
        logistic.fit_grid(sample, [FOLD], LINEAR, [0.0])


def test_null_category_is_all_zero(sample, fitted):
    frame = sample.limit(1).withColumn("purchaser_type", F.lit(None).cast("int"))
    zero = sample.limit(1).withColumn("purchaser_type", F.lit(0))
    assert fitted.log_ratio(frame).first().log_ratio == pytest.approx(
        fitted.log_ratio(zero).first().log_ratio
    )


def test_equal_prior_weights(sample):
    weighted = weights.equal_prior_weights(sample)
    sums = weighted.groupBy("year", "lien_status").agg(F.sum("source_weight").alias("s")).collect()
    sizes = {r.year: r["count"] for r in sample.groupBy("year").count().collect()}
    for row in sums:
        assert row.s == pytest.approx(sizes[row.year] / 2)
    with pytest.raises(ValueError, match="both classes"):
        weights.equal_prior_weights(sample.where("lien_status = 1"))


def test_ratio_variants(sample):
    pooled = logistic.fit_grid(sample, [FOLD], LINEAR, [1.0], variant="pooled")[0]
    assert pooled.mean_ratio_first == pytest.approx(1.0)
    effects = logistic.fit_grid(sample, [FOLD], LINEAR, [1.0], variant="year_fixed_effect")[0]
    assert effects.mean_ratio_first == pytest.approx(1.0) and len(effects.year_effects) == 1
    table = reports.year_intercepts(sample, [effects]).collect()
    gaps = [r.normalization_gap for r in table]
    assert len(table) == 2 and max(gaps) - min(gaps) < 0.25
    with pytest.raises(ValueError, match="No logistic variant"):
        logistic.fit_grid(sample, [FOLD], LINEAR, [1.0], variant="other")


def test_stored_logistic_model(spark, sample, fitted, tmp_path):
    path = str(tmp_path / "model")
    persistence.save_logistic(spark, fitted, path, (1600, 1300, 300))
    restored = persistence.load_logistic(spark, path, fitted.model_id)
    row = persistence.load_metadata(spark, path).first()
    assert (row.source_prior, row.n_training, list(row.train_years)) == ("one_half", 1600, [2005, 2006])
    joined = restored.log_ratio(fitted.log_ratio(sample, "first"), "second")
    assert joined.agg(F.max(F.abs(F.col("first") - F.col("second")))).first()[0] < 1e-12
    with pytest.raises(ValueError, match="not the requested"):
        persistence.load_logistic(spark, path, "other")
    with pytest.raises(ValueError, match="sum to n_training"):
        persistence.save_logistic(spark, fitted, path, (10, 1, 1))


def test_tree_families(spark, sample, tmp_path):
    parameters = BoostingParameters(7, 0.1, 20, 1.0, 20)
    target = sample.where("year = 2004")
    boosted = trees.fit_boosting(sample, parameters, (2005, 2006))
    forest = trees.fit_forest(sample, (2005, 2006))
    assert forest.model_id == "random_forest__rf_50_depth_10__train_2005_2006"
    for model in (boosted, forest):
        scored = model.log_ratio(target)
        ranks = metrics.rank_metrics(
            scored.withColumn("probability", F.col("log_ratio")), ["year"], is_positive()
        ).first()
        assert ranks.roc_auc > 0.68
        again = model.log_ratio(target).agg(F.sum("log_ratio")).first()[0]
        assert again == pytest.approx(scored.agg(F.sum("log_ratio")).first()[0])
    path = str(tmp_path / "boosted")
    persistence.save_tree(spark, boosted, path, (1600, 1300, 300), ("a", "b"), {"leaves": 7})
    restored = persistence.load_tree(spark, path, boosted.model_id)
    assert restored.log_ratio(target).agg(F.sum("log_ratio")).first()[0] == pytest.approx(
        boosted.log_ratio(target).agg(F.sum("log_ratio")).first()[0]
    )
    with pytest.raises(ValueError, match="violate"):
        trees.fit_boosting(
            sample.withColumn("purchaser_type", F.lit(None).cast("int")), parameters, (2005, 2006)
        )


def test_class_probability_by_label(spark):
    frame = spark.createDataFrame([([0.25, 0.75],)], "p array<double>")
    picked = frame.select(
        trees.class_probability(F.col("p"), (2, 1), 2).alias("a"),
        trees.class_probability(F.col("p"), (1, 2), 2).alias("b"),
    ).first()
    assert tuple(picked) == (0.25, 0.75)
    with pytest.raises(ValueError, match="one of the classes"):
        trees.class_probability(F.col("p"), (1, 1), 2)


def test_resumed_search_equals_a_fresh_one(sample):
    folds = [FOLD, Fold((2004, 2005), (2006,), "forward")]
    candidates = {LINEAR: (0.01, 1.0)}
    whole = selection.evaluate_raw_grid(sample, folds, candidates)
    part = selection.evaluate_raw_grid(sample, folds[:1], {LINEAR: (0.01,)})
    assert selection.pending(LINEAR, (0.01, 1.0), folds, part) == {
        folds[0].fold_id: [1.0],
        folds[1].fold_id: [0.01, 1.0],
    }
    resumed = selection.evaluate_raw_grid(sample, folds, candidates, part)
    keys = ["model_id", "validation_year"]
    left = {tuple(r[k] for k in keys): r.brier_score for r in whole.collect()}
    right = {tuple(r[k] for k in keys): r.brier_score for r in resumed.collect()}
    assert left.keys() == right.keys() and resumed.count() == 4
    assert all(right[k] == pytest.approx(v, abs=1e-9) for k, v in left.items())
    assert selection.evaluate_raw_grid(sample, folds, candidates, whole).count() == 4


def test_historical_application_covers_unlabelled_years(sample):
    domain = Domain(first_labelled_year=2005)
    label = F.when(F.col("year") >= 2005, F.col("lien_status"))
    records = sample.withColumn("lien_status", label)
    tables = reports.run_historical_application(
        records, LINEAR, 0.1, (2005, 2006), (2004, 2005, 2006), before=2004, after=2005, domain=domain
    )
    rows = {r.year: r for r in tables["annual"].collect()}
    assert rows[2004].actual_second_share is None and rows[2005].actual_second_share > 0
    assert all(abs(r.mixture_mean_minus_share) < 1e-7 for r in rows.values())
    assert rows[2004].mixture_share == pytest.approx(0.22120957952512443, rel=1e-6)
    assert tables["continuity"].count() == 4
    crosswalk = reports.release_crosswalk(
        tables["records"].withColumns({"resp_id": F.col("id"), "seq_num": F.col("id")}), "v1"
    )
    assert crosswalk.count() == 2200 and crosswalk.where("prob_second_lien IS NULL").isEmpty()


def test_training_counts(sample):
    spoiled = sample.withColumn("lien_status", F.when(F.col("id") == 0, 9).otherwise(F.col("lien_status")))
    row = weights.training_counts(spoiled).first()
    assert row.n_training == 2200 and row.n_unknown == 3
    assert row.n_first + row.n_second + row.n_unknown == row.n_training


def test_fold_table_joins_each_record_per_fold(spark, sample):
    folds = [FOLD, Fold((2006,), (2004, 2005), "reverse")]
    table = fold_table(spark, folds)
    assert selection.join_targets(sample, table).count() == 600 + 600 + 800


def test_folds_of_very_different_size_converge(spark):
    from labelshift.models import newton
    from labelshift.operators.features import Term

    x = (F.pmod(F.col("id") * 7919, F.lit(1000)) - 500) / 250
    rows = spark.range(200_040).select(
        F.when(F.col("id") < 200_000, 0).otherwise(1).alias("fold_no"),
        F.when(F.pmod(F.col("id") * 31, F.lit(11)) < 4 + 3 * x, 1.0).otherwise(0.0).alias("y"),
        F.lit(1.0).alias("w"),
        x.alias("_f_1"),
    )
    design = newton.Design([Term("x", "x")], {})
    fits = newton.fit_ridge_grid(rows, design, {0: [1.0, 0.01], 1: [1.0]})
    assert [fit.n_training for fit in fits] == [200_000, 200_000, 40]
    assert all(fit.converged and not fit.failed for fit in fits)
    frame = rows.toPandas()
    for fit in fits:
        part = frame[frame.fold_no == fit.fold]
        mean = 1 / (1 + np.exp(-(fit.beta[0] + fit.beta[1] * part._f_1)))
        assert abs((part.y - mean).sum()) < 1e-5
        assert abs(((part.y - mean) * part._f_1).sum() - fit.beta[1] / fit.regularization_c) < 1e-5


def test_number_labels_agree_between_driver_and_records(spark):
    from labelshift.functions.expressions import number_label
    from labelshift.plans.specifications import label_number

    values = [0.0, 1.0, 10.0, 0.1, 2.5e-05, 3e-05, 1e-4, 1e-5, 0.05, 123456.123456789, 1e11, 1e12, 2.5e13, -0.5, 1 / 3, 1e-12]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    found = [r[0] for r in frame.select(number_label(F.col("v"))).collect()]
    assert found == [label_number(v) for v in values]

"""Rows that stand for many equal records, and places of values, against plain records."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelshift.domain import Domain
from labelshift.functions.places import with_place
from labelshift.models import cells, logistic, trees
from labelshift.operators import bins, metrics, mixture, quantiles, solvers
from labelshift.operators.features import column_parameters, feature_columns, join_parameters
from labelshift.plans.folds import Fold
from labelshift.plans.specifications import BoostingParameters, FeatureSpec
from labelshift.workflows import reports, selection

DOMAIN = Domain(first_labelled_year=2000, continuous=("x",), categories={"kind": (1, 2, 3)})
FOLDS = [Fold((2002, 2003), (2000, 2001), "reverse")]


def yes():
    return F.col("lien_status") == 2


@pytest.fixture(scope="module")
def scored(spark):
    draw = np.random.default_rng(4)
    rows = []
    for i in range(4000):
        value = float(np.round(draw.normal(), 1))
        rows.append((i % 3, 1 + int(draw.random() < 1 / (1 + np.exp(1 - value))), value))
    return spark.createDataFrame(rows, "cell int, lien_status int, log_ratio double").cache()


@pytest.fixture(scope="module")
def merged(scored):
    return scored.groupBy("cell", "lien_status", "log_ratio").agg(F.count(F.lit(1)).alias("n_records")).cache()


def same(left, right, keys):
    left, right = (table.orderBy(*keys).collect() for table in (left, right))
    assert len(left) == len(right) > 0
    for a, b in zip(left, right, strict=True):
        assert a.asDict() == pytest.approx(b.asDict(), abs=1e-9, nan_ok=True)


def test_counted_rows_give_the_metrics_of_their_records(scored, merged):
    options = {"weight": "n_records"}
    same(
        metrics.evaluate_log_ratios(scored, ["cell"], yes()),
        metrics.evaluate_log_ratios(merged, ["cell"], yes(), **options),
        ["cell"],
    )
    same(mixture.estimate_shares(scored, ["cell"]), mixture.estimate_shares(merged, ["cell"], **options), ["cell"])
    same(bins.tail_metrics(scored, ["cell"]), bins.tail_metrics(merged, ["cell"], **options), ["cell"])
    p = 1 / (1 + F.exp(-F.col("log_ratio")))
    first, second = scored.withColumn("probability", p), merged.withColumn("probability", p)
    same(
        metrics.evaluate_probabilities(first, ["cell"], yes()),
        metrics.evaluate_probabilities(second, ["cell"], yes(), **options),
        ["cell"],
    )
    same(
        bins.reliability_bins(first, ["cell"], yes()),
        bins.reliability_bins(second, ["cell"], yes(), **options),
        ["cell", "probability_bin"],
    )
    levels = [0.0, 0.031, 0.5, 0.77, 1.0]
    same(
        quantiles.exact_quantiles(scored, ["cell"], "log_ratio", levels, "q").select("cell", F.inline(F.arrays_zip("q"))),
        quantiles.counted_quantiles(merged, ["cell"], "log_ratio", "n_records", levels, "q").select(
            "cell", F.inline(F.arrays_zip("q"))
        ),
        ["cell", "q"],
    )


@pytest.fixture(scope="module")
def records(spark):
    draw = np.random.default_rng(9)
    rows = []
    for i in range(3000):
        x, kind = float(draw.normal()), int(draw.integers(1, 4))
        rows.append((2000 + i % 4, 1 + int(draw.random() < 1 / (1 + np.exp(1 - x))), x, kind))
    frame = spark.createDataFrame(rows, "year int, lien_status int, x double, kind int")
    return frame.withColumns({"loan_type": F.col("kind"), "purchaser_type": F.col("kind"), "state_code": F.lit(6)}).cache()


def test_tree_families_evaluate_counts_bounded_by_the_grid(records, monkeypatch):
    """What reaches the solvers is bounded by the grid, not by the records."""
    seen, real = [], metrics.solve

    def counting(rows, keys, solvers):
        seen.append(rows.count())
        return real(rows, keys, solvers)

    monkeypatch.setattr(metrics, "solve", counting)
    parameters = BoostingParameters(4, 0.1, 5, 1.0, 20)
    many = records
    for _ in range(3):
        many = many.unionByName(many)
    tables = [selection.evaluate_boosting_grid(frame, FOLDS, [parameters], domain=DOMAIN) for frame in (records, many)]
    assert max(seen) <= 2 * 2 * 64 * 3
    shares = [table.select("validation_year", "actual_second_share") for table in tables]
    same(*shares, ["validation_year"])
    seen.clear()
    report = reports.run_forest_comparison(many, FOLDS, DOMAIN)
    assert max(seen) <= 2 * 2 * 32 * 3
    assert report["metrics"].agg(F.sum("n_observations")).first()[0] == 8 * 1500
    assert report["bins"].agg(F.sum("n")).first()[0] == 8 * 1500


def test_boosting_cells_equal_those_of_the_records(records):
    parameters = BoostingParameters(4, 0.1, 5, 1.0, 20)
    rows = trees.boosted_log_ratios(
        records, selection.target_rows(records, FOLDS, DOMAIN), FOLDS, [parameters], domain=DOMAIN
    )
    expected = metrics.evaluate_log_ratios(rows, [*selection.FOLD_COLUMNS], yes())
    found = selection.evaluate_boosting_grid(records, FOLDS, [parameters], domain=DOMAIN)
    same(expected, found.select(*expected.columns), ["validation_year"])


@pytest.mark.parametrize("n_cuts", [0, 1, 6, 63, 255])
def test_places_count_the_cuts_passed(spark, n_cuts):
    cuts = sorted(np.random.default_rng(n_cuts).normal(0, 1, n_cuts).round(1).tolist())
    values = [-9.0, 0.0, 0.5, 9.0, *cuts]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    column = trees.cut_column(cuts)
    below = with_place(frame, F.col("v"), column, n_cuts, "n").collect()
    assert [r.n for r in below] == [sum(c < v for c in cuts) for v in values]
    at_most = with_place(frame, F.col("v"), column, n_cuts, "n", lambda cut, v: cut <= v).collect()
    assert [r.n for r in at_most] == [sum(c <= v for c in cuts) for v in values]


def test_a_cell_is_null_where_an_input_or_level_is_missing(spark):
    frame = spark.createDataFrame([(0.5, 1), (None, 1), (0.5, 9), (0.5, None), (-3.0, 3)], "x double, kind int")
    grid = cells.make_grid(4, "core", DOMAIN)
    found = grid.with_cell(frame, [trees.cut_column([-1.0, 0.0, 1.0])], "cell")
    assert [r.cell for r in found.collect()] == [2 * 3, None, None, None, 2]
    assert found.columns == ["x", "kind", "cell"]


def test_scores_by_factors_and_levels_are_the_sums_over_features(spark, records):
    """The predictor has a term for each factor; the plain sum over all features is the same."""
    spec = FeatureSpec("linear", "none")
    models = logistic.fit_grid(records, FOLDS, spec, (0.1, 1.0), domain=DOMAIN)
    unknown = spark.createDataFrame([(2000, 1, 0.3, 7), (2000, 1, 0.3, None)], "year int, lien_status int, x double, kind int")
    rows = records.select(*unknown.columns).unionByName(unknown).withColumn("fold_id", F.lit(FOLDS[0].fold_id))
    found = logistic.score_grid(rows, models, domain=DOMAIN)
    for model in models:
        joined = join_parameters(rows, {model.fold_id: model.parameters})
        plain = F.lit(model.intercept)
        for weight, column in zip(
            model.coefficients, feature_columns(spec, column_parameters(), DOMAIN).values(), strict=True
        ):
            plain = plain + F.lit(weight) * column
        expected = joined.agg(F.sum(plain), F.count(plain)).first()
        own = found.where(F.col("model_id") == model.model_id).agg(F.sum("log_ratio"), F.count("log_ratio")).first()
        single = model.log_ratio(rows).agg(F.sum("log_ratio"), F.count("log_ratio")).first()
        assert tuple(own) == pytest.approx(tuple(expected)) and tuple(single) == pytest.approx(tuple(expected))


def test_solvers_that_start_from_counts_end_on_the_records(spark, monkeypatch):
    draw = np.random.default_rng(11)
    rows = []
    for cell, shift in enumerate((-1.2, 0.0, 0.3)):
        value = draw.normal(shift, 1.0, 3000)
        second = draw.random(3000) < 1 / (1 + np.exp(0.4 - 0.8 * value))
        rows += zip([cell] * 3000, map(int, 1 + second), map(float, value), strict=True)
    scored = spark.createDataFrame(rows, "cell int, lien_status int, log_ratio double").cache()
    steps = []
    written_with = solvers.written_with
    monkeypatch.setattr(solvers, "written_with", lambda *given: steps.append(1) or written_with(*given))
    plain = metrics.evaluate_log_ratios(scored, ["cell"], yes()).orderBy("cell").collect()
    before = len(steps)
    monkeypatch.setattr(metrics, "START_RECORDS", 1)
    started = metrics.evaluate_log_ratios(scored, ["cell"], yes()).orderBy("cell").collect()
    assert len(steps) - before <= 3 < before
    assert len(plain) == len(started) == 3 and any(row.mixture_at_boundary for row in plain)
    for a, b in zip(plain, started, strict=True):
        a, b = a.asDict(), b.asDict()
        assert a.pop("optimizer_iterations") >= b.pop("optimizer_iterations")
        assert b == pytest.approx(a, abs=1e-8)


def test_starts_of_cells_without_a_fit_and_beyond_the_intervals(spark):
    rows = [(0, float(i > 50), -1.0 if i <= 50 else 1.0) for i in range(100)]  # parted by the label: no fit
    rows += [(1, float(i % 2), 900.0 * (-1) ** (i // 2)) for i in range(100)]
    rows += [(2, float(i % 2), float("nan")) for i in range(100)]
    rows += [(None, float(i % 4 == 0), -3.0) for i in range(100)]
    frame = spark.createDataFrame(rows, "cell int, y double, log_ratio double")
    found = {r.cell: r for r in solvers.counted_starts(frame, ["cell"], "log_ratio", "y").collect()}
    assert len(found) == 4
    assert all(np.isfinite([r.mixture_share, r._c0, r._c1]).all() for r in found.values())
    assert found[0]._c1 == found[None]._c1 == 0.0
    assert found[1].mixture_share == pytest.approx(0.5)
    assert found[None].mixture_share == solvers.SHARE_BOUND
    assert found[None]._c0 == pytest.approx(np.log(1 / 3))


def test_starts_refuse_values_that_are_no_numbers(spark, monkeypatch):
    monkeypatch.setattr(metrics, "START_RECORDS", 1)
    rows = [(0, 1, 0.5), (0, 2, float("nan")), (0, 2, 0.1), (0, 1, None)]
    scored = spark.createDataFrame(rows, "cell int, lien_status int, log_ratio double")
    with pytest.raises(ValueError, match="non-finite"):
        metrics.evaluate_log_ratios(scored, ["cell"], yes())


def test_pooled_variant_is_the_raw_fit_and_is_not_fitted_again(records, monkeypatch):
    spec = FeatureSpec("linear", "none")
    raw = logistic.fit_grid(records, FOLDS, spec, [0.1], domain=DOMAIN)
    fitted = logistic.fit_grid(records, FOLDS, spec, [0.1], variant="pooled", domain=DOMAIN)[0]
    scored = fitted.log_ratio(records.where("year in (2002, 2003)")).toPandas()
    ratio = scored["log_ratio"].to_numpy()
    first = (scored["lien_status"] == 1).to_numpy()
    assert np.exp(ratio[first]).mean() == pytest.approx(fitted.mean_ratio_first, rel=1e-10)
    assert np.exp(-ratio[~first]).mean() == pytest.approx(fitted.mean_inverse_ratio_second, rel=1e-10)
    fits = []
    fit_ridge_grid = logistic.fit_ridge_grid
    monkeypatch.setattr(logistic, "fit_ridge_grid", lambda *given, **near: fits.append(1) or fit_ridge_grid(*given, **near))
    pooled = logistic.pooled_models(raw, records, FOLDS, DOMAIN)[0]
    assert not fits and pooled.model_id == fitted.model_id
    assert pooled.coefficients == pytest.approx(fitted.coefficients, rel=1e-9)
    assert pooled.intercept == pytest.approx(fitted.intercept, rel=1e-9)
    reports.run_mixture_validation(records, FOLDS, spec, 0.1, DOMAIN)
    assert len(fits) == 3  # raw, year effects and known prior


@pytest.mark.parametrize("variant", ["year_fixed_effect", "known_source_prior"])
def test_fits_that_begin_at_the_raw_model_end_where_others_do(records, variant):
    spec, fit = FeatureSpec("linear", "none"), {"variant": variant, "ratio_means": False, "domain": DOMAIN}
    raw = logistic.fit_grid(records, FOLDS, spec, [0.1], domain=DOMAIN)
    cold = logistic.fit_grid(records, FOLDS, spec, [0.1], **fit)[0]
    warm = logistic.fit_grid(records, FOLDS, spec, [0.1], near=raw, **fit)[0]
    assert warm.converged and warm.n_training == cold.n_training
    assert warm.n_iter < cold.n_iter or variant == "known_source_prior"
    assert warm.raw_intercept == pytest.approx(cold.raw_intercept, abs=1e-9)
    assert warm.coefficients == pytest.approx(cold.coefficients, abs=1e-9)
    assert warm.year_effects == pytest.approx(cold.year_effects, abs=1e-9)

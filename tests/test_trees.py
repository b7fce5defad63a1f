"""Tree families on class sums of cells, against slow versions in plain Python."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelshift.domain import Domain
from labelshift.models import boosting, cells, forest, trees
from labelshift.plans.folds import Fold
from labelshift.plans.specifications import BoostingParameters
from labelshift.workflows import selection

DOMAIN = Domain(
    continuous=("x",), restricted_continuous=("x",), categories={"kind": (1, 2, 3, 4)}, first_labelled_year=2000
)
GRID = cells.make_grid(5, "core", DOMAIN)
PARAMETERS = BoostingParameters(4, 0.3, 3, 1.0, 10)


def random_cells(seed):
    random = np.random.default_rng(seed)
    n = random.integers(0, 30, GRID.n_cells).astype(float)
    share = random.beta(2, 2, GRID.n_cells)
    positive = n * share
    return boosting.Cells(GRID.codes(np.arange(GRID.n_cells)), n, positive, n - positive)


def slow_boost(own, parameters, rounds):
    """All leaves, all features and all cuts in loops."""
    l2, least = parameters.l2_regularization, parameters.min_samples_leaf
    w = own.positive + own.negative
    score = [float(np.log(own.positive.sum() / own.negative.sum()))] * len(w)
    for _ in range(rounds):
        p = [1 / (1 + np.exp(-s)) for s in score]
        g = [w[i] * p[i] - own.positive[i] for i in range(len(w))]
        h = [w[i] * p[i] * (1 - p[i]) for i in range(len(w))]
        leaves = [list(range(len(w)))]

        def sums(members):
            return sum(own.n[i] for i in members), sum(g[i] for i in members), sum(h[i] for i in members)

        while len(leaves) < parameters.max_leaf_nodes:
            options = []
            for at, leaf in enumerate(leaves):
                _, big_g, big_h = sums(leaf)
                for feature, size in enumerate(GRID.sizes):
                    codes = list(range(size))
                    by_code = {c: [i for i in leaf if own.codes[i, feature] == c] for c in codes}
                    if feature == 1:
                        codes = [c for c in codes if sums(by_code[c])[0] > 0]
                        codes.sort(key=lambda c: sums(by_code[c])[1] / (sums(by_code[c])[2] + l2 + 1e-3))
                    for cut in range(1, len(codes)):
                        left = [i for c in codes[:cut] for i in by_code[c]]
                        right = [i for i in leaf if i not in set(left)]
                        ln, lg, lh = sums(left)
                        rn, rg, rh = sums(right)
                        if min(ln, rn) >= least and min(lh, rh) >= 1e-3:
                            gain = lg**2 / (lh + l2) + rg**2 / (rh + l2) - big_g**2 / (big_h + l2)
                            options.append((gain, at, left, right))
            best = max(options, key=lambda option: option[0], default=None)
            if best is None or best[0] <= 1e-12:
                break
            _, at, left, right = best
            leaves[at : at + 1] = [left, right]
        for leaf in leaves:
            _, big_g, big_h = sums(leaf)
            for i in leaf:
                score[i] -= parameters.learning_rate * big_g / (big_h + l2)
    return np.array(score)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("l2", [0.0, 10.0])
def test_boosting_equals_a_slow_version(seed, l2):
    own, parameters = random_cells(seed), replace(PARAMETERS, l2_regularization=l2)
    found = boosting.boost(GRID, own, parameters, [1, 3])
    assert found[1] == pytest.approx(slow_boost(own, parameters, 1), abs=1e-9)
    assert found[3] == pytest.approx(slow_boost(own, parameters, 3), abs=1e-9)


def test_parameters_change_the_fit():
    own = random_cells(9)

    def fit(**changes):
        return boosting.boost(GRID, own, replace(PARAMETERS, **changes), [3])[3]

    base = fit()
    for change in ({"l2_regularization": 0.0}, {"max_leaf_nodes": 7}, {"learning_rate": 0.1}, {"min_samples_leaf": 60}):
        assert np.abs(fit(**change) - base).max() > 1e-4
    assert len(list(boosting.grow(GRID, own, *gradients(own), PARAMETERS))) == 4


def gradients(own):
    w = own.positive + own.negative
    p = own.positive.sum() / w.sum()
    return w * p - own.positive, w * p * (1 - p)


def test_a_fit_without_records_on_one_side_keeps_one_leaf():
    own = random_cells(2)
    parameters = replace(PARAMETERS, min_samples_leaf=10_000)
    ((members, value),) = boosting.grow(GRID, own, *gradients(own), parameters)
    assert len(members) == GRID.n_cells and abs(value) < 1e-12
    with pytest.raises(ValueError, match="both classes"):
        boosting.boost(GRID, own._replace(positive=own.n * 0), parameters, [1])


def test_forest_tree_with_all_features_is_pure_where_depth_allows(monkeypatch):
    codes = GRID.codes(np.arange(GRID.n_cells))
    positive = ((codes[:, 0] > 2) ^ (codes[:, 1] == 1)).astype(float)
    monkeypatch.setattr(forest.math, "sqrt", lambda n: n)
    share = forest.gini_tree(GRID, codes, positive * 5, (1 - positive) * 5, 4, np.random.default_rng(1))
    assert share == pytest.approx(positive)
    root = forest.gini_tree(GRID, codes, positive * 5, (1 - positive) * 5, 0, np.random.default_rng(1))
    assert root == pytest.approx(positive.mean())


@pytest.mark.parametrize("n_cuts", [0, 1, 7, 63])
def test_intervals_count_the_cuts_below(spark, n_cuts):
    cuts = sorted(np.random.default_rng(n_cuts).normal(0, 1, n_cuts).tolist())
    values = [-9.0, 0.0, 0.5, 9.0, *cuts, *[c + 1e-9 for c in cuts]]
    frame = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    found = [r[0] for r in frame.select(cells.interval(F.col("v"), trees.cut_column(cuts), 64)).collect()]
    assert found == [sum(c < v for c in cuts) for v in values] + [None]


@pytest.fixture(scope="module")
def records(spark):
    random = np.random.default_rng(3)
    rows = []
    for i in range(1500):
        x, kind = float(random.normal()), int(random.integers(1, 5))
        odds = 1.5 * x * (1 if kind < 3 else -1) + (kind == 2) - 1
        rows.append((2000 + i % 5, 1 + int(random.random() < 1 / (1 + np.exp(-odds))), x, kind))
    frame = spark.createDataFrame(rows, "year int, lien_status int, x double, kind int").repartition(3)
    return frame.withColumns({"loan_type": F.col("kind"), "purchaser_type": F.col("kind"), "state_code": F.lit(6)}).cache()


FOLDS = [Fold((2002, 2003), (2000, 2001), "reverse"), Fold((2003, 2004), (2000, 2001, 2002), "reverse")]


def test_models_of_a_search_are_the_single_fits(spark, records):
    candidates = [replace(PARAMETERS, max_iter=5), replace(PARAMETERS, max_iter=9)]
    targets = selection.target_rows(records, FOLDS, DOMAIN)
    searched = trees.boosted_log_ratios(records, targets, FOLDS, candidates, domain=DOMAIN, bins=8).cache()
    assert searched.count() == 2 * targets.count()
    for p in candidates:
        model = trees.fit_boosting(records, p, FOLDS[1].train_years, domain=DOMAIN, bins=8)
        single = model.log_ratio(records.where("year < 2003")).agg(F.sum("log_ratio")).first()[0]
        part = searched.where((F.col("fold_id") == FOLDS[1].fold_id) & (F.col("parameter_id") == p.identifier))
        assert part.agg(F.sum("log_ratio")).first()[0] == pytest.approx(single)
    unknown = spark.createDataFrame([(0.0, 9), (None, 1)], "x double, kind int")
    assert [r.log_ratio for r in model.log_ratio(unknown).collect()] == [None, None]


def test_a_finished_run_fits_nothing_again(records, tmp_path, monkeypatch):
    configurations = [
        {"family": "hist_gradient_boosting", "specification": "core", "parameters": replace(PARAMETERS, max_iter=4)},
        {"family": "random_forest", "specification": "one_hot_categories"},
    ]
    fits = []

    def counted(name):
        real = getattr(selection, name)
        return lambda *args, **options: fits.append(name) or real(*args, **options)

    for name in ("boosted_log_ratios", "fit_forest", "fit_grid"):
        monkeypatch.setattr(selection, name, counted(name))
    store = str(tmp_path / "cells")
    first = selection.run_grid(records, FOLDS[:1], configurations[:1], DOMAIN, store)
    assert first.count() == 2 and fits == ["boosted_log_ratios"]
    both = selection.run_grid(records, FOLDS, configurations, DOMAIN, store)
    assert both.count() == 2 * 5 and fits == ["boosted_log_ratios"] * 2 + ["fit_forest"] * 2
    again = selection.run_grid(records, FOLDS, configurations, DOMAIN, store)
    assert again.count() == 10 and len(fits) == 4
    with pytest.raises(ValueError, match="Unknown density-ratio family"):
        selection.run_grid(records, FOLDS, [{"family": "other", "specification": "core"}], DOMAIN, store)


def test_challenger_refits_its_winner_and_diagnoses_it(records):
    structures = [replace(PARAMETERS, max_iter=5), replace(PARAMETERS, max_leaf_nodes=2, max_iter=5)]
    outputs = selection.run_boosting_challenger(
        records,
        FOLDS,
        (2000, 2001),
        (2002, 2003, 2004),
        structures=structures,
        refinements=lambda best: [replace(best, max_iter=8), replace(best, l2_regularization=0.0)],
        domain=DOMAIN,
    )
    assert outputs["summary"].count() == 4
    best = outputs["decision"].first().parameter_id
    assert outputs["model"].model_id == f"boosting__{best}__train_2000_2001"
    tables = outputs["diagnostics"]
    assert tables["metrics"].count() == 5 + 3
    assert tables["forward_summary"].count() > 0 and tables["ratio_tails"].count() == 8
    assert tables["bins"].where("validation_year = 2004").count() > 1

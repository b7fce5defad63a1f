"""Selection searches over temporal folds.

Fits are distributed and all penalties and folds of a specification share
their scans. Only cell tables, bounded by the plan, are brought to the driver;
each is turned back into a small DataFrame so later stages do not recompute it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..domain import DEFAULT, Domain
from ..functions.expressions import expit, indicator
from ..functions.local import freeze, small_table
from ..functions.storage import written
from ..models.logistic import coefficient_table, fit_grid, fit_model, score_grid
from ..models.trees import RECORDS, boosted_log_ratios, fit_boosting, fit_forest
from ..operators import aggregate, results
from ..operators.clean import geographic_support
from ..operators.metrics import evaluate_log_ratios
from ..operators.mixture import adjust_cells, estimate_shares
from ..operators.weights import is_positive
from ..plans.folds import Fold, fold_table, forward_fold, join_targets
from ..plans.specifications import (
    BOOSTING_SURVIVORS,
    COARSE_C,
    SCREEN_SURVIVORS,
    SPLINE_INTERACTION,
    BoostingParameters,
    FeatureSpec,
    boosting_refinements,
    candidate_specifications,
    core_specifications,
    label_number,
    parse_specification,
    refinement_values,
    structure_grid,
)
from ..sources.loans import path_exists

FOLD_COLUMNS = ("fold_id", "train_start", "train_end", "validation_year", "horizon")
CELL_KEYS = ("specification", "regularization_c", "train_start", "validation_year")
BOOSTING_KEYS = ("parameter_id", "train_start", "validation_year")


def target_rows(records: DataFrame, folds: Sequence[Fold], domain: Domain = DEFAULT) -> DataFrame:
    """Labelled target records of every fold."""
    labelled = records.where(F.col(domain.label).isNotNull())
    return join_targets(labelled, fold_table(records.sparkSession, folds)).drop("direction")


def pending(
    spec: FeatureSpec, c_values: Sequence[float], folds: Sequence[Fold], done: DataFrame | None
) -> dict[str, list[float]]:
    """Penalties per fold that still miss a target cell."""
    if done is None:
        return {fold.fold_id: list(c_values) for fold in folds}
    rows = done.where(F.col("specification") == spec.name).select(*CELL_KEYS).collect()
    remaining = {}
    for fold in folds:
        held = [
            c
            for c in c_values
            if not all(
                any(
                    abs(row.regularization_c - c) <= 1e-8 + 1e-5 * abs(c)
                    and row.train_start == fold.train_start
                    and row.validation_year == year
                    for row in rows
                )
                for year in fold.target_years
            )
        ]
        if held:
            remaining[fold.fold_id] = held
    return remaining


def _grid(records, folds, candidates, done, variant, evaluate, domain) -> DataFrame:
    """Fit specification by specification, then evaluate all scores together."""
    targets = target_rows(records, folds, domain)
    scored, facts = None, []
    for spec, c_values in candidates.items():
        remaining = pending(spec, list(c_values), folds, done)
        if not remaining:
            continue
        models = fit_grid(
            records, folds, spec, remaining, variant=variant, ratio_means=False, domain=domain
        )
        part = score_grid(targets, models, domain=domain).select(
            "model_id", "regularization_c", *FOLD_COLUMNS, domain.label, "log_ratio"
        )
        scored = part if scored is None else scored.unionByName(part)
        facts.extend(
            (
                m.model_id,
                spec.name,
                spec.continuous_form,
                spec.interactions,
                spec.geography or "none",
                m.n_iter,
                m.converged,
            )
            for m in models
        )
    if scored is None:
        return done
    described = small_table(
        records.sparkSession,
        facts,
        "model_id string, specification string, continuous_form string, interactions string,"
        " geography string, n_iter int, converged boolean",
    )
    fresh = freeze(evaluate(scored).join(F.broadcast(described), "model_id"))
    return fresh if done is None else done.unionByName(fresh)


def evaluate_raw_grid(
    records: DataFrame,
    folds: Sequence[Fold],
    candidates: Mapping[FeatureSpec, Sequence[float]],
    done: DataFrame | None = None,
    domain: Domain = DEFAULT,
) -> DataFrame:
    """Brier cells of raw logistic candidates; finished cells are kept."""
    y, p = indicator(is_positive(domain)), expit(F.col("log_ratio"))

    def evaluate(scored: DataFrame) -> DataFrame:
        return scored.groupBy("model_id", "regularization_c", *FOLD_COLUMNS).agg(
            F.count(F.lit(1)).alias("n_validation"),
            F.avg((p - y) * (p - y)).alias("brier_score"),
            F.avg(y).alias("observed_second_share"),
            F.avg(p).alias("mean_predicted_second_share"),
        )

    return _grid(records, folds, candidates, done, "raw", evaluate, domain)


def evaluate_mixture_grid(
    records: DataFrame,
    folds: Sequence[Fold],
    candidates: Mapping[FeatureSpec, Sequence[float]],
    done: DataFrame | None = None,
    domain: Domain = DEFAULT,
) -> DataFrame:
    """Adjusted cells of equal-prior logistic candidates."""

    def evaluate(scored: DataFrame) -> DataFrame:
        keys = ["model_id", "regularization_c", *FOLD_COLUMNS]
        cells = evaluate_log_ratios(scored, keys, is_positive(domain))
        return cells.withColumn(
            "mixture_share_error", F.col("mixture_share") - F.col("actual_second_share")
        )

    return _grid(records, folds, candidates, done, "known_source_prior", evaluate, domain)


def best_c_by_specification(summary: DataFrame) -> dict[str, float]:
    best = results.best_rows(summary, ["specification"], ["selection_brier", "regularization_c"])
    return {row.specification: row.regularization_c for row in best.collect()}


def refine(summary: DataFrame, specs: Sequence[FeatureSpec]) -> dict[FeatureSpec, tuple]:
    best = best_c_by_specification(summary)
    return {spec: refinement_values(best[spec.name]) for spec in specs}


def combine_stages(
    coarse: DataFrame,
    refinement: DataFrame,
    plan: DataFrame | None = None,
    keys: Sequence[str] = CELL_KEYS,
) -> dict[str, DataFrame]:
    """Union two stages that must be disjoint and complete, and decide."""
    cells = results.union_distinct([coarse, refinement], keys)
    if plan is not None:
        results.require_plan(plan.select(*keys), cells, keys)
    horizons, summary = aggregate.brier_summary(cells, validate=False)
    facts = {"selection_metric": "raw_brier_equal_horizon_weight"}
    decision = results.decision_row(summary, ["specification", "regularization_c"], facts)
    return {"cells": cells, "horizons": horizons, "summary": summary, "decision": decision}


def _search(records, folds, specs, coarse_c, domain, done=None) -> dict[str, DataFrame]:
    coarse = evaluate_raw_grid(records, folds, {spec: coarse_c for spec in specs}, done, domain)
    summary = aggregate.brier_summary(coarse)[1]
    refined = evaluate_raw_grid(records, folds, refine(summary, specs), None, domain)
    return combine_stages(coarse, refined)


def run_raw_selection(
    records: DataFrame,
    folds: Sequence[Fold],
    train_years: Sequence[int],
    *,
    specifications: Sequence[FeatureSpec] | None = None,
    coarse_c: Sequence[float] = COARSE_C,
    done: DataFrame | None = None,
    domain: Domain = DEFAULT,
) -> dict[str, object]:
    """Coarse search, refinement, decision and the final refit."""
    specs = list(specifications or core_specifications())
    outputs: dict[str, object] = _search(records, folds, specs, coarse_c, domain, done)
    winner = outputs["decision"].first()
    outputs["model"] = fit_model(
        records,
        parse_specification(winner.specification),
        winner.regularization_c,
        train_years,
        domain=domain,
    )
    return outputs


def run_geographic_challengers(
    records: DataFrame,
    folds: Sequence[Fold],
    core_cells: DataFrame,
    selected: FeatureSpec,
    selected_c: float,
    *,
    coarse_c: Sequence[float] = COARSE_C,
    domain: Domain = DEFAULT,
) -> dict[str, DataFrame]:
    """Region and state variants of the winner; reported, never selected."""
    specs = [
        FeatureSpec(selected.continuous_form, selected.interactions, name, selected.feature_set)
        for name in ("region", "state")
    ]
    outputs = _search(records, folds, specs, coarse_c, domain)
    core = results.select_candidate(core_cells, F.lit(selected.name), F.lit(selected_c))
    best = best_c_by_specification(outputs["summary"])
    outputs["increment"] = results.geographic_increment(core, outputs["cells"], outputs["summary"])
    outputs["support"] = geographic_support(records, domain)
    outputs["coefficients"] = coefficient_stability(
        records, folds, {spec: best[spec.name] for spec in specs}, domain
    )
    return outputs


def coefficient_stability(
    records: DataFrame,
    folds: Sequence[Fold],
    candidates: Mapping[FeatureSpec, float],
    domain: Domain = DEFAULT,
) -> DataFrame:
    """Coefficients of each candidate on every training window."""
    models = []
    for spec, c in candidates.items():
        models.extend(fit_grid(records, folds, spec, [c], domain=domain))
    return coefficient_table(records.sparkSession, models)


def run_spline_challenger(
    records: DataFrame,
    folds: Sequence[Fold],
    core_cells: DataFrame,
    selected: FeatureSpec,
    selected_c: float,
    *,
    coarse_c: Sequence[float] = COARSE_C,
    domain: Domain = DEFAULT,
) -> dict[str, DataFrame]:
    """Category-specific spline shapes against the chosen core."""
    challenger = FeatureSpec("spline_lti", SPLINE_INTERACTION, feature_set=selected.feature_set)
    outputs = _search(records, folds, [challenger], coarse_c, domain)
    winner = outputs["decision"].first()
    core = results.select_candidate(core_cells, F.lit(selected.name), F.lit(selected_c))
    best = results.select_candidate(
        outputs["cells"], F.lit(winner.specification), F.lit(winner.regularization_c)
    )
    compared = results.challenger_cells(core, best, "challenger_brier")
    outputs["comparison_cells"] = compared
    outputs["comparison"] = results.challenger_summary(compared).withColumns(
        {
            "core_specification": F.lit(selected.name),
            "challenger_specification": F.lit(winner.specification),
            "challenger_c": F.lit(winner.regularization_c),
        }
    )
    return outputs


def run_mixture_selection(
    records: DataFrame,
    folds: Sequence[Fold],
    incumbent: FeatureSpec,
    train_years: Sequence[int],
    forward_years: Sequence[int],
    *,
    specifications: Sequence[FeatureSpec] | None = None,
    coarse_c: Sequence[float] = COARSE_C,
    n_survivors: int = SCREEN_SURVIVORS,
    domain: Domain = DEFAULT,
) -> dict[str, object]:
    """Screen on the latest fold, survivors on all, refine, decide, check forward."""
    specs = list(specifications or candidate_specifications())
    latest = max(folds, key=lambda fold: fold.train_start)
    screen = evaluate_mixture_grid(
        records, [latest], {spec: coarse_c for spec in specs}, domain=domain
    )
    screen_summary = aggregate.mixture_summary(screen)[1]
    survivors = results.screen_survivors(screen_summary, incumbent.name, n_survivors)
    survivor_rows = survivors.collect()
    kept = [parse_specification(row.specification) for row in survivor_rows]
    done = screen.where(F.col("specification").isin(*[spec.name for spec in kept]))
    coarse = evaluate_mixture_grid(
        records, folds, {spec: coarse_c for spec in kept}, done, domain
    )
    coarse = results.best_rows(coarse, CELL_KEYS, ["model_id"])
    refined = refine(aggregate.mixture_summary(coarse)[1], kept)
    cells = coarse.unionByName(evaluate_mixture_grid(records, folds, refined, domain=domain))
    horizons, summary = aggregate.mixture_summary(cells)
    facts = {
        "n_screen_specifications": len(specs),
        "n_survivors": len(kept),
        "incumbent_specification": incumbent.name,
        "selection_metric": "mixture_adjusted_brier_equal_horizon_weight",
    }
    decision = results.decision_row(summary, ["specification", "regularization_c"], facts)
    winner = decision.first()
    model = fit_model(
        records,
        parse_specification(winner.specification),
        winner.regularization_c,
        train_years,
        variant="known_source_prior",
        domain=domain,
    )
    forward = evaluate_forward(records, model, forward_years, domain)
    return {
        "screen_summary": screen_summary,
        "survivors": survivors,
        "cells": cells,
        "horizons": horizons,
        "summary": summary,
        "decision": decision,
        "model": model,
        "forward_metrics": forward,
    }


def evaluate_forward(
    records: DataFrame, model, target_years: Sequence[int], domain: Domain = DEFAULT
) -> DataFrame:
    """One frozen model on every later labelled year."""
    fold = forward_fold(model.train_years, sorted(target_years))
    scored = model.log_ratio(target_rows(records, [fold], domain))
    cells = evaluate_log_ratios(scored, FOLD_COLUMNS, is_positive(domain))
    return cells.withColumn("model_id", F.lit(model.model_id))


# -- tree families -----------------------------------------------------------


def evaluate_boosting_grid(
    records: DataFrame,
    folds: Sequence[Fold],
    candidates: Sequence[BoostingParameters],
    *,
    feature_set: str = "core",
    done: DataFrame | None = None,
    domain: Domain = DEFAULT,
) -> DataFrame:
    """Adjusted cells of boosting candidates.

    Records are reduced to class sums of cells once a fold; each fold and structure is then a fit in
    a task of its own, and candidates that differ in their rounds share one. Target records are counted
    by cell too, so fits and metrics run on tables that the grid bounds.
    """
    held = set()
    if done is not None:
        held = {(row.parameter_id, row.train_start) for row in done.select(*BOOSTING_KEYS).collect()}
    # Folds that lack the same candidates are fitted and scored together.
    lacking: dict[tuple[BoostingParameters, ...], list[Fold]] = {}
    for fold in folds:
        rest = tuple(p for p in candidates if (p.identifier, fold.train_start) not in held)
        if rest:
            lacking.setdefault(rest, []).append(fold)
    if not lacking:
        return done
    scored, spark = None, records.sparkSession
    for rest, own in lacking.items():
        part = boosted_log_ratios(
            records,
            target_rows(records, own, domain),
            own,
            rest,
            feature_set=feature_set,
            domain=domain,
            counted=[*FOLD_COLUMNS, domain.label],
        ).select("parameter_id", *FOLD_COLUMNS, domain.label, "log_ratio", RECORDS)
        scored = part if scored is None else scored.unionByName(part)
    cells = evaluate_log_ratios(
        written(scored), ["parameter_id", *FOLD_COLUMNS], is_positive(domain), weight=RECORDS
    )
    rows = [
        (
            p.identifier,
            p.max_leaf_nodes,
            float(p.learning_rate),
            p.max_iter,
            float(p.l2_regularization),
            p.min_samples_leaf,
        )
        for p in candidates
    ]
    names = small_table(
        spark,
        rows,
        "parameter_id string, max_leaf_nodes int, learning_rate double, max_iter int,"
        " l2_regularization double, min_samples_leaf int",
    )
    named = cells.join(F.broadcast(names), "parameter_id").withColumns(
        {
            "mixture_share_error": F.col("mixture_share") - F.col("actual_second_share"),
            "adjusted_brier": F.col("brier_score"),
        }
    )
    fresh = freeze(named)
    return fresh if done is None else done.unionByName(fresh)


def run_boosting_challenger(
    records: DataFrame,
    folds: Sequence[Fold],
    train_years: Sequence[int],
    forward_years: Sequence[int],
    *,
    structures: Sequence[BoostingParameters] | None = None,
    refinements=boosting_refinements,
    n_survivors: int = BOOSTING_SURVIVORS,
    feature_set: str = "core",
    domain: Domain = DEFAULT,
) -> dict[str, object]:
    """Structure screen on the latest fold, survivors, refinement, decision, refit and diagnostics."""
    grid = list(structures or structure_grid())
    by_id = {p.identifier: p for p in grid}
    latest = max(folds, key=lambda fold: fold.train_start)
    options = {"feature_set": feature_set, "domain": domain}
    screen = evaluate_boosting_grid(records, [latest], grid, **options)
    screen_summary = aggregate.boosting_summary(screen)[1]
    top = results.top_candidates(screen_summary, n_survivors, "parameter_id").collect()
    survivors = [by_id[row.parameter_id] for row in top]
    done = screen.where(F.col("parameter_id").isin(*[p.identifier for p in survivors]))
    stage = evaluate_boosting_grid(records, folds, survivors, done=done, **options)
    best_id = results.top_candidates(
        aggregate.boosting_summary(stage)[1], 1, "parameter_id"
    ).first().parameter_id
    refined = refinements(by_id[best_id])
    cells = stage
    if refined:
        cells = stage.unionByName(evaluate_boosting_grid(records, folds, refined, **options))
    horizons, summary = aggregate.boosting_summary(cells)
    facts = {
        "screen_survivors": n_survivors,
        "selection_metric": "mixture_adjusted_brier_equal_horizon_weight",
    }
    decision = results.decision_row(summary, ["parameter_id"], facts)
    by_id |= {p.identifier: p for p in refined}
    winner = by_id[decision.first().parameter_id]
    return {
        "screen_summary": screen_summary,
        "cells": cells,
        "horizons": horizons,
        "summary": summary,
        "decision": decision,
        "model": fit_boosting(records, winner, train_years, **options),
        "diagnostics": boosting_diagnostics(records, winner, folds, train_years, forward_years, **options),
    }


def boosting_diagnostics(
    records: DataFrame,
    parameters: BoostingParameters,
    folds: Sequence[Fold],
    train_years: Sequence[int],
    forward_years: Sequence[int],
    *,
    feature_set: str = "core",
    domain: Domain = DEFAULT,
) -> dict[str, DataFrame]:
    """Metrics, reliability bins and ratio tails of one configuration on every reverse cell and, by
    the model of the training years, on every later labelled year."""
    from .reports import run_calibration_report

    every = [*folds, forward_fold(train_years, sorted(forward_years))]
    counted = [*FOLD_COLUMNS, domain.label]
    scored = boosted_log_ratios(
        records,
        target_rows(records, every, domain),
        every,
        [parameters],
        feature_set=feature_set,
        domain=domain,
        counted=counted,
    ).select(*counted, "log_ratio", RECORDS)
    adjusted = adjust_cells(written(scored), FOLD_COLUMNS, estimator=partial(estimate_shares, weight=RECORDS))
    return run_calibration_report(adjusted, probability="probability", weight=RECORDS, domain=domain)


def staged_tables(
    survivors: DataFrame,
    refinement: DataFrame,
    *,
    expected_candidates: int,
    expected_cells: int,
) -> dict[str, DataFrame]:
    """Combine two finished boosting stages after checking their coverage."""
    cells = results.union_distinct([survivors, refinement], BOOSTING_KEYS)
    horizons, summary = aggregate.boosting_summary(cells)
    counts = summary.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("n_cells") != expected_cells).alias("n_incomplete"),
    ).first()
    if counts.n != expected_candidates or counts.n_incomplete:
        raise ValueError("Boosting summary has an incomplete candidate set or design")
    facts = {"selection_metric": "mixture_adjusted_brier_equal_horizon_weight"}
    decision = results.decision_row(summary, ["parameter_id"], facts)
    return {"cells": cells, "horizons": horizons, "summary": summary, "decision": decision}


# -- family-neutral runs -------------------------------------------------------


GRID_KEYS = ("family", "specification", "hyperparameters", *FOLD_COLUMNS)


def job_name(configuration: Mapping[str, object]) -> str:
    """What a configuration fits, without its folds."""
    family, name = configuration["family"], configuration["specification"]
    if family == "logistic":
        return f"{family}__{name}__C_{'_'.join(map(label_number, configuration['C']))}"
    if family == "hist_gradient_boosting":
        return f"{family}__{name}__{configuration['parameters'].identifier}"
    if family == "random_forest":
        return f"{family}__{name}"
    raise ValueError(f"Unknown density-ratio family {family!r}")


def _grid_job(
    records: DataFrame, folds: Sequence[Fold], configuration: Mapping[str, object], domain: Domain
) -> DataFrame:
    """The cells of one configuration on the folds."""
    family, name = configuration["family"], configuration["specification"]
    targets, counted = target_rows(records, folds, domain), [*FOLD_COLUMNS, domain.label]
    weight = None if family == "logistic" else RECORDS
    if family == "logistic":
        models = fit_grid(
            records,
            folds,
            parse_specification(name),
            configuration["C"],
            variant="known_source_prior",
            domain=domain,
        )
        scored = score_grid(targets, models, domain=domain)
        label = F.to_json(F.create_map(F.lit("C"), F.col("regularization_c")))
    elif family == "hist_gradient_boosting":
        values = configuration["parameters"]
        scored = boosted_log_ratios(
            records, targets, folds, [values], feature_set=name, domain=domain, counted=counted
        )
        label = F.lit(values.identifier)
    else:
        scored = None
        for fold in folds:
            model = fit_forest(records, fold.train_years, domain=domain)
            part = model.counted_log_ratio(targets.where(F.col("fold_id") == fold.fold_id), counted)
            scored = part if scored is None else scored.unionByName(part)
            label = F.lit(model.identifier)
    named = scored.select(
        F.lit(family).alias("family"),
        F.lit(name).alias("specification"),
        label.alias("hyperparameters"),
        *FOLD_COLUMNS,
        domain.label,
        "log_ratio",
        *([] if weight is None else [weight]),
    )
    if weight is not None:
        named = written(named)
    return evaluate_log_ratios(named, GRID_KEYS, is_positive(domain), weight=weight)


def run_grid(
    records: DataFrame,
    folds: Sequence[Fold],
    configurations: Sequence[Mapping[str, object]],
    domain: Domain = DEFAULT,
    store: str | None = None,
) -> DataFrame:
    """Fit any mix of families on every fold; the result is the family-neutral cell table.

    A configuration names ``family`` and ``specification`` and its parameters. With ``store``, the cells
    of each configuration are appended to a table there as soon as they are known, and
    configurations or folds that it already holds are not fitted again.
    """
    spark = records.sparkSession
    jobs = {job_name(configuration): configuration for configuration in configurations}
    held: set[tuple[str, str]] = set()
    if store is not None and path_exists(spark, store):
        held = {(row.job, row.fold_id) for row in spark.read.parquet(store).select("job", "fold_id").distinct().collect()}
    fresh = None
    for job, configuration in jobs.items():
        missing = [fold for fold in folds if (job, fold.fold_id) not in held]
        if not missing:
            continue
        cells = _grid_job(records, missing, configuration, domain).withColumn("job", F.lit(job))
        if store is not None:
            cells.write.mode("append").parquet(store)
        else:
            cells = freeze(cells)
            fresh = cells if fresh is None else fresh.unionByName(cells)
    if store is not None:
        planned = small_table(
            spark, [(job, fold.fold_id) for job in jobs for fold in folds], "job string, fold_id string"
        )
        fresh = spark.read.parquet(store).join(F.broadcast(planned), ["job", "fold_id"], "left_semi")
    return fresh.drop("job")


def published_problems(
    regenerated: DataFrame,
    stored: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    rtol: float = 1e-12,
    atol: float = 1e-14,
) -> DataFrame:
    """Counts of everything that must be absent before a table is published."""
    differing = results.table_differences(regenerated, stored, keys, values, rtol, atol)
    missing = F.col(f"{values[0]}_left").isNull() | F.col(f"{values[0]}_right").isNull()
    duplicates = results.duplicated_keys(stored, keys)
    winners = [
        table.groupBy("specification").agg(F.avg("brier_score").alias("score"))
        .agg(F.min_by("specification", F.struct("score", "specification")).alias("name"))
        for table in (regenerated.join(stored.select(*keys), list(keys), "left_semi"), stored)
    ]
    wrong = winners[0].select(
        F.when(F.col("name") != winners[1].scalar(), 1).otherwise(0).cast("long").alias("n")
    )
    parts = {
        "changed": differing.agg(F.count_if(~missing).alias("n")),
        "missing": differing.agg(F.count_if(missing).alias("n")),
        "duplicate": duplicates.agg(F.count(F.lit(1)).alias("n")),
        "wrong_winner": wrong,
    }
    table = None
    for problem, counted in parts.items():
        part = counted.select(F.lit(problem).alias("problem"), "n")
        table = part if table is None else table.unionByName(part)
    return table

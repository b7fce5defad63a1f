"""Storage of fitted models with the facts needed to check their identity."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..domain import Domain
from ..functions.local import small_table
from ..plans.specifications import parse_specification
from ..sources.loans import path_exists
from .logistic import LogisticModel
from .cells import make_grid
from .trees import TreeModel

METADATA_SCHEMA = (
    "model_id string, family string, specification string, hyperparameters string,"
    " train_years array<int>, n_training long, n_first long, n_second long,"
    " feature_names array<string>, weighting string, source_prior string, body string"
)
def domain_document(domain: Domain) -> dict:
    """The domain a model was fitted with, as plain values."""
    # Pairs, not an object: the order of the categories is that of the features.
    return {**asdict(domain), "categories": [[k, list(v)] for k, v in domain.categories.items()]}


def restored_domain(document: dict) -> Domain:
    plain = {k: tuple(v) if isinstance(v, list) else v for k, v in document.items()}
    return Domain(**{**plain, "categories": {k: tuple(v) for k, v in document["categories"]}})


def _metadata(model, counts, feature_names, hyperparameters: dict, body: dict) -> tuple:
    equal = getattr(model, "variant", "known_source_prior") == "known_source_prior"
    return (
        model.model_id,
        getattr(model, "family", "logistic"),
        model.spec.name if isinstance(model, LogisticModel) else model.feature_set,
        json.dumps(hyperparameters, sort_keys=True),
        list(model.train_years),
        *map(int, counts),
        list(feature_names),
        "equal_class_mass_within_source_year" if equal else "observed",
        "one_half" if equal else "observed",
        json.dumps(body, sort_keys=True),
    )


def _write(spark: SparkSession, path: str, row: tuple) -> None:
    n_training, n_first, n_second = row[5:8]
    if min(n_training, n_first, n_second) < 0 or n_first + n_second != n_training:
        raise ValueError("class counts must be nonnegative and sum to n_training")
    small_table(spark, [row], METADATA_SCHEMA).write.mode("overwrite").parquet(path)


def save_logistic(
    spark: SparkSession, model: LogisticModel, path: str, counts: tuple[int, int, int]
) -> None:
    """One row: identity, counts and the coefficients in feature order."""
    body = {
        "variant": model.variant,
        "regularization_c": model.regularization_c,
        "fold_id": model.fold_id,
        "parameters": dict(model.parameters),
        "coefficients": list(model.coefficients),
        "intercept": model.intercept,
        "year_effects": list(model.year_effects),
        "n_iter": model.n_iter,
        "converged": model.converged,
        "raw_intercept": model.raw_intercept,
        "mean_ratio_first": model.mean_ratio_first,
        "mean_inverse_ratio_second": model.mean_inverse_ratio_second,
        "domain": domain_document(model.domain),
    }
    row = _metadata(model, counts, model.feature_names, {"C": model.regularization_c}, body)
    _write(spark, path, row)


def load_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METADATA_SCHEMA).parquet(path)


def load_logistic(spark: SparkSession, path: str, expected_id: str | None = None) -> LogisticModel:
    row = load_metadata(spark, path).first()
    body = json.loads(row["body"])
    model = LogisticModel(
        variant=body["variant"],
        spec=parse_specification(row.specification),
        regularization_c=body["regularization_c"],
        fold_id=body["fold_id"],
        train_years=tuple(row.train_years),
        parameters=body["parameters"],
        feature_names=tuple(row.feature_names),
        coefficients=tuple(body["coefficients"]),
        intercept=body["intercept"],
        n_training=row.n_training,
        year_effects=tuple(body["year_effects"]),
        n_iter=body["n_iter"],
        converged=body["converged"],
        raw_intercept=body["raw_intercept"],
        mean_ratio_first=body["mean_ratio_first"],
        mean_inverse_ratio_second=body["mean_inverse_ratio_second"],
        domain=restored_domain(body["domain"]),
    )
    _check_identity(row.model_id, model.model_id, expected_id)
    return model


def save_tree(
    spark: SparkSession,
    model: TreeModel,
    path: str,
    counts: tuple[int, int, int],
    feature_names: tuple[str, ...],
    hyperparameters: dict,
) -> None:
    """The score of every cell is a table of its own; the cuts of the cells are in the metadata."""
    model.score_table(spark).write.mode("overwrite").parquet(f"{path}/model")
    body = {
        "identifier": model.identifier,
        "feature_set": model.feature_set,
        "bins": model.grid.bins,
        "cuts": model.cuts,
        "domain": domain_document(model.domain),
    }
    row = _metadata(model, counts, feature_names, hyperparameters, body)
    _write(spark, f"{path}/metadata", row)


def load_tree(spark: SparkSession, path: str, expected_id: str | None = None) -> TreeModel:
    row = load_metadata(spark, f"{path}/metadata").first()
    body = json.loads(row["body"])
    domain = restored_domain(body["domain"])
    grid = make_grid(body["bins"], body["feature_set"], domain)
    scores = [r["_score"] for r in spark.read.parquet(f"{path}/model").orderBy("_cell").collect()]  # one a cell
    if len(scores) != grid.n_cells:
        raise ValueError(f"Stored model {row.model_id!r} has {len(scores)} of {grid.n_cells} cells")
    model = TreeModel(
        row.family,
        body["identifier"],
        tuple(row.train_years),
        grid,
        tuple(map(tuple, body["cuts"])),
        tuple(scores),
        body["feature_set"],
        domain,
    )
    _check_identity(row.model_id, model.model_id, expected_id)
    return model


def _check_identity(stored: str, restored: str, expected: str | None) -> None:
    if stored != restored or expected not in (None, stored):
        raise ValueError(f"Stored model {stored!r} is not the requested {expected or restored!r}")


def fitted_paths(spark: SparkSession, plan: DataFrame, column: str = "model_path") -> DataFrame:
    """Which planned models are already stored; the plan is small."""
    rows = [(row[column], path_exists(spark, row[column])) for row in plan.select(column).distinct().collect()]
    stored = small_table(spark, rows, f"{column} string, is_stored boolean")
    return plan.join(F.broadcast(stored), column)

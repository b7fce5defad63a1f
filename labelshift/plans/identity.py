"""Deterministic configuration and model identifiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import number_label, safe_name


def configuration_id(
    family: Column, specification: Column, hyperparameters: Column, seed: Column
) -> Column:
    """Family, specification and a short digest of the sorted parameters."""
    ordered = F.array_sort(F.map_entries(hyperparameters))
    text = F.to_json(
        F.struct(
            family.alias("family"),
            F.map_from_entries(ordered).alias("hyperparameters"),
            seed.alias("random_seed"),
            specification.alias("specification"),
        ),
        {"ignoreNullFields": "false"},
    )
    digest = F.substring(F.sha2(text, 256), 1, 12)
    return F.concat_ws("__", family, specification, digest)


def model_id(
    prefix: str, specification: Column, c: Column, train_start: Column, train_end: Column
) -> Column:
    return F.concat(
        F.lit(f"{prefix}__"),
        specification,
        F.lit("__c_"),
        number_label(c),
        F.lit("__train_"),
        train_start,
        F.lit("_"),
        train_end,
    )


def model_path(root: str, identifier: Column) -> Column:
    return F.concat_ws("/", F.lit(root), safe_name(identifier))


def with_identity(plan: DataFrame, prefix: str, root: str, keys: Sequence[str] = ()) -> DataFrame:
    """Attach model id and storage path to a logistic plan."""
    identifier = model_id(
        prefix,
        F.col("specification"),
        F.col("regularization_c"),
        F.col("train_start"),
        F.col("train_end"),
    )
    return plan.withColumn("model_id", identifier).withColumn(
        "model_path", model_path(root, F.col("model_id"))
    )

"""Registry of the queries and the statements that check them."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sqlparts import compose

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, **parts: str):
    """Register a query; ``oracle`` may use every shared SQL part by name."""

    def register(function):
        if name in QUERIES:
            raise ValueError(f"Query {name!r} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: round_doubles(function(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = compose(oracle, **parts)
        return function

    return register


def round_doubles(frame: DataFrame, digits: int = 6) -> DataFrame:
    """Summation order differs between engines, so doubles are compared rounded."""
    return frame.select(
        *[
            (F.round(F.col(name), digits) + 0.0).alias(name) if kind == "double" else F.col(name)
            for name, kind in frame.dtypes
        ]
    )


def r(*names: str) -> str:
    """SQL list of rounded columns."""
    return ", ".join(f"round(CAST({name} AS DOUBLE), 6) + 0.0 AS {name}" for name in names)


def workspace(spark: SparkSession) -> str:
    """A fresh folder for written tables, below the cluster's shared folder.

    Only a local session without ``spark.checkpoint.dir`` uses a temporary one.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        name = spark.range(1).select(F.expr("uuid()")).first()[0]
        return f"{shared.rstrip('/')}/labelshift/{name}"
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("Set spark.checkpoint.dir to a folder every executor can reach")
    return tempfile.mkdtemp(prefix="spark-")

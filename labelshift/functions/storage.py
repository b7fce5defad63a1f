"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; local sessions may leave the setting out."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local["):
            raise ValueError("Set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/labelshift/{uuid.uuid4().hex}"


def written(frame: DataFrame) -> DataFrame:
    """The table, written and read back: no lineage, and its size is known to the optimizer."""
    return written_with(frame, {})[0]


def written_with(frame: DataFrame, totals: Mapping[str, Column]) -> tuple[DataFrame, dict]:
    """The written table and totals of its rows, taken while it is written."""
    path = shared_folder(frame.sparkSession)
    seen = Observation()
    counted = frame.observe(seen, *[total.alias(name) for name, total in totals.items()]) if totals else frame
    counted.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path), dict(seen.get) if totals else {}

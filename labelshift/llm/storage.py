"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; local sessions may leave the setting out."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local["):
            raise ValueError("Set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/llm/{uuid.uuid4().hex}"


def stored(frame: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back.

    The result no longer depends on shuffle files or on the lineage before it, so an executor
    lost later costs only a read.
    """
    path = shared_folder(frame.sparkSession)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)

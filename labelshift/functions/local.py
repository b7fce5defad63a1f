"""Small driver-side tables as local relations."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def small_table(spark: SparkSession, rows: Sequence[tuple], schema: StructType | str) -> DataFrame:
    """Plan, parameter and cell rows as a DataFrame without a Spark job.

    An Arrow table becomes a local relation: its size is known to the optimizer
    and it is broadcast without a scan of its own.
    """
    struct = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(struct)
    columns = [
        pa.array([row[position] for row in rows], type=field.type)
        for position, field in enumerate(arrow)
    ]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow), struct)


def freeze(cells: DataFrame) -> DataFrame:
    """Turn a computed cell table, one row per planned cell, into a local one.

    Later stages then neither recompute it nor carry its lineage.
    """
    return small_table(cells.sparkSession, cells.collect(), cells.schema)

"""Panel, monthly series and reference-table sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.expressions import to_number


def index_panel(frame: DataFrame) -> DataFrame:
    """County index with an integer year and key; every index column is kept."""
    types = dict(frame.dtypes)
    values = [name for name in frame.columns if name not in ("fips", "year", "date")]
    year = F.year("date") if "date" in types else F.col("year")
    return frame.select(
        to_number(F.col("fips"), types["fips"]).cast("long").alias("fips"),
        year.cast("int").alias("year"),
        *[to_number(F.col(name), types[name]).alias(name) for name in values],
    )


def read_index_panel(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    reader = spark.read.option("header", "true") if file_format == "csv" else spark.read
    return index_panel(reader.format(file_format).load(path))


def monthly_series(frame: DataFrame) -> DataFrame:
    """Monthly values with a numeric county key and a date."""
    types = dict(frame.dtypes)
    return frame.select(
        to_number(F.col("fips"), types["fips"]).cast("long").alias("fips"),
        F.to_date("date").alias("date"),
        to_number(F.col("zhvi"), types["zhvi"]).alias("zhvi"),
    )


def unpivot_months(wide: DataFrame, id_columns: Sequence[str] = ("fips",)) -> DataFrame:
    """One row per month from a table with one column per month."""
    months = [name for name in wide.columns if name not in id_columns]
    return wide.unpivot(list(id_columns), months, "date", "zhvi")


def read_monthly_series(
    spark: SparkSession, path: str, vintage: str, file_format: str = "parquet"
) -> DataFrame:
    """Read one pinned vintage of a table partitioned by ``vintage``."""
    reader = spark.read.option("header", "true") if file_format == "csv" else spark.read
    pinned = reader.format(file_format).load(path).where(F.col("vintage").cast("string") == vintage)
    pinned = pinned.drop("vintage")
    if "date" not in pinned.columns:
        pinned = unpivot_months(pinned)
    return monthly_series(pinned)


def read_reference_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.option("header", "true").schema(schema).csv(path)

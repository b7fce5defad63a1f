"""Completeness profiles and schema comparison of record sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..domain import DISTINCT_FIELDS, FIELD_ALIASES, FREQUENCY_FIELDS, MISSING_TOKENS
from ..functions.local import small_table
from ..sources.loans import first_present


def present_token(value):
    """False for null and for the declared missing-value texts."""
    return value.isNotNull() & ~value.cast("string").isin(*MISSING_TOKENS)


def value_counts(
    frame: DataFrame,
    aliases: Mapping[str, Sequence[str]] = FIELD_ALIASES,
    distinct_fields: Sequence[str] = DISTINCT_FIELDS,
) -> DataFrame:
    """Counts per (field, value) of every resolved field, in one scan.

    Values of fields without a distinct count are not carried, so the shuffle
    holds pre-aggregated pairs only.
    """
    entries = []
    for field, names in aliases.items():
        column = first_present(frame.columns, names)
        if column is None:
            continue
        counted = field in distinct_fields
        value = F.col(column)
        present = present_token(value) if counted else value.isNotNull()
        entries.append(
            F.struct(
                F.lit(field).alias("field"),
                F.lit(column).alias("column_name"),
                F.when(present, value.cast("string") if counted else F.lit("")).alias("value"),
            )
        )
    return (
        frame.select(F.inline(F.array(*entries)))
        .groupBy("field", "column_name", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def field_coverage(
    counts: DataFrame, distinct_fields: Sequence[str] = DISTINCT_FIELDS
) -> DataFrame:
    """Rows, non-null share and distinct values per field."""
    present = F.col("value").isNotNull()
    non_null = F.sum(F.when(present, F.col("n")).otherwise(0))
    return counts.groupBy("field", "column_name").agg(
        F.sum("n").alias("n_rows"),
        non_null.alias("non_null"),
        F.try_divide(non_null, F.sum("n")).alias("non_null_share"),
        F.when(F.col("field").isin(*distinct_fields), F.count_if(present)).alias(
            "distinct_non_null"
        ),
    )


def field_frequencies(
    counts: DataFrame, frequency_fields: Sequence[str] = FREQUENCY_FIELDS
) -> DataFrame:
    return counts.where(
        F.col("value").isNotNull() & F.col("field").isin(*frequency_fields)
    ).select("field", "value", "n")


def schema_table(sources: Mapping[str, DataFrame]) -> DataFrame:
    """(source, column, type) rows; schemas are small and known at plan time."""
    spark = next(iter(sources.values())).sparkSession
    rows = [
        (source, name, data_type)
        for source, frame in sources.items()
        for name, data_type in frame.dtypes
    ]
    return small_table(spark, rows, "source string, column_name string, column_type string")


def compare_schemas(schemas: DataFrame) -> DataFrame:
    """Common and source-specific columns and type differences."""
    n_sources = schemas.agg(F.count_distinct("source").alias("n_all"))
    per_column = schemas.groupBy("column_name").agg(
        F.count_distinct("source").alias("n_sources"),
        F.count_distinct("column_type").alias("n_types"),
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"),
    )
    common = F.col("n_sources") == n_sources.scalar()
    return per_column.withColumn("is_common", common).select(
        "column_name",
        "sources",
        "n_sources",
        "is_common",
        (F.col("is_common") & (F.col("n_types") > 1)).alias("type_differs"),
    )


def of_year(frame: DataFrame, year: int) -> DataFrame:
    """Records of one year; a table without a year column holds that year only."""
    column = first_present(frame.columns, (*FIELD_ALIASES["year"], "year"))
    return frame if column is None else frame.where(F.col(column).cast("int") == int(year))


def compare_sources(
    year: int, sources: Mapping[str, DataFrame]
) -> dict[str, DataFrame]:
    """Schema, size, completeness and frequencies of one year of each source."""
    coverage = frequencies = None
    for source, frame in sources.items():
        counts = value_counts(of_year(frame, year)).persist()
        part = field_coverage(counts).withColumns({"source": F.lit(source), "year": F.lit(int(year))})
        listed = field_frequencies(counts).withColumns(
            {"source": F.lit(source), "year": F.lit(int(year))}
        )
        coverage = part if coverage is None else coverage.unionByName(part)
        frequencies = listed if frequencies is None else frequencies.unionByName(listed)
    return {
        "coverage": coverage,
        "frequencies": frequencies,
        "schema": compare_schemas(schema_table(sources)),
    }

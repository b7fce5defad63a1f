"""Extract, result-table and report sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..domain import DEFAULT, Domain
from .loans import path_exists
from ..functions.local import small_table


def selection_columns(feature_set: str = "core", domain: Domain = DEFAULT) -> list[str]:
    """Persisted columns a feature set needs."""
    return [
        "year",
        domain.label,
        *domain.inputs(feature_set),
        *domain.categories,
        domain.region_column,
    ]


def extract_summary(
    extract: DataFrame, feature_set: str = "core", domain: Domain = DEFAULT
) -> DataFrame:
    """Row and class counts per year and source."""
    keys = [name for name in ("year", "source") if name in extract.columns]
    label = F.col(domain.label)
    return extract.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(label == domain.negative_class).alias("n_first"),
        F.count_if(label == domain.positive_class).alias("n_second"),
    ).withColumn("feature_set", F.lit(feature_set))


def write_selection_extract(
    cleaned: DataFrame,
    destination: str,
    *,
    feature_set: str = "core",
    domain: Domain = DEFAULT,
) -> DataFrame:
    """Write the narrow extract by year and summarise what was written."""
    columns = selection_columns(feature_set, domain)
    carried = [name for name in ("source",) if name in cleaned.columns]
    (
        cleaned.select(*columns, *carried)
        .hint("rebalance", "year")
        .write.mode("overwrite")
        .partitionBy("year")
        .parquet(destination)
    )
    written = cleaned.sparkSession.read.parquet(destination)
    return extract_summary(written, feature_set, domain)


def load_selection_years(
    spark: SparkSession,
    path: str,
    years: Sequence[int] | None = None,
    feature_set: str = "core",
    domain: Domain = DEFAULT,
) -> DataFrame:
    """Read the narrow extract; the year test prunes partitions."""
    frame = spark.read.parquet(path)
    if years is not None:
        frame = frame.where(F.col("year").isin(*[int(year) for year in years]))
    return frame.select(*selection_columns(feature_set, domain))


def write_tables(
    tables: Mapping[str, DataFrame], root: str, *, file_format: str = "parquet"
) -> list[str]:
    """Write each named result table below one root."""
    paths = []
    for name, frame in tables.items():
        path = f"{root}/{name}"
        writer = frame.write.mode("overwrite").format(file_format)
        if file_format == "csv":
            writer = writer.option("header", "true")
        writer.save(path)
        paths.append(path)
    return paths


def read_or_empty(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A stored table, or an empty one of the declared schema."""
    if path_exists(spark, path):
        return spark.read.schema(schema).parquet(path)
    return small_table(spark, [], schema)


def append_rows(existing: DataFrame, new: DataFrame) -> DataFrame:
    return existing.unionByName(new)


def replace_rows(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Replace every stored row that shares a key with ``new``."""
    if not keys:
        raise ValueError("No key columns given")
    for name, frame in (("new", new), ("existing", existing)):
        missing = [key for key in keys if key not in frame.columns]
        if missing:
            raise ValueError(f"No key columns {missing} in the {name} rows")
    replaced = new.select(*[F.col(key).alias(f"_new_{key}") for key in keys]).distinct()
    same = [existing[key].eqNullSafe(replaced[f"_new_{key}"]) for key in keys]
    kept = existing.join(replaced, same, "left_anti")
    return kept.unionByName(new)


def upsert_table(
    spark: SparkSession, path: str, new: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Replace one logical key of a stored table.

    The combined rows go to a new directory first and take the stored name by
    rename, so a lost job leaves the old table whole.
    """
    logical = new.select(*keys).distinct().limit(2).count()
    if logical == 0:
        raise ValueError("Nothing to put in place of the stored rows")
    if logical > 1:
        raise ValueError("An upsert takes the rows of one key, not of several")
    combined = new
    if path_exists(spark, path):
        combined = replace_rows(spark.read.parquet(path), new, keys)
    staged, retired = f"{path}.staged", f"{path}.retired"
    combined.write.mode("overwrite").parquet(staged)
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path
    file_system = hadoop_path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def move(source: str, target: str) -> None:
        if not file_system.rename(hadoop_path(source), hadoop_path(target)):
            raise OSError(f"{source} could not be renamed to {target}")

    stored = file_system.exists(hadoop_path(path))
    if stored:
        # A retired copy beside a stored table is left over from an earlier swap that ended well.
        if file_system.exists(hadoop_path(retired)) and not file_system.delete(hadoop_path(retired), True):
            raise OSError(f"{retired} could not be removed")
        move(path, retired)
    try:
        move(staged, path)
    except Exception:
        if stored:
            move(retired, path)
        raise
    return spark.read.parquet(path)


def report_json(report: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One JSON document per report row, its fields in name order."""
    fields = sorted(name for name in report.columns if name not in keys)
    return report.select(*keys, F.to_json(F.struct(*sorted([*keys, *fields]))).alias("document"))


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)

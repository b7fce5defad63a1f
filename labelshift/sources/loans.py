"""Record scans: provider columns in, canonical columns out."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..domain import (
    COLUMN_ALIASES,
    DEFAULT,
    INPUT_COLUMNS,
    NUMERIC_INPUTS,
    Domain,
)
from ..functions.expressions import to_number
from ..functions.local import small_table

LABEL_POLICIES = ("allow", "drop", "require")


def canonical_columns(frame: DataFrame) -> DataFrame:
    """Rename provider columns; two names for one column are ambiguous."""
    targets: dict[str, str] = {}
    for name in frame.columns:
        target = COLUMN_ALIASES.get(name, name)
        if target in targets:
            raise ValueError(f"{targets[target]!r} and {name!r} both provide {target!r}")
        targets[target] = name
    return frame.withColumnsRenamed({old: new for new, old in targets.items() if old != new})


def first_present(columns: Iterable[str], names: Sequence[str]) -> str | None:
    """The first alias a table has, decided from its schema alone."""
    available = set(columns)
    return next((name for name in names if name in available), None)


def numeric_columns(frame: DataFrame, names: Sequence[str] = NUMERIC_INPUTS) -> DataFrame:
    """Coerce the numeric inputs that are present; bad text becomes null."""
    types = dict(frame.dtypes)
    return frame.withColumns(
        {name: to_number(F.col(name), types[name]) for name in names if name in types}
    )


def project(
    frame: DataFrame, columns: Sequence[str] | None = None, *, allow_missing: bool = False
) -> DataFrame:
    """Keep the requested canonical columns, in request order and once each."""
    wanted = INPUT_COLUMNS if columns is None else columns
    wanted = list(dict.fromkeys(COLUMN_ALIASES.get(name, name) for name in wanted))
    missing = [name for name in wanted if name not in frame.columns]
    if missing and not allow_missing:
        raise ValueError(f"Requested columns are missing: {missing}")
    return frame.select(*[name for name in wanted if name not in missing])


def apply_label_policy(
    frame: DataFrame, policy: str = "allow", domain: Domain = DEFAULT
) -> DataFrame:
    """Keep, drop or require the label; years before reporting carry none."""
    if policy not in LABEL_POLICIES:
        raise ValueError(f"Unknown label_policy {policy!r}")
    present = domain.label in frame.columns
    if policy == "drop":
        return frame.drop(domain.label)
    if policy == "require":
        if not present:
            raise ValueError(f"Input is missing {domain.label}")
        empty = unlabelled_years(frame, domain).orderBy("year").collect()
        if empty:
            raise ValueError(f"Years {[row.year for row in empty]} are missing {domain.label}")
        return frame
    if not present:
        return frame
    reported = F.col("year") >= domain.first_labelled_year
    return frame.withColumn(domain.label, F.when(reported, F.col(domain.label)))


def unlabelled_years(frame: DataFrame, domain: Domain = DEFAULT) -> DataFrame:
    """Years without a single label."""
    return (
        frame.groupBy("year")
        .agg(F.count(F.col(domain.label)).alias("n_labelled"), F.count(F.lit(1)).alias("n"))
        .where("n_labelled = 0")
    )


def scan_loans(
    spark: SparkSession,
    root: str,
    *,
    years: Iterable[int] | None = None,
    sources: Sequence[str] | None = None,
    columns: Sequence[str] | None = None,
    allow_missing: bool = False,
    label_policy: str = "allow",
    domain: Domain = DEFAULT,
) -> DataFrame:
    """Read a table partitioned by ``source`` and ``year``.

    ``sources`` is a preference order: every year comes from the first listed
    source that has it. Year and source tests are partition filters, so only
    the chosen directories are read.
    """
    raw = spark.read.schema(union_schema(spark, root, sources)).parquet(root)
    if years is not None:
        raw = raw.where(F.col("year").isin(*[int(year) for year in years]))
    if sources is not None:
        raw = raw.where(chosen_source(source_folders(spark, root), sources))
    frame = canonical_columns(raw)
    carried = [name for name in ("source",) if name in frame.columns]
    wanted = [*(INPUT_COLUMNS if columns is None else columns), *carried]
    if label_policy == "drop" or (
        columns is None and label_policy == "allow" and domain.label not in frame.columns
    ):
        wanted = [name for name in wanted if name != domain.label]
    frame = project(frame, wanted, allow_missing=allow_missing)
    return apply_label_policy(numeric_columns(frame), label_policy, domain)


def source_folders(spark: SparkSession, root: str) -> dict[str, list[int]]:
    """Years of each source, from the names of the partition folders alone."""
    found: dict[str, list[int]] = {}
    for source in _children(spark, root, "source="):
        years = _children(spark, f"{root.rstrip('/')}/source={source}", "year=")
        found[source] = sorted(int(year) for year in years)
    return found


def _children(spark: SparkSession, path: str, prefix: str) -> list[str]:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    file_system = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [status.getPath().getName() for status in file_system.listStatus(hadoop_path)]
    return sorted(name.removeprefix(prefix) for name in names if name.startswith(prefix))


def union_schema(spark: SparkSession, root: str, sources: Sequence[str] | None = None) -> StructType:
    """Columns of all partitions, from one footer of each and not of each file.

    A partition that lacks a column gives null.
    """
    fields: dict[str, StructField] = {}
    for source, years in source_folders(spark, root).items():
        for year in years if sources is None or source in sources else ():
            folder = f"{root.rstrip('/')}/source={source}/year={year}"
            for field in spark.read.parquet(folder).schema:
                held = fields.setdefault(field.name, field)
                if held.dataType != field.dataType:
                    raise ValueError(f"Column {field.name} has more than one type; read its partitions one by one")
    partitions = [StructField("source", StringType()), StructField("year", IntegerType())]
    return StructType([*(f for name, f in fields.items() if name not in ("source", "year")), *partitions])


def chosen_source(folders: Mapping[str, Sequence[int]], sources: Sequence[str]):
    """Partition predicate taking each year from its first available source."""
    held = {(source, year) for source, years in folders.items() for year in years}
    unknown = set(sources) - set(folders)
    if unknown:
        raise ValueError(f"Unknown sources: {sorted(unknown)}")
    test = F.lit(False)
    for year in sorted({year for _, year in held}):
        source = next((name for name in sources if (name, year) in held), None)
        if source is not None:
            test = test | ((F.col("source") == source) & (F.col("year") == year))
    return test


LEGACY_COLUMNS = ("year", "lien_status", "edit_status", "county_code")


def legacy_counts(frame: DataFrame) -> DataFrame:
    """Annual completeness of a legacy table: the columns it needs, in mergeable counts.

    Spark reads the four columns in batches and merges partial counts by year.
    """
    return frame.select(*LEGACY_COLUMNS).groupBy("year").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("lien_status").alias("n_label"),
        F.count("edit_status").alias("n_edit"),
        F.count_if(F.col("county_code") >= 1).alias("n_county"),
    )


def inventory(raw: DataFrame) -> DataFrame:
    """Supported (source, year) pairs with their row counts."""
    return raw.groupBy("source", "year").agg(F.count(F.lit(1)).alias("n_rows"))


def conversion_plan(
    supported: DataFrame,
    years: Sequence[int] | None = None,
    sources: Sequence[str] | None = None,
) -> DataFrame:
    """One row per supported (source, year) of the request."""
    plan = supported
    if sources is not None and "all" not in sources:
        known = {row.source for row in supported.select("source").distinct().collect()}
        unknown = sorted(set(sources) - known)
        if unknown:
            raise ValueError(f"Unknown sources: {', '.join(unknown)}")
        plan = plan.where(F.col("source").isin(*sources))
    if years is not None:
        plan = plan.where(F.col("year").isin(*years))
        matched = {row.year for row in plan.select("year").distinct().collect()}
        unavailable = sorted(set(years) - matched)
        if unavailable:
            raise ValueError(f"Requested years are unavailable: {unavailable}")
    if plan.isEmpty():
        raise ValueError("No conversion jobs selected")
    return plan


def missing_years(requested: DataFrame, supported: DataFrame) -> DataFrame:
    """Requested years that no source provides."""
    return requested.join(supported.select("year").distinct(), "year", "left_anti")


def convert_to_parquet(
    incoming: DataFrame, destination: str, *, compression: str = "zstd"
) -> DataFrame:
    """Append the partitions the destination does not hold yet.

    ``incoming`` carries ``source`` and ``year``; returns the plan that was
    written. The rebalance hint splits a year that dominates the input and
    merges small ones, so no single task writes a whole hot partition.
    """
    spark = incoming.sparkSession
    plan = incoming.select("source", "year").distinct()
    if path_exists(spark, destination):
        held = spark.read.parquet(destination).select("source", "year").distinct()
        plan = plan.join(held, ["source", "year"], "left_anti")
    pairs = [(row.source, row.year) for row in plan.collect()]
    if pairs:
        test = F.lit(False)
        for source, year in pairs:
            test = test | ((F.col("source") == source) & (F.col("year") == year))
        # A lost job leaves files in the staging folder only; finished partitions are moved whole.
        staged = f"{destination.rstrip('/')}.staged"
        (
            incoming.where(test)
            .hint("rebalance", "source", "year")
            .write.mode("overwrite")
            .option("compression", compression)
            .partitionBy("source", "year")
            .parquet(staged)
        )
        for source, year in pairs:
            move_partition(spark, staged, destination, f"source={source}/year={year}")
    return small_table(spark, pairs, "source string, year int")


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    file_system = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return file_system.exists(hadoop_path)


def move_partition(spark: SparkSession, staged: str, destination: str, part: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path
    source, target = path(f"{staged.rstrip('/')}/{part}"), path(f"{destination.rstrip('/')}/{part}")
    file_system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    file_system.mkdirs(target.getParent())
    if not file_system.rename(source, target):
        raise OSError(f"{source} could not be moved to {target}")

"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

The first read takes only the length and a hash of a short prefix of each normalised text, and
counts the rows of each (length, prefix hash). Pairs with one row are done. The others set bits
in a filter of fixed size, so a second read finds the surviving rows without moving a text, and
takes the full hash of those alone. A row that meets the filter by chance is settled by its full
hash like any other.

Cases: a null text counts as empty; empty texts are equal to each other. Null ids come last: a
row with an id stays before one without, and where no row of a group has an id, all rows bear
``kept``. Rows that repeat an id and its text are one document and bear the same decision
(``deduplicate`` returns one of them). An empty table gives no rows. Columns other than the id
and the text are passed through by ``deduplicate`` and otherwise not read, whatever their names.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .book import query, table
from .skew import split_among
from .storage import stored

PREFIX_CHARS = 64

# Runs of white space. A single space already is what a run becomes, so it is left alone.
RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normal(text: Column) -> Column:
    """Each run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), RUNS, " ")


def full_hash(text: Column) -> Column:
    return F.sha2(normal(text), 256)


class Refined(NamedTuple):
    survivors: DataFrame  # id, full hash of each row that the filter lets through
    with_row: DataFrame  # the same rows as ``row``, a struct of all their columns
    single: DataFrame  # all other rows, as ``row``


def refine(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> Refined:
    rows = docs.select(F.struct("*").alias("row"))
    clean = normal(F.col(f"row.{text_col}"))
    prefix = F.xxhash64(F.substring(clean, 1, PREFIX_CHARS))

    key = F.xxhash64(F.length(clean), prefix)
    counted = (
        rows.select(F.length(clean).alias("length"), prefix.alias("prefix"))
        .groupBy("length", "prefix")
        .count()
    )
    shared = counted.where("count > 1").select(F.xxhash64("length", "prefix").alias("key"))
    with_row, single = split_among(rows, key, shared)
    survivors = with_row.select(
        F.col(f"row.{id_col}").alias("id"), F.unhex(full_hash(F.col(f"row.{text_col}"))).alias("full")
    )
    return Refined(stored(survivors), with_row, single)


def grouped(survivors: DataFrame) -> DataFrame:
    """id, full, keep_id, group_size, kept of each surviving row."""
    groups = survivors.groupBy("full").agg(
        F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    return survivors.join(groups, "full").withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id")))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each set of equal texts, with all its columns; no other text is shuffled."""
    parts = refine(docs, id_col, text_col)
    stays = (
        grouped(parts.survivors).where("kept").select(F.col("id").alias("keep"), "full").distinct()
    )
    keyed = parts.with_row.select(
        "row", F.unhex(full_hash(F.col(f"row.{text_col}"))).alias("full")
    )
    same = keyed["full"] == stays["full"]
    kept = (
        keyed.join(stays, same & keyed[f"row.{id_col}"].eqNullSafe(stays["keep"]))
        .groupBy(keyed["full"])
        .agg(F.first("row").alias("row"))
        .select("row")
    )
    return parts.single.unionAll(kept).select("row.*")


@query(
    "op9_exact_dedup",
    r"""
    WITH clean AS (
        SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
        FROM documents),
    groups AS (
        SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM clean GROUP BY text_sha256)
    SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
    FROM clean JOIN groups USING (text_sha256)
    """,
)
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row that stays for it; the digest of rows that no other row
    resembles is added here, since the result must bear it."""
    parts = refine(table(spark, sf_dir, "documents"))
    single = parts.single.select(
        F.col("row.doc_id").alias("doc_id"),
        F.col("row.doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        full_hash(F.col("row.text")).alias("text_sha256"),
    )
    shared = grouped(parts.survivors).select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        "kept",
        F.lower(F.hex("full")).alias("text_sha256"),
    )
    return single.unionAll(shared)

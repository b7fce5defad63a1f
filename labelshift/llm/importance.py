"""Quality selection by importance resampling over hashed n-grams.

Words and pairs of neighbouring words are hashed into ``BUCKETS`` features. Counts of the target
rows (documents with a good label) and of all raw rows give two generative bag-of-n-grams models
with add-one smoothing. A document's log importance weight is the sum over its n-grams of the
log ratio of the two. Sampling without replacement in proportion to the weights is Gumbel top-k:
each log weight gets an independent Gumbel draw, derived from a hash of the id and the text, and
the k greatest keys are selected. Their threshold is found exactly by counting keys in
65,536 ranges of their bits at a time, so no table of keys is sorted or collected.

The default k keeps the share of good rows among the labelled ones.

Cases: null and empty texts have no n-grams and log weight 0. Label rows that are null or without
a document count for nothing; a document that several label rows call good counts once for each
distinct id. Equal keys at the threshold are all selected where the rows are repeats of one
another (same id and text); so at most such repeats exceed k. Rows with a null id take part with
the id read as a fixed value. An empty table gives no rows, and without labels every weight is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .book import query, table
from .skew import split_among
from .storage import stored
from .words import MULTIPLIER, WordHashes, hashed, mixed, texts, words

BUCKETS = 10_000


def ngram_buckets(ids: np.ndarray) -> np.ndarray:
    pairs = mixed(ids[:-1] * MULTIPLIER + ids[1:])
    return (np.concatenate([mixed(ids), pairs]) % np.uint64(BUCKETS)).astype(np.int64)


def ngram_counts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Bucket counts of the target rows and of all rows; ``labels`` holds target ids."""
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    target = labels.select(F.col(id_col).alias("id")).distinct().withColumn("good", F.lit(True))
    # Only rows whose id may be a target's are moved, and at every size in the same way.
    spot = F.xxhash64(F.col("id"))
    maybe, others = split_among(chosen, spot, target.select(spot.alias("spot")))
    joined = (
        maybe.join(target.hint("merge"), "id", "left")
        .select("text", F.coalesce("good", F.lit(False)).alias("good"))
        .unionAll(others.select("text", F.lit(False).alias("good")))
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        totals = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for text, good in zip(texts(batch), batch.column(1).to_pylist(), strict=True):
                tokens = words(text)
                if tokens:
                    found = np.bincount(ngram_buckets(hashed(tokens, hashes)), minlength=BUCKETS)
                    totals[1] += found
                    if good:
                        totals[0] += found
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(BUCKETS, dtype=np.int32)), pa.array(totals[0]), pa.array(totals[1])],
            ["bucket", "target", "raw"],
        )

    rows = (
        joined.mapInArrow(count, "bucket int, target long, raw long")
        .groupBy("bucket")
        .agg(F.sum("target").alias("target"), F.sum("raw").alias("raw"))
        .collect()
    )  # BUCKETS rows
    counts = np.zeros((2, BUCKETS), np.int64)
    for row in rows:
        counts[:, row.bucket] = row.target, row.raw
    return counts[0], counts[1]


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    if not target.sum():
        return np.zeros(BUCKETS)
    return np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


def importance_weights(docs: DataFrame, ratios: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_ngrams, log_weight, content (a hash of the text) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)  # BUCKETS doubles
    text = F.col(text_col).cast("string")
    chosen = docs.select(
        F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("content")
    )
    kind = chosen.schema["id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ratio = WordHashes(), shared.value
        for batch in batches:
            counts, weights = [], []
            for text in texts(batch):
                tokens = words(text)
                found = ngram_buckets(hashed(tokens, hashes)) if tokens else np.empty(0, np.int64)
                counts.append(len(found))
                weights.append(float(ratio[found].sum()))
            arrays = [batch.column(0), pa.array(counts, pa.int64()), pa.array(weights, pa.float64()), batch.column(2)]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "n_ngrams", "log_weight", "content"])

    return chosen.mapInArrow(score, f"id {kind}, n_ngrams long, log_weight double, content long")


def gumbel(seed: int) -> Column:
    """A standard Gumbel draw from the row's id and content."""
    bits = F.pmod(F.xxhash64(F.col("id"), F.col("content"), F.lit(seed)), F.lit(1 << 52))
    return -F.log(-F.log((bits + 0.5) / float(1 << 52)))


def ordered_bits(value: Column) -> Column:
    """An integer that orders as the double does (numbers of 16 digits, a fixed scale)."""
    return F.round(value * 1e6).cast("long")


def top_k(keyed: DataFrame, k: int, bits: int = 64) -> DataFrame:
    """``keyed`` with ``selected``: the k greatest values of its long column ``rank_key``.

    Each round counts the rows in the 65,536 ranges of the next 16 bits below the range that
    holds the k-th value; ties are split by the long column ``tie``, in the same way.
    """
    threshold = {}
    inside, left = keyed, k
    for column in ("rank_key", "tie"):
        prefix = None
        for shift in range(bits - 16, -1, -16):
            digit = F.shiftright(F.col(column), shift)
            counts = {row.digit: row["count"] for row in inside.groupBy(digit.alias("digit")).count().collect()}
            for value in sorted(counts, reverse=True):
                if counts[value] >= left:
                    prefix = value
                    break
                left -= counts[value]
            if prefix is None:
                return keyed.withColumn("selected", F.lit(True))
            inside = inside.where(digit == prefix)
            threshold[column] = prefix
            prefix = None
    rank, tie = F.lit(threshold["rank_key"]), F.lit(threshold["tie"])
    selected = (F.col("rank_key") > rank) | ((F.col("rank_key") == rank) & (F.col("tie") >= tie))
    return keyed.withColumn("selected", selected)


def resample(
    docs: DataFrame,
    target_ids: DataFrame,
    share: float,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 20,
) -> DataFrame:
    """id, n_ngrams, log_weight, gumbel_key, selected of each row."""
    ratios = log_ratios(*ngram_counts(docs, target_ids, id_col, text_col))
    weighed = importance_weights(docs, ratios, id_col, text_col).withColumn(
        "gumbel_key", F.col("log_weight") + gumbel(seed)
    )
    keyed = stored(
        weighed.withColumn("rank_key", ordered_bits(F.col("gumbel_key"))).withColumn(
            "tie", F.xxhash64("id", "content")
        )
    )
    k = round(share * keyed.count())
    chosen = top_k(keyed, k) if k else keyed.withColumn("selected", F.lit(False))
    return chosen.select("id", "n_ngrams", "log_weight", "gumbel_key", "selected")


@query("op10_importance_resampling")
def op10_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weight of every document and whether the sample holds it."""
    labels = table(spark, sf_dir, "labels")
    share = labels.agg(F.avg(F.col("quality").cast("double"))).first()[0] or 0.0
    good = labels.where("quality = 1").select("doc_id")
    return resample(table(spark, sf_dir, "documents"), good, share).withColumnRenamed("id", "doc_id")

"""Near-duplicate documents by DartMinHash.

A document is a bag of five-word shingles weighted by their counts. Darts fall on the unit
squares above each element as a Poisson process in rank, all derived from hashes of the element,
the square and the dart's number, so equal elements of two documents see the same darts. Those
that hit the weighted region of a document and come before ``(k ln k + 2k) / total weight`` are
thrown; each goes to a hashed coordinate, which keeps the earliest. If a coordinate stays empty,
the horizon doubles. The chance that two documents keep the same dart in a coordinate is their
weighted Jaccard similarity. Signatures are banded; candidates are verified exactly.

Cases: null and empty texts, and texts of white space only, have no shingles; they form one class.
Texts of fewer than five words are one shingle. Repeated rows and equal texts fall in one class.
The document with the smallest id stays; a null id comes after all others, and rows that share an id
are told apart by their texts, of which one stays. Rows that repeat the id and the text of the one
that stays do too. An empty table gives no rows. Columns other than the id and the text are passed
through by ``keep_first`` and otherwise not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .book import query, table
from .near import THRESHOLD, Unit, expanded, identified, link_classes, one_by_one, text_hash, tune
from .skew import join_groups, split_among
from .storage import stored
from .words import MULTIPLIER, mixed, shingles, words

_POSITION = np.uint64(0x6A09E667F3BCC909)
_DART = np.uint64(0xBB67AE8584CAA73B)


def throw_darts(
    cells: np.ndarray, heights: np.ndarray, horizon: float, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coordinates, ranks and hashes of the darts below the horizon that hit the cells.

    A cell is a unit square of an element's weight axis, of which ``height`` is covered.
    """
    coordinates, ranks, darts = [], [], []
    reached = np.zeros(len(cells))
    block, drawn = max(1, math.ceil(horizon + 4 * math.sqrt(horizon))), 0
    while len(cells):
        numbers = np.arange(drawn, drawn + block, dtype=np.uint64) * MULTIPLIER
        hashes = mixed(cells[:, None] + numbers[None, :])
        uniform = ((hashes >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        arrival = reached[:, None] + np.cumsum(-np.log(uniform), axis=1)
        inside = arrival < horizon
        dart = mixed(hashes[inside] ^ _DART)
        position = (mixed(dart ^ _POSITION) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        hit = position < np.broadcast_to(heights[:, None], inside.shape)[inside]
        coordinates.append(dart[hit] % np.uint64(k))
        ranks.append(arrival[inside][hit])
        darts.append(mixed(dart[hit]))
        alive = inside[:, -1]
        cells, heights, reached = cells[alive], heights[alive], arrival[alive, -1]
        drawn += block
    return np.concatenate(coordinates), np.concatenate(ranks), np.concatenate(darts)


def dart_sketch(elements: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """The hash of the earliest dart of each of k coordinates; weights are positive."""
    squares = np.ceil(weights).astype(np.int64)
    if squares.max() > 1:
        nth = np.arange(squares.sum()) - np.repeat(np.cumsum(squares) - squares, squares)
        cells = mixed(np.repeat(elements, squares) + nth.astype(np.uint64) * _POSITION)
        heights = np.minimum(1.0, np.repeat(weights, squares) - nth)
    else:
        cells, heights = mixed(elements), weights.astype(np.float64)
    horizon = (k * math.log(k) + 2 * k) / float(weights.sum())
    while True:
        coordinates, ranks, darts = throw_darts(cells, heights, horizon, k)
        order = np.argsort(ranks, kind="stable")
        filled, first = np.unique(coordinates[order], return_index=True)
        if len(filled) == k:
            return darts[order][first]
        horizon *= 2


def whole_text(text: bytes) -> Iterator[Unit]:
    tokens = words(text)
    if tokens:
        yield Unit(0, 0, len(text), tokens)


def _classes(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """id (as ``identified``), class_id, class_size, kept of each row."""
    banding = tune(threshold)
    k = banding.size

    def sketch(bag: np.ndarray) -> np.ndarray:
        # The bag already holds an element for each unit of weight.
        return dart_sketch(bag, np.ones(len(bag)), k)

    def bag(ids: np.ndarray) -> np.ndarray:
        return expanded(shingles(ids))

    named = identified(docs, id_col, text_col)
    units, labels = link_classes(named, whole_text, bag, one_by_one(bag, sketch), banding, threshold, "id", "text")
    blank = named.where(F.coalesce(F.trim(F.regexp_replace("text", r"[\x09-\x0D]", " ")), F.lit("")) == "")
    rows = stored(
        join_groups(units.select("id", "key"), labels, "key")
        .select("id", "label")
        .unionAll(blank.select("id", F.lit(b"").cast("binary").alias("label")))
    )
    place = F.struct(F.col("id.id").isNull().alias("unnamed"), F.col("id.id").alias("id"), F.col("id.text").alias("text"))
    classes = stored(rows.groupBy("label").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("class_size")))
    return join_groups(rows, classes, "label", "class_size").select(
        "id", F.col("first.id").alias("class_id"), "class_size", place.eqNullSafe(F.col("first")).alias("kept")
    )


def near_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """id, class_id (id of the row of its class that stays), class_size, kept of each row."""
    return _classes(docs, id_col, text_col, threshold).withColumn("id", F.col("id.id"))


def keep_first(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """The documents, with all columns, that stay: one of each class.

    The classes of one row need no join: only rows whose id and text may be removed ones are moved.
    """
    gone = _classes(docs, id_col, text_col, threshold).where("not kept")
    gone = stored(gone.select(F.col("id.id").alias("gone"), F.col("id.text").alias("gone_text")).distinct())
    rows = docs.select(F.struct("*").alias("row"), text_hash(text_col).alias("text"))
    here = F.xxhash64(F.col(f"row.`{id_col}`"), F.col("text"))
    maybe, others = split_among(rows, here, gone.select(F.xxhash64("gone", "gone_text").alias("spot")))
    same = maybe[f"row.`{id_col}`"].eqNullSafe(gone["gone"]) & (maybe["text"] == gone["gone_text"])
    return others.unionAll(maybe.join(gone, same, "left_anti")).select("row.*")


@query("op3_dart_minhash")
def op3_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document, and whether it stays."""
    return near_classes(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")

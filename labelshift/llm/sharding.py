"""Shards by best-fit-decreasing bin packing of indivisible groups.

Rows with equal texts form a group that no shard boundary divides. Groups of at least one
``GRAIN``-th of a shard are items of their own: there are at most ``GRAIN`` times the shards of
these. Smaller groups go by hash into bundles of about a fifth of that size, which are items
too. So the packing sees a number of items bounded by the shards, whatever the input.
Items in descending size enter the bin with the tightest remaining capacity that holds them,
found in a sorted list, which stands for the balanced tree; the capacity is the smallest (by bisection) at which the shards
suffice. A group of an even share or more has a shard of its own, and the rest are evened out.

Cases: a null text has no bytes, and counts as equal to the empty text. Repeated rows and rows
with a null id are ordinary rows: a slot each. Slots follow the id; among equal ids the order is
arbitrary. An empty table gives no rows. Columns other than the id and the text are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .book import query, table
from .storage import stored

GRAIN = 200
SLICE_ROWS = 100_000
ROW_BYTES = 8


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Bin of each size (given in descending order); opens a bin where none has room."""
    remaining: list[tuple[int, int]] = []  # ordered by room, then bin
    bins, opened = [], 0
    for size in sizes:
        at = bisect_left(remaining, (size, -1))
        if at < len(remaining):
            room, chosen = remaining.pop(at)
        else:
            room, chosen = max(capacity, size), opened
            opened += 1
        insort(remaining, (room - size, chosen))
        bins.append(chosen)
    return bins


def even_bins(sizes: list[int], shards: int) -> list[int]:
    """Bins of descending sizes, at the smallest capacity found for which the bins suffice.

    A size of an even share of what is left or more has a bin of its own; the rest are packed
    into the other bins.
    """
    alone, left = 0, sum(sizes)
    while alone < min(shards - 1, len(sizes)) and sizes[alone] * (shards - alone) >= left:
        left -= sizes[alone]
        alone += 1
    rest, bins = sizes[alone:], shards - alone
    low = max([-(-left // bins), *rest[:1]])
    high = 2 * low
    best = best_fit_decreasing(rest, high)
    while low < high:
        middle = (low + high) // 2
        tried = best_fit_decreasing(rest, middle)
        if max(tried, default=0) < bins:
            best, high = tried, middle
        else:
            low = middle + 1
    return [*range(alone), *(alone + b for b in best)]


def assign_shards(
    docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id, size, text_crc32, shard and slot (gapless from 0 within the shard) of each row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stored(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("content"),
        )
    )
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    grain = max(1, total // (shards * GRAIN))
    bundles = shards * GRAIN * 5
    groups = rows.groupBy("content").agg(F.sum("size").alias("size"))
    large = [
        (row.content, row.size) for row in groups.where(F.col("size") >= grain).collect()
    ]  # at most shards * GRAIN rows, by the size of each
    small_bundle = F.pmod(F.xxhash64("content", F.lit(7)), F.lit(bundles))
    small = [
        (row.bundle, row.size)
        for row in groups.where(F.col("size") < grain)
        .groupBy(small_bundle.alias("bundle"))
        .agg(F.sum("size").alias("size"))
        .collect()
    ]  # at most ``bundles`` rows
    items = sorted(
        [(size, 1, key) for key, size in large] + [(size, 0, key) for key, size in small],
        key=lambda item: (-item[0], item[1], item[2]),
    )
    placed = even_bins([size for size, _, _ in items], shards)
    plan = spark.createDataFrame(
        [(bool(kind), key, shard) for (_, kind, key), shard in zip(items, placed, strict=True)],
        "is_large boolean, item long, shard int",
    )
    own = plan.where("is_large").select(F.col("item").alias("content"), F.col("shard").alias("own_shard"))
    bundled = plan.where("not is_large").select(F.col("item").alias("bundle"), F.col("shard").alias("bundle_shard"))
    slices = max(1, n // SLICE_ROWS)
    located = (
        rows.join(F.broadcast(own), "content", "left")
        .withColumn("bundle", small_bundle)
        .join(F.broadcast(bundled), "bundle", "left")
        .select(
            "id", "size", "text_crc32",
            F.coalesce("own_shard", "bundle_shard").alias("shard"),
            F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int").alias("slice"),
        )
    )
    return _slotted(stored(located))


def _slotted(located: DataFrame) -> DataFrame:
    """Slots counted within slices of a shard; a slice starts where the slices before it end."""
    counts = located.groupBy("shard", "slice").count()
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "shard", "slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start")
    )
    within = Window.partitionBy("shard", "slice").orderBy("id")
    return (
        located.withColumn("place", F.row_number().over(within) - 1)
        .join(starts, ["shard", "slice"])
        .select("id", "size", "text_crc32", "shard", (F.col("start") + F.col("place")).alias("slot"))
    )


@query("op7_best_fit_shards")
def op7_best_fit_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of nearly equal bytes."""
    return assign_shards(table(spark, sf_dir, "documents"), 24).select(
        F.col("id").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )

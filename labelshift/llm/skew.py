"""Joins and splits that stay even when one key holds much of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stored

SHARE = 1_000
BITS_PER_KEY = 16
LEAST_BITS = 1 << 23
MOST_BITS = 1 << 30


def join_groups(rows: DataFrame, groups: DataFrame, key: str, count: str = "n") -> DataFrame:
    """Inner join with a table of one row for each key, which counts the rows of the key.

    Keys with more than a ``SHARE``-th of all counted rows are at most ``SHARE``; they are broadcast,
    so their rows stay where they are. Only the others meet by key. Both tables are read twice.
    """
    total = groups.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    frequent = F.col(count) * SHARE > F.lit(total)
    facts = F.struct(*[name for name in groups.columns if name != key]).alias("_facts")
    marked = rows.join(F.broadcast(groups.where(frequent).select(key, facts)), key, "left")
    hot = marked.where("_facts is not null").select(*rows.columns, "_facts")
    others = marked.where("_facts is null").drop("_facts").join(groups.where(~frequent).select(key, facts), key)
    return hot.unionByName(others).select(*rows.columns, "_facts.*")


def split_among(rows: DataFrame, value: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose long ``value`` may be among the keys (one long column), and the others.

    The keys set bits in a filter of at least ``BITS_PER_KEY`` bits for each of them, so no row is
    shuffled; of the rows whose value is no key, one in so many is among the first. Where the
    filter would pass ``MOST_BITS`` (128 MB), rows and keys meet in a shuffle instead and the split
    is exact. ``rows`` must not use the names below.
    """
    keys = stored(keys.select(F.xxhash64(F.col(keys.columns[0])).alias("_key")))
    bits = max(LEAST_BITS, 1 << (BITS_PER_KEY * keys.count() - 1).bit_length())
    if bits > MOST_BITS:
        known = keys.distinct().withColumn("_among", F.lit(True))
        marked = rows.withColumn("_key", F.xxhash64(value)).join(known, "_key", "left")
        marked = marked.withColumn("_among", F.coalesce("_among", F.lit(False)))
        return marked.where("_among").select(*rows.columns), marked.where("not _among").select(*rows.columns)
    spot = F.pmod(F.col("_key"), F.lit(bits)) + 1
    bitmaps = (
        keys.select(spot.alias("spot"))
        .groupBy(F.bitmap_bucket_number("spot").alias("_bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("_bitmap"))
    )
    own = F.pmod(F.xxhash64(value), F.lit(bits)) + 1
    byte = F.substring(F.col("_bitmap"), F.expr("cast(_bit div 8 as int) + 1"), F.lit(1))
    bit = F.conv(F.hex(byte), 16, 10).cast("int").bitwiseAND(F.expr("shiftleft(1, cast(_bit % 8 as int))"))
    marked = (
        rows.withColumn("_spot", own)
        .withColumn("_bucket", F.bitmap_bucket_number("_spot"))
        .withColumn("_bit", F.bitmap_bit_position("_spot").cast("int"))
        .join(F.broadcast(stored(bitmaps)), "_bucket", "left")
        .withColumn("_among", F.coalesce(bit != 0, F.lit(False)))
    )
    return marked.where("_among").select(*rows.columns), marked.where("not _among").select(*rows.columns)

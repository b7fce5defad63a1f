"""Near-duplicate search over sketched units of text: banding, exact links, classes.

A unit is a document or a part of one. Units with the same words are one *content* (``key``) and
are sketched, compared and linked once, however many rows hold them. Contents that agree in all
rows of a band meet in a bucket. Links are found in two steps, both linear in the rows unless a
bucket mixes classes:

1. Each member of a bucket is compared with the bucket's least member. A pair is verified once,
   also where it meets in many buckets, after a sketch estimate far below the threshold has
   been ruled out.
2. Components of these links are formed. Where a bucket of three or more still holds different
   components, its members are compared across components in tasks of bounded size (blocks of
   a large bucket meet pairwise); only links come out.

So within the buckets no link between components is lost, and copies are never paired.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .components import components
from .skew import split_among
from .storage import stored
from .words import MULTIPLIER, mixed, texts, word_hashes

THRESHOLD = 0.8
BLOCK_MEMBERS = 1024
CELL_ROWS = 2_000
TOKENS_TOGETHER = 100_000


class Banding(NamedTuple):
    rows: int
    bands: int

    @property
    def size(self) -> int:
        return self.rows * self.bands

    def recall(self, similarity: float) -> float:
        return 1 - (1 - similarity**self.rows) ** self.bands


def tune(threshold: float = THRESHOLD, recall: float = 0.9995, size: int = 64) -> Banding:
    """The most selective banding of at most ``size`` values with this recall at the threshold."""
    best = None
    for rows in range(1, size + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if rows * bands <= size:
            best = Banding(rows, bands)
    if best is None:
        raise ValueError("No banding of this size reaches the recall")
    return best


class Unit(NamedTuple):
    number: int
    start: int  # byte offsets in the text
    end: int
    tokens: list[bytes]


Splitter = Callable[[bytes], Iterator[Unit]]
# bag: sorted distinct elements of a unit's word hashes
Bagger = Callable[[np.ndarray], np.ndarray]
# sketches, one row a unit, of units given by their joined word hashes and their lengths
Sketcher = Callable[[np.ndarray, np.ndarray], np.ndarray]


def content_key(content: bytes) -> bytes:
    """Key of a unit's words, joined by spaces."""
    return xxhash.xxh3_128_digest(content)


def expanded(elements: np.ndarray) -> np.ndarray:
    """A bag as a set: the j-th occurrence of an element is an element of its own.

    Jaccard similarity of two such sets is the weighted one of the bags.
    """
    values, counts = np.unique(elements, return_counts=True)
    if len(values) == len(elements):
        return values
    repeated = np.repeat(values, counts)
    nth = np.arange(len(repeated)) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.sort(np.where(nth == 0, repeated, mixed(repeated + nth.astype(np.uint64) * MULTIPLIER)))


def band_keys(sketches: np.ndarray, banding: Banding) -> np.ndarray:
    """A key for each band of each sketch (a row of the matrix)."""
    values = sketches.reshape(-1, banding.bands, banding.rows)
    keys = np.arange(1, banding.bands + 1, dtype=np.uint64) * MULTIPLIER
    for row in range(banding.rows):
        keys = mixed(keys * MULTIPLIER + values[:, :, row])
    return keys.view(np.int64)


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id (with a hash of the text, so that equal and null ids are told apart) and text."""
    text = F.col(text_col).cast("string")
    return docs.select(
        F.struct(F.col(id_col).alias("id"), text_hash(text_col).alias("text")).alias("id"), text.alias("text")
    )


def text_hash(text_col: str) -> Column:
    """The hash in an ``identified`` id; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def id_type(frame: DataFrame, name: str) -> str:
    return frame.schema[name].dataType.simpleString()


def one_by_one(bag: Bagger, sketch: Callable[[np.ndarray], np.ndarray]) -> Sketcher:
    """A sketcher of many units from one of a single bag."""

    def run(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        ends = np.cumsum(lengths)
        return np.stack([sketch(bag(ids[end - n : end])) for n, end in zip(lengths, ends, strict=True)])

    return run


def sketch_units(
    docs: DataFrame, split: Splitter, sketch: Sketcher, banding: Banding, id_col: str, text_col: str
) -> DataFrame:
    """id, unit, start, stop, n_words, key, bands, low (lowest byte of each value) of each unit.

    Units are gathered to about ``TOKENS_TOGETHER`` words and sketched together.
    """
    schema = (
        f"id {id_type(docs, id_col)}, unit int, start long, stop long, n_words int, key binary,"
        " bands array<long>, low binary"
    )
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        contents: list[bytes] = []
        n_words = 0

        def gathered(id_kind: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            kinds = [id_kind, pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            values = sketch(word_hashes(b" ".join(contents)), np.array(columns[4]))
            offsets = np.arange(0, len(rows) * banding.bands + 1, banding.bands, dtype=np.int32)
            arrays.append(pa.ListArray.from_arrays(offsets, band_keys(values, banding).reshape(-1)))
            low = (values & np.uint64(255)).astype(np.uint8)
            arrays.append(pa.array([row.tobytes() for row in low], pa.binary()))
            rows.clear()
            contents.clear()
            return pa.RecordBatch.from_arrays(arrays, names)

        id_kind = None
        for batch in batches:
            id_kind = batch.schema.field(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
                for unit in split(text):
                    content = b" ".join(unit.tokens)
                    key = content_key(content)
                    rows.append((doc_id, unit.number, unit.start, unit.end, len(unit.tokens), key))
                    contents.append(content)
                    n_words += len(unit.tokens)
                    if n_words >= TOKENS_TOGETHER:
                        yield gathered(id_kind)
                        n_words = 0
        if rows:
            yield gathered(id_kind)

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, schema)


def _bags(docs: DataFrame, wanted: DataFrame, split: Splitter, bag: Bagger, id_col: str, text_col: str) -> DataFrame:
    """(key, bag) of the wanted contents (key, id), read from one row that holds each of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, bags = [], []
            for wish, text in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
                wish = set(wish)
                for unit in split(text):
                    content = b" ".join(unit.tokens)
                    key = content_key(content)
                    if key in wish:
                        wish.discard(key)
                        keys.append(key)
                        bags.append(bag(word_hashes(content)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(bags, pa.binary())], ["key", "bag"])

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    by_id = wanted.groupBy("id").agg(F.collect_list("key").alias("wish"))  # at most the units of a text
    spot = F.xxhash64(F.col("id"))
    near, _ = split_among(chosen, spot, by_id.select(spot.alias("spot")))
    joined = near.join(by_id, near["id"].eqNullSafe(by_id["id"])).select("wish", "text")
    return stored(joined.mapInArrow(run, "key binary, bag binary").dropDuplicates(["key"]))


@F.pandas_udf(DoubleType())
def _agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    same = [
        np.mean(np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8)) for x, y in zip(a, b)
    ]
    return pd.Series(same, dtype="float64")


@F.pandas_udf(DoubleType())
def _jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b):
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        common = len(np.intersect1d(x, y, assume_unique=True))
        out.append(common / (len(x) + len(y) - common))
    return pd.Series(out, dtype="float64")


def _across(threshold: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Links between components within the buckets of a cell, by exact similarity."""

    def run(cell: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, group in cell.groupby("bucket", sort=False):
            if len(group) < 2 or group["label"].nunique() < 2:
                continue
            bags = [np.frombuffer(x, np.uint64) for x in group["bag"]]
            keys, side = group["key"].tolist(), group["side"].to_numpy()
            labels = pd.factorize(group["label"])[0]
            sizes = np.array([len(x) for x in bags])
            _, place = np.unique(np.concatenate(bags), return_inverse=True)
            owner = np.repeat(np.arange(len(bags)), sizes)
            ends = np.cumsum(sizes)
            has = np.zeros(place.max() + 1, bool)
            # A large component needs no comparison with itself: start from the small ones.
            often = np.bincount(labels)
            for x in np.argsort(often[labels], kind="stable"):
                own = place[ends[x] - sizes[x] : ends[x]]
                has[own] = True
                common = np.bincount(owner[has[place]], minlength=len(bags))
                has[own] = False
                similar = common / (sizes + sizes[x] - common) >= threshold
                similar &= labels != labels[x]
                if side.any():  # two blocks of a large bucket: only pairs between them
                    similar &= side != side[x]
                for y in np.flatnonzero(similar):
                    if labels[y] != labels[x]:
                        found.append((keys[x], keys[y]))
                        labels[labels == labels[y]] = labels[x]
        return pd.DataFrame(found, columns=["a", "b"])

    return run


def _cells(mixed_members: DataFrame) -> DataFrame:
    """Deal members into tasks: many small buckets together, large ones as pairs of blocks."""
    blocks = F.ceil(F.col("n") / BLOCK_MEMBERS).cast("int")
    total = mixed_members.count()
    small_cells = max(1, total // CELL_ROWS)
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    dealt = mixed_members.withColumn("blocks", blocks).withColumn("block", own)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    large = dealt.where("blocks > 1").select("*", other)
    small = dealt.where("blocks = 1").select("*", F.lit(0).alias("other"))
    pair = F.struct(F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    cell = F.when(
        F.col("blocks") == 1, F.struct(F.lit(-1).alias("low"), F.lit(-1).alias("high"))
    ).otherwise(pair)
    at = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("bucket"), F.lit(small_cells))).otherwise(F.col("bucket"))
    side = F.when((F.col("blocks") > 1) & (F.col("block") > F.col("other")), 1).otherwise(0)
    side = F.when((F.col("blocks") > 1) & (F.col("block") == F.col("other")), 0).otherwise(side)
    return small.unionAll(large).select(at.alias("at"), cell.alias("cell"), "bucket", "key", "label", side.alias("side"))


def link_classes(
    docs: DataFrame,
    split: Splitter,
    bag: Bagger,
    sketch: Sketcher,
    banding: Banding,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """All units (as ``sketch_units``, without sketches), and (key, n, label) of all contents.

    ``n`` counts the units of a content; the label of one without a link is its key.
    """
    made = stored(sketch_units(docs, split, sketch, banding, id_col, text_col))
    contents = made.groupBy("key").agg(
        F.min("id").alias("id"),
        F.count(F.lit(1)).alias("n"),
        F.first("bands").alias("bands"),
        F.first("low").alias("low"),
    )
    contents = stored(contents)
    placed = contents.select("key", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("center")).where("n > 1")
    members = stored(placed.join(shared, "bucket"))

    pairs = members.where("key != center").select(F.col("center").alias("a"), F.col("key").alias("b")).distinct()
    low = contents.select("key", "low")
    margin = 4 * math.sqrt(threshold * (1 - threshold) / banding.size)
    estimated = (
        pairs.join(low.toDF("a", "low_a"), "a")
        .join(low.toDF("b", "low_b"), "b")
        .where(_agreement("low_a", "low_b") >= threshold - margin)
        .select("a", "b")
    )
    estimated = stored(estimated)
    wide = members.where("n > 2").select("key")
    nodes = estimated.select(F.col("a").alias("key")).unionAll(estimated.select("b")).unionAll(wide).distinct()
    bags = _bags(docs, nodes.join(contents.select("key", "id"), "key"), split, bag, id_col, text_col)

    verified = (
        estimated.join(bags.toDF("a", "bag_a"), "a")
        .join(bags.toDF("b", "bag_b"), "b")
        .where(_jaccard("bag_a", "bag_b") >= threshold)
        .select("a", "b")
    )
    links = stored(verified)
    labels = stored(components(links))

    labelled = (
        members.where("n > 2")
        .join(labels.withColumnRenamed("node", "key"), "key", "left")
        .select("bucket", "n", "key", F.coalesce("label", "key").alias("label"))
    )
    labelled = stored(labelled)
    unlike = (
        labelled.groupBy("bucket")
        .agg(F.min("label").alias("least"), F.max("label").alias("most"))
        .where("least != most")
        .select("bucket")
    )
    cells = _cells(stored(labelled.join(unlike, "bucket")))
    across = (
        cells.join(bags, "key")
        .groupBy("at", "cell")
        .applyInPandas(_across(threshold), "a binary, b binary")
    )
    everything = components(links.unionAll(across)).toDF("key", "label")
    labelled = contents.select("key", "n").join(everything, "key", "left")
    return made.drop("bands", "low"), stored(labelled.withColumn("label", F.coalesce("label", "key")))

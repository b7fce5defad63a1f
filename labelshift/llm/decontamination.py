"""Benchmark decontamination by SimHash of item-sized windows.

Each benchmark item is a bag of word shingles weighted by how often they occur, with a SimHash
of 128 bits. A document window of as many words as an item is compared with the items of that
size: the fingerprint is cut into 16 blocks of 8 bits, and an item is looked up in each block
under all values within ``radius // 16`` bits. By the pigeonhole principle this finds every item
within ``radius`` bits. Candidates within the radius are verified by exact weighted Jaccard
similarity of the shingles, 0.8 or more.

A window without any shingle of the benchmark has similarity 0 with every item, so only windows
that hold at least one are fingerprinted; this loses nothing at any threshold above 0.
The radius of 36 bits lies four deviations above the expected distance at similarity 0.8.

The items go to the tasks in blocks of bounded size (``BLOCK_WORDS`` words each), with a pass
over the documents for each block, so a larger benchmark costs time and not memory.

A document shorter than an item is one window, compared with its own number of shingles, as long
as the similarity can still reach the threshold; such windows are verified without the radius,
because a fingerprint of fewer shingles lies farther away.

Cases: items without words are left out; items of fewer than five words match as the shingle of
all their words. Null and empty documents have no windows. Repeated items and repeated documents
each give their own rows; rows with a null id are matched like any other. An empty benchmark or
document table gives no rows. Of overlapping windows that match one item the most similar one
counts; among equals the first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .book import query, table
from .words import SHINGLE, WordHashes, hashed, mixed, shingles, texts, weighted_jaccard, words

BITS = 128
BLOCKS = BITS // 8
RADIUS = 36
THRESHOLD = 0.8
BLOCK_WORDS = 200_000
_BITMAP = 1 << 20


def bit_signs(elements: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of the fingerprint's bits of each element."""
    halves = np.stack([mixed(elements + np.uint64(k)) for k in range(BITS // 64)], axis=1)
    bits = np.unpackbits(halves.view(np.uint8), axis=1)
    return bits.astype(np.int8) * 2 - 1


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """Rows of 16 bytes from rows of 128 sums of signs."""
    return np.packbits(sums > 0, axis=1)


def near_values(blocks: np.ndarray, within: int) -> np.ndarray:
    """[block, value, item]: whether the item's block is within so many bits of the value."""
    ones = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1)
    values = np.arange(256, dtype=np.uint8)
    return ones[values[None, :, None] ^ blocks.T[:, None, :]] <= within


class Items:
    """A block of items, arranged by window size."""

    def __init__(self, rows: list[tuple], radius: int, threshold: float):
        self.radius, self.threshold = radius, threshold
        hashes = WordHashes()
        self.by_size: dict[int, list[tuple]] = {}
        for item_id, text in rows:
            ids = hashed(words(text), hashes)
            if len(ids):
                self.by_size.setdefault(len(ids), []).append((item_id, shingles(ids)))
        self.tables = {}
        every: dict[int, list[np.ndarray]] = {}
        for size, items in self.by_size.items():
            prints = np.concatenate(
                [fingerprints(bit_signs(found).sum(axis=0, dtype=np.int32)[None, :]) for _, found in items]
            )
            self.tables[size] = (prints, near_values(prints, radius // BLOCKS))
            every.setdefault(min(size, SHINGLE), []).extend(found for _, found in items)
        self.bags = {
            size: [np.unique(found, return_counts=True) for _, found in items]
            for size, items in self.by_size.items()
        }
        self.known = {}
        for width, found in every.items():
            values = np.unique(np.concatenate(found))
            bitmap = np.zeros(_BITMAP, bool)
            bitmap[values % np.uint64(_BITMAP)] = True
            self.known[width] = (values, bitmap)

    def matches(self, ids: np.ndarray) -> Iterator[tuple]:
        """(item_id, first word, words, differing bits, similarity) of a document's windows."""
        for width, (values, bitmap) in self.known.items():
            if len(ids) < width:
                continue
            grams = shingles(ids, width)
            maybe = np.flatnonzero(bitmap[grams % np.uint64(_BITMAP)])
            if not len(maybe):
                continue
            at = np.searchsorted(values, grams[maybe])
            hits = maybe[values[np.minimum(at, len(values) - 1)] == grams[maybe]]
            if len(hits):
                for size in self.by_size:
                    if min(size, SHINGLE) == width and len(ids) >= size:
                        yield from self._of_size(size, size - width + 1, grams, hits)
                    elif min(size, SHINGLE) == width and len(grams) >= self.threshold * (size - width + 1):
                        yield from self._whole(size, len(ids), grams)

    def _whole(self, size: int, n_words: int, grams: np.ndarray) -> Iterator[tuple]:
        """A document shorter than the items of this size, as one window."""
        window, counts = np.unique(grams, return_counts=True)
        own = fingerprints(bit_signs(grams).sum(axis=0, dtype=np.int32)[None, :])
        differing = np.bitwise_count(own ^ self.tables[size][0]).sum(axis=1, dtype=np.int32)
        for i, bag in enumerate(self.bags[size]):
            similarity = weighted_jaccard((window, counts), bag)
            if similarity >= self.threshold:
                yield self.by_size[size][i][0], 0, n_words, int(differing[i]), similarity

    def _of_size(self, size: int, n: int, grams: np.ndarray, hits: np.ndarray) -> Iterator[tuple]:
        last = len(grams) - n
        touched = np.zeros(len(grams) + 1, np.int32)  # windows that hold a hit
        np.add.at(touched, np.maximum(hits - n + 1, 0), 1)
        np.add.at(touched, hits + 1, -1)
        starts = np.flatnonzero(np.cumsum(touched)[: last + 1] > 0)
        prints, near = self.tables[size]
        found: dict[int, list[tuple]] = {}
        for part in np.array_split(starts, len(starts) // 4096 + 1):
            if not len(part):
                continue
            low = part[0]
            sums = np.zeros((part[-1] + n - low + 1, BITS), np.int32)
            np.cumsum(bit_signs(grams[low : part[-1] + n]), axis=0, dtype=np.int32, out=sums[1:])
            windows = fingerprints(sums[part - low + n] - sums[part - low])
            close = near[0][windows[:, 0]]
            for block in range(1, BLOCKS):
                close = close | near[block][windows[:, block]]
            w, i = np.nonzero(close)
            differing = np.bitwise_count(windows[w] ^ prints[i]).sum(axis=1, dtype=np.int32)
            inside = differing <= self.radius
            for start, item, bits in zip(
                part[w[inside]].tolist(), i[inside].tolist(), differing[inside].tolist(), strict=True
            ):
                found.setdefault(item, []).append((bits, start))
        for i, places in found.items():
            elements, weights = self.bags[size][i]
            verified = []
            for differing, start in places:
                window, counts = np.unique(grams[start : start + n], return_counts=True)
                _, a, b = np.intersect1d(window, elements, assume_unique=True, return_indices=True)
                common = np.minimum(counts[a], weights[b]).sum()
                similarity = float(common / (2 * n - common))
                if similarity >= self.threshold:
                    verified.append((-similarity, start, differing))
            taken: list[int] = []
            for negative, start, differing in sorted(verified):
                if all(abs(start - other) >= size for other in taken):
                    taken.append(start)
                    yield self.by_size[size][i][0], start, size, differing, -negative


def _item_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """Items in blocks of about ``BLOCK_WORDS`` words; the driver holds one block at a time."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    items = benchmark.select(F.col(id_col).alias("id"), text.alias("text"))
    total = items.agg(F.sum(F.length("text") / 4 + 1)).first()[0] or 0
    blocks = int(total // BLOCK_WORDS) + 1
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("text", "id"), F.lit(blocks)) == block)
        rows = [(row.id, row.text.encode()) for row in part.orderBy("id", "text").collect()]
        if rows:
            yield rows


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text_col: str = "text",
    radius: int = RADIUS,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """doc_id, item_id, first_word, n_words, differing_bits, similarity of each matched window."""
    spark = docs.sparkSession
    selected = docs.select(F.col(doc_id).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kinds = [
        frame.schema[name].dataType.simpleString()
        for frame, name in ((docs, doc_id), (benchmark, item_id))
    ]
    schema = (
        f"doc_id {kinds[0]}, item_id {kinds[1]}, first_word long, n_words long,"
        " differing_bits int, similarity double"
    )
    found = spark.createDataFrame([], schema)
    for rows in _item_blocks(benchmark, item_id, text_col):
        items = spark.sparkContext.broadcast(Items(rows, radius, threshold))
        found = found.unionAll(selected.mapInArrow(_matcher(items, schema), schema))
    return found


def _matcher(items, schema: str):
    names = [part.split()[0] for part in schema.split(", ")]

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, block = WordHashes(), items.value
        item_type = None
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
                for row in block.matches(hashed(words(text), hashes)):
                    out.append((doc, *row))
            if out:
                columns = list(zip(*out, strict=True))
                item_type = item_type or pa.array(columns[1]).type
                kinds = [batch.schema.field(0).type, item_type, pa.int64(), pa.int64(), pa.int32(), pa.float64()]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return match


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    item_id: str = "item_id",
    text_col: str = "text",
    radius: int = RADIUS,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """The documents, with all their columns, that hold no passage of the benchmark."""
    kept = docs
    for rows in _item_blocks(benchmark, item_id, text_col):
        items = docs.sparkSession.sparkContext.broadcast(Items(rows, radius, threshold))
        kept = kept.mapInArrow(_clean_rows(items, text_col), docs.schema)
    return kept


def _clean_rows(items, text_col: str):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, block = WordHashes(), items.value
        for batch in batches:
            clean = [
                next(block.matches(hashed(words(text), hashes)), None) is None
                for text in texts(batch, text_col)
            ]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return keep


@query("op6_simhash_leaks")
def op6_simhash_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every window of a document that repeats a benchmark item."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

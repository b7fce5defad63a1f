"""Repeated passages: lines that are equal or nearly equal, and runs of words across and inside lines.

*Lines.* A paragraph is a line of at least ``min_words`` words. Its set of five-word shingles is
compared by exact Jaccard similarity with those it meets by MinHash banding, tuned for a recall of
``RECALL`` at the threshold and more above it. The removals are clustered by connected components. The
first paragraph of a cluster, by document id and place, stays.

*Passages.* Whatever the line ends, windows of ``WINDOW`` words are compared by their words. They
start where the hash of a five-word shingle is the least of ``REACH`` in a row, so every run of
``WINDOW + REACH - 1`` = 25 words that two places share holds a window that both have. A passage of
50 words or more with words replaced and a Jaccard similarity of 0.8 or more keeps such a run, as
each replaced word costs five shingles. Windows that overlap a removed line are set aside first;
of the others with equal words (similarity 1) the first stays.

Cases: null and empty texts have no paragraphs. A row with a null id counts after all others.
Rows that repeat an id and its text hold the same paragraphs, so their paragraphs are in one
cluster; those of the first place stay in each such row. Clusters of one paragraph are not
reported. An empty table gives no rows. Columns other than the id and the text are passed
through by ``remove_repeats`` and otherwise not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .book import query, table
from .near import THRESHOLD, Sketcher, Splitter, Unit, identified, link_classes, text_hash, tune
from .skew import join_groups, split_among
from .storage import stored
from .words import MULTIPLIER, mixed, shingles, shingles_of_units, texts, word_hashes, word_spans, words

MIN_WORDS = 5
RECALL = 0.995
SKETCH = 24
WINDOW = 13
REACH = 13


def paragraphs(min_words: int) -> Splitter:
    def split(text: bytes) -> Iterator[Unit]:
        start = 0
        for number, line in enumerate(text.split(b"\n")):
            # The bytes of a word and the space after it take two at least.
            if len(line) >= 2 * min_words - 1:
                tokens = words(line)
                if len(tokens) >= min_words:
                    yield Unit(number, start, start + len(line), tokens)
            start += len(line) + 1

    return split


def shingle_set(ids: np.ndarray) -> np.ndarray:
    return np.unique(shingles(ids))


def min_hashes(k: int) -> Sketcher:
    seeds = mixed(np.arange(1, k + 1, dtype=np.uint64) * MULTIPLIER)

    def sketch(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        elements, counts = shingles_of_units(ids, lengths)
        firsts = np.cumsum(counts) - counts
        out = np.empty((len(lengths), k), np.uint64)
        for place, seed in enumerate(seeds):
            values = (elements ^ seed) * (seed | np.uint64(1))
            out[:, place] = np.minimum.reduceat(values ^ (values >> np.uint64(32)), firsts)
        return mixed(out)

    return sketch


def _clustered(placed: DataFrame, unit: str) -> DataFrame:
    """The rows of each ``label`` with two places or more: cluster_id, cluster_size, removed."""
    place = F.struct(
        F.col("id.id").isNull().alias("unnamed"), F.col("id.id").alias("id"), F.col("id.text").alias("text"), F.col(unit)
    )
    clusters = (
        placed.groupBy("label")
        .agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("cluster_size"))
        .where("cluster_size > 1")
    )
    return join_groups(placed, stored(clusters), "label", "cluster_size").select(
        "id",
        F.col("unit").alias("paragraph"),
        "start",
        "stop",
        "n_words",
        F.col("first.id").alias("cluster_id"),
        "cluster_size",
        (~place.eqNullSafe(F.col("first"))).alias("removed"),
    )


def _repeated_lines(identified: DataFrame, min_words: int, threshold: float) -> DataFrame:
    banding = tune(threshold, RECALL, SKETCH)
    units, labels = link_classes(
        identified, paragraphs(min_words), shingle_set, min_hashes(banding.size), banding, threshold, "id", "text"
    )
    placed = stored(
        join_groups(units, labels, "key").select("id", "unit", "start", "stop", "n_words", "label")
    )
    return _clustered(placed, "unit")


def repeated_paragraphs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = MIN_WORDS,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """id, paragraph, start, stop (bytes), n_words, cluster_id, cluster_size, removed of each
    paragraph that others repeat; cluster_id is the id of the document whose paragraph stays."""
    lines = _repeated_lines(identified(docs, id_col, text_col), min_words, threshold)
    return lines.withColumn("id", F.col("id.id"))


def _sliding(values: np.ndarray, size: int, better: np.ufunc) -> np.ndarray:
    """The best of every ``size`` values in a row, by doubling."""
    found, reach = values, 1
    while 2 * reach <= size:
        found, reach = better(found[: len(found) - reach], found[reach:]), 2 * reach
    rest = size - reach
    return better(found[: len(found) - rest], found[rest:]) if rest else found


def anchors(grams: np.ndarray) -> np.ndarray:
    """Places that are the least of some ``REACH`` shingles in a row."""
    if len(grams) < REACH:
        return np.empty(0, np.int64)
    least = _sliding(grams, REACH, np.minimum)
    # A place is least in one of its rows if the greatest of their least values is its own.
    edge = np.zeros(REACH - 1, np.uint64)
    return np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), REACH, np.maximum) == grams)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id and the windows of each text: hash of the words, first word."""
    for batch in batches:
        keys, firsts, counts = [], [], []
        for text in texts(batch):
            ids = word_hashes(text)
            at = anchors(shingles(ids))
            at = at[at + WINDOW <= len(ids)]
            keys.append(shingles(ids, WINDOW)[at] if len(at) else np.empty(0, np.uint64))
            firsts.append(at)
            counts.append(len(at))
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        if offsets[-1]:
            arrays = [
                batch.column(0),
                pa.ListArray.from_arrays(offsets, np.concatenate(keys).view(np.int64)),
                pa.ListArray.from_arrays(offsets, np.concatenate(firsts).astype(np.int32)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "hash", "first"])


def _placed_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wanted windows with their bytes, line and exact words."""
    for batch in batches:
        rows = []
        ids = batch.column(0)
        for row, (text, wanted) in enumerate(zip(texts(batch), batch.column(2).to_pylist(), strict=True)):
            starts, ends = word_spans(text)
            places = np.array(wanted)
            begins, stops = starts[places], ends[places + WINDOW - 1]
            lines = np.searchsorted(np.flatnonzero(np.frombuffer(text, np.uint8) == 10), begins)
            for start, stop, line in zip(begins.tolist(), stops.tolist(), lines.tolist(), strict=True):
                content = xxhash.xxh3_128_digest(b" ".join(words(text[start:stop])))
                rows.append((row, line, start, stop, WINDOW, content))
        if rows:
            row, *columns = zip(*rows, strict=True)
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            arrays = [ids.take(pa.array(row)), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "unit", "start", "stop", "n_words", "label"])


def _repeated_windows(identified: DataFrame, lines: DataFrame) -> DataFrame:
    kind = identified.schema["id"].dataType.simpleString()
    found = stored(identified.mapInArrow(_windows, f"id {kind}, hash array<long>, first array<int>"))
    counted = found.select(F.explode("hash").alias("hash")).groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    twice = stored(counted.where("n > 1"))
    each = found.select("id", F.inline(F.arrays_zip("hash", "first")))
    near, _ = split_among(each, F.xxhash64("hash"), twice.select(F.xxhash64("hash").alias("spot")))
    wanted = join_groups(near, twice, "hash").groupBy("id").agg(F.collect_set("first").alias("wanted"))
    wanted = stored(wanted)
    spot = F.xxhash64("id")
    held, _ = split_among(identified, spot, wanted.select(spot.alias("spot")))
    windows = held.join(wanted, "id").select("id", "text", "wanted").mapInArrow(
        _placed_windows, f"id {kind}, unit int, start long, stop long, n_words int, label binary"
    )
    gone = lines.where("removed").groupBy("id").agg(F.collect_set(F.struct("start", "stop")).alias("gone"))
    apart = F.expr("gone is null or not exists(gone, x -> x.start < stop and start < x.stop)")
    return _clustered(stored(windows.join(gone, "id", "left").where(apart).drop("gone")), "start")


def _passages(named: DataFrame, min_words: int, threshold: float) -> DataFrame:
    lines = stored(_repeated_lines(named, min_words, threshold))
    windows = _repeated_windows(named, lines)
    return lines.withColumn("kind", F.lit("line")).unionAll(windows.withColumn("kind", F.lit("window")))


def repeated_passages(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = MIN_WORDS,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """The rows of ``repeated_paragraphs`` (kind ``line``), and of the windows across and inside lines
    that others repeat (kind ``window``; ``paragraph`` is the line in which it starts)."""
    found = _passages(identified(docs, id_col, text_col), min_words, threshold)
    return found.withColumn("id", F.col("id.id"))


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = MIN_WORDS,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """The documents with all their columns, without the lines and windows found to repeat others.

    Spans belong to an id and its text; only rows that may have some are moved.
    """
    found = _passages(identified(docs, id_col, text_col), min_words, threshold).where("removed")
    spans = stored(
        found.groupBy("id").agg(F.sort_array(F.collect_set(F.struct("start", "stop", "kind"))).alias("spans"))
    ).select(F.col("id.id").alias("cut_id"), F.col("id.text").alias("cut_text"), "spans")
    rows = docs.select(F.struct("*").alias("row"), text_hash(text_col).alias("own"))
    here = F.xxhash64(F.col(f"row.`{id_col}`"), F.col("own"))
    maybe, others = split_among(rows, here, spans.select(F.xxhash64("cut_id", "cut_text").alias("spot")))
    same = maybe[f"row.`{id_col}`"].eqNullSafe(spans["cut_id"]) & (maybe["own"] == spans["cut_text"])
    joined = maybe.join(spans, same, "left")
    cut = joined.select(F.col(f"row.`{text_col}`").cast("string").alias("text"), "spans", "row").mapInArrow(
        _without_spans, "text string, row " + rows.schema[0].dataType.simpleString()
    )
    changed = cut.select(
        *[
            F.col("text").alias(name) if name == text_col else F.col(f"row.`{name}`").alias(name)
            for name in docs.columns
        ]
    )
    return others.select("row.*").unionAll(changed)


def _without_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        present = batch.column(0).is_valid().to_pylist()
        for text, spans, there in zip(texts(batch), batch.column(1).to_pylist(), present, strict=True):
            parts, at = [], 0
            for span in spans or []:
                parts.append(text[at : span["start"]])
                # A line goes with its line end; windows may overlap.
                at = max(at, span["stop"] + (span["kind"] == "line"))
            out.append((b"".join([*parts, text[at:]])).decode() if there else None)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), batch.column(2)], ["text", "row"])


@query("op1_paragraph_repeats")
def op1_paragraph_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that repeat or nearly repeat, and repeated runs of words across and inside lines."""
    return repeated_passages(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")

"""Language-model scores by prediction by partial matching over bytes.

The text that is scored is the text's words (see ``words``), a space between two and an end
symbol after the last; the context before the first byte is end symbols. The model is a trie of
byte contexts of order 5 to 0 with training counts. The probability of a byte is read at the
longest context in which it was seen; each longer context that training saw without it costs an
escape, with the estimate ``distinct / (total + distinct)``, and the bytes seen there are
excluded from the shorter contexts. What no context saw shares the escape of order 0 evenly. So
the probabilities over the 256 byte values sum to one in each context.

How it scales. The model is fixed before scoring, so a byte's probability depends on its last six
bytes (a gram) only. Documents are dealt into chunks of bounded text size; a chunk sends each
distinct gram and word once, with its training count. Grams are counted by a shuffled aggregate,
and scored in shards that hold all grams with the same three bytes before the last, so that
contexts of order 3 to 5 are complete within a shard; the tables of order 2 to 0 have at most
2**24 entries (three bytes) at any size of the corpus and are broadcast. The scores go back to
the chunks that asked for them. Neither the trie nor the vocabulary meets in one place.

Words are told apart by 63 bits of a hash. Chunks follow a hash of id and text.

Cases: null and empty texts are the end symbol alone. Documents with a null id are training
documents. Repeated rows each count and each get a score; rows that repeat both id and text share
a chunk. Without training documents every byte has probability 1/256. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .book import query, table
from .storage import stored
from .words import WordHashes, hashed, texts, words

ORDER = 5
END = 10
CHUNK_BYTES = 32_000_000
BATCH_BYTES = 1_500_000
SHARD_GRAMS = 400_000
_WORD = np.uint64(1 << 63)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _mask(order: int) -> np.uint64:
    return np.uint64((1 << (8 * (order + 1))) - 1)


def grams(token_lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The gram that ends at each byte of the given texts, and where each text starts."""
    pad = bytes([END]) * ORDER
    parts = [pad + b" ".join(tokens) + bytes([END]) for tokens in token_lists]
    sizes = np.array([len(part) for part in parts])
    data = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint64)
    codes = data.copy()
    for k in range(1, ORDER + 1):
        codes[k:] |= data[:-k] << np.uint64(8 * k)
    starts = np.cumsum(sizes) - sizes
    keep = np.ones(len(data), bool)
    for k in range(ORDER):
        keep[starts + k] = False
    return codes[keep], starts - np.arange(len(parts)) * ORDER


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with their summed counts."""
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    keys, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    counts = np.bincount(place, np.concatenate([p[1] for p in parts]), len(keys))
    return keys, counts.astype(np.int64)


def counted(keys: np.ndarray, train: bool) -> tuple[np.ndarray, np.ndarray]:
    found, n = np.unique(keys, return_counts=True)
    return found, n if train else np.zeros(len(found), np.int64)


class Trie:
    """Counts by order, as sorted arrays; built from the counts of each order's grams."""

    def __init__(self, levels: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.levels = levels
        self.contexts = {}
        for k, (codes, n) in levels.items():
            contexts, first = np.unique(codes >> np.uint64(8), return_index=True)
            totals = np.add.reduceat(n, first) if len(n) else n
            distinct = np.diff(np.append(first, len(codes)))
            excluded = None
            if k + 1 in levels:  # counts, at this order, of the bytes seen in each longer context
                longer, _ = levels[k + 1]
                place = np.searchsorted(codes, longer & _mask(k))
                _, begin = np.unique(longer >> np.uint64(8), return_index=True)
                excluded = np.add.reduceat(n[place], begin) if len(longer) else n[:0]
            self.contexts[k] = (contexts, totals, distinct, excluded)

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's last byte after the bytes before it."""
        score, open_ = np.zeros(len(codes)), np.ones(len(codes), bool)
        longer_at = np.zeros(len(codes), np.int64)
        longer_seen, longer_distinct = np.zeros(len(codes), bool), np.zeros(len(codes))
        for k in range(ORDER, -1, -1):
            contexts, totals, distinct, excluded = self.contexts[k]
            code = codes & _mask(k)
            at, seen = _find(contexts, code >> np.uint64(8))
            all_distinct = np.where(seen, _take(distinct, at), 0.0)
            total = np.where(seen, _take(totals, at), 0.0)
            if excluded is not None:
                total = total - np.where(longer_seen, _take(excluded, longer_at), 0.0)
            fresh = all_distinct - longer_distinct
            place, hit = _find(self.levels[k][0], code)
            active = open_ & (fresh > 0)
            final, escape = active & hit, active & ~hit
            count = _take(self.levels[k][1], place[final])
            score[final] += np.log10(count / (total[final] + fresh[final]))
            score[escape] += np.log10(fresh[escape] / (total[escape] + fresh[escape]))
            open_ &= ~final
            longer_at, longer_seen, longer_distinct = at, seen, all_distinct
        score[open_] -= math.log10(256 - len(self.levels[0][0]))
        return score


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _take(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    return values[at] if len(values) else np.zeros(len(at))


class Lookup:
    """Values by 64-bit key, by open addressing; every key asked for is present."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2.2 * len(keys)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits)
        used = np.zeros(1 << bits, bool)
        slots = self._slots(keys)
        while len(keys):
            taken = used[slots]
            _, first = np.unique(slots, return_index=True)
            put = np.zeros(len(keys), bool)
            put[first] = True
            put &= ~taken
            self.keys[slots[put]], self.values[slots[put]] = keys[put], values[put]
            used[slots[put]] = True
            keys, values, slots = keys[~put], values[~put], (slots[~put] + 1) & self.last

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _SPREAD) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slots = self._slots(keys)
        out = self.values[slots]
        left = np.flatnonzero(self.keys[slots] != keys)
        slots = slots[left]
        while len(left):
            slots = (slots + 1) & self.last
            found = self.keys[slots] == keys[left]
            out[left[found]] = self.values[slots[found]]
            left, slots = left[~found], slots[~found]
        return out


def _portions(documents: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Documents (..., text) in lists of bounded bytes."""
    held, size = [], 0
    for document in documents:
        held.append(document)
        size += len(document[-1])
        if size >= BATCH_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _word_keys(tokens: list[bytes], hashes: WordHashes) -> np.ndarray:
    return hashed(tokens, hashes) | _WORD


def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, key, n) of each distinct gram and word of a partition's documents."""
    hashes = WordHashes()
    chunk, parts, waiting = 0, [], 0

    def documents() -> Iterator[tuple]:
        nonlocal chunk
        for batch in batches:
            if batch.num_rows:
                chunk = batch.column(0)[0].as_py()
            yield from zip(batch.column(1).to_pylist(), texts(batch), strict=True)

    for portion in _portions(documents()):
        for train in (True, False):
            lists = [words(text) for held_out, text in portion if held_out != train]
            if lists:
                parts.append(counted(grams(lists)[0], train))
                parts.append(counted(_word_keys([w for tokens in lists for w in tokens], hashes), train))
                waiting += len(parts[-1][0]) + len(parts[-2][0])
        if waiting > 2_000_000:
            parts = [merged(parts)]
            waiting = len(parts[0][0])
    keys, n = merged(parts)
    for start in range(0, len(keys), 200_000):
        k, c = keys[start : start + 200_000].view(np.int64), n[start : start + 200_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(k), chunk, np.int32)), pa.array(k), pa.array(c)], ["chunk", "key", "n"]
        )


def train_and_score(
    docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row.

    The model and the word counts come from the rows that are not held out.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    size, n_train = docs.agg(
        F.coalesce(F.sum(F.octet_length(text) + 1), F.lit(0)), F.count(F.when(~held_out, 1))
    ).first()
    chunks = int(size // CHUNK_BYTES) + 1
    dealt = docs.select(
        F.pmod(F.xxhash64(F.col(id_col), text), F.lit(chunks)).cast("int").alias("chunk"),
        F.col(id_col).alias("id"),
        held_out.alias("held_out"),
        text.alias("text"),
    )
    asked = stored(
        dealt.select("chunk", "held_out", "text")
        .repartitionById(chunks, F.col("chunk"))
        .mapInArrow(_ask, "chunk int, key long, n long")
    )
    totals = stored(asked.groupBy("key").agg(F.sum("n").alias("n")))
    gram_counts, word_counts = totals.where("key >= 0"), totals.where("key < 0")
    n_grams = gram_counts.count()
    tokens, vocabulary = word_counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))
    ).first()
    tokens, vocabulary = tokens + n_train, vocabulary + (n_train > 0)

    seen = gram_counts.where("n > 0")
    short = seen.groupBy(F.col("key").bitwiseAND(int(_mask(2))).alias("key")).agg(F.sum("n").alias("n"))
    low = short.toPandas()  # at most 2**24 rows: three bytes
    codes, n = low["key"].to_numpy(np.uint64), low["n"].to_numpy(np.int64)
    lowest = {k: merged([(codes & _mask(k), n)]) for k in range(3)}
    shared = spark.sparkContext.broadcast(lowest)

    def score_shard(rows: pd.DataFrame) -> pd.DataFrame:
        codes, n = rows["key"].to_numpy(np.uint64), rows["n"].to_numpy(np.int64)
        known, times = codes[n > 0], n[n > 0]
        high = {k: merged([(known & _mask(k), times)]) for k in range(3, ORDER + 1)}
        return pd.DataFrame({"key": codes.view(np.int64), "value": Trie(shared.value | high).log10(codes)})

    three = F.shiftright("key", 8).bitwiseAND((1 << 24) - 1)
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_grams // SHARD_GRAMS + 1)
    scores = (
        gram_counts.select("key", "n", F.pmod(F.xxhash64(three), F.lit(shards)).alias("shard"))
        .groupBy("shard")
        .applyInPandas(score_shard, "key long, value double")
    )
    values = scores.unionAll(word_counts.select("key", F.col("n").cast("double").alias("value")))
    answers = asked.select("chunk", "key").join(values, "key").select("chunk", "key", "value")
    kind = dealt.schema["id"].dataType.simpleString()
    schema = (
        f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long,"
        " base_score double, score double"
    )
    names = [part.split()[0] for part in schema.split(", ")]
    denominator = tokens + vocabulary + 1

    def score_chunk(documents: pa.Table, known: pa.Table) -> pa.Table:
        keys = known.column("key").to_numpy().view(np.uint64)
        lookup = Lookup(keys, known.column("value").to_numpy())
        hashes = WordHashes()
        n_tokens, n_known, base, score = [], [], [], []
        end = math.log10((n_train + 1) / denominator)
        held = (
            (text,) for batch in documents.select(["text"]).to_batches(max_chunksize=1000) for text in texts(batch)
        )
        for portion in _portions(held):
            lists = [words(text) for (text,) in portion]
            codes, starts = grams(lists)
            score.append(np.add.reduceat(lookup(codes), starts))
            sizes = np.array([len(tokens) for tokens in lists])
            counts = lookup(_word_keys([w for tokens in lists for w in tokens], hashes))
            owner = np.repeat(np.arange(len(lists)), sizes)
            n_tokens.append(sizes + 1)
            n_known.append(np.bincount(owner, counts > 0, len(lists)).astype(np.int64) + (n_train > 0))
            base.append(np.bincount(owner, np.log10((counts + 1) / denominator), len(lists)) + end)
        n_rows = documents.num_rows
        arrays = [pa.array(np.concatenate(x)) for x in (n_tokens, n_known)]
        arrays += [pa.array(np.full(n_rows, tokens, np.int64))]
        arrays += [pa.array(np.concatenate(x)) for x in (base, score)]
        return pa.Table.from_arrays(
            [documents.column("id").combine_chunks(), documents.column("held_out").combine_chunks(), *arrays], names
        )

    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score_chunk, schema)


@query("op5_partial_matching")
def op5_partial_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learnt from those outside the held-out fold."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    held_out = F.coalesce(fold == 2, F.lit(False))
    return train_and_score(table(spark, sf_dir, "documents"), held_out).withColumnRenamed("id", "doc_id")

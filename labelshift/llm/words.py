"""Words of a text as hashed integers, and shingles of words, in numpy inside tasks.

A word is a longest run of bytes other than space and the control codes 9 to 13. A-Z are
lower-cased. Null and empty texts have no words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

SHINGLE = 5
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Remembered(dict):
    """What was made of a word, so that a repeated word costs a lookup.

    Holds at most two generations of ``LIMIT`` words; a word that comes again stays.
    """

    LIMIT = 100_000

    def __init__(self) -> None:
        super().__init__()
        self.older: dict = {}

    def make(self, word: bytes):
        raise NotImplementedError

    def __missing__(self, word: bytes):
        value = self.older.get(word)
        if value is None:
            value = self.make(word)
        if len(self) >= self.LIMIT:
            self.older = dict(self)
            self.clear()
        self[word] = value
        return value


class WordHashes(Remembered):
    """Word to 64-bit hash."""

    def make(self, word: bytes) -> int:
        return xxhash.xxh3_64_intdigest(word)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a string column; null becomes empty."""
    values = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
    return [value or b"" for value in values.to_pylist()]


def words(text: bytes) -> list[bytes]:
    return text.lower().split()


def hashed(tokens: list[bytes], hashes: WordHashes) -> np.ndarray:
    return np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens))


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_spans(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins and ends."""
    inside = np.zeros(len(text) + 2, np.int8)
    inside[1:-1] = ~_IS_SPACE[np.frombuffer(text, np.uint8)]
    turns = np.diff(inside)
    return np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _byte_values() -> np.ndarray:
    """A 64-bit value for each byte, the same for a letter A-Z and its lower case."""
    codes = np.arange(256, dtype=np.uint64)
    codes[65:91] += np.uint64(32)
    return mixed(codes + MULTIPLIER)


_BYTE_VALUES = _byte_values()


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word (letters A-Z lower-cased), from all bytes of the text at once."""
    starts, ends = word_spans(text)
    if not len(starts):
        return np.empty(0, np.uint64)
    data = np.frombuffer(text, np.uint8)
    sizes = ends - starts
    firsts = np.cumsum(sizes) - sizes
    place = np.arange(firsts[-1] + sizes[-1]) - np.repeat(firsts, sizes)
    powers = np.cumprod(np.full(int(sizes.max()), MULTIPLIER), dtype=np.uint64)
    values = _BYTE_VALUES[data[~_IS_SPACE[data]]] * powers[place]
    return mixed(np.add.reduceat(values, firsts) + sizes.astype(np.uint64))


def shingles(ids: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """A hash for each run of ``size`` words, in text order.

    A text of fewer words has one shingle, of all its words; a text without words has none.
    """
    n = len(ids)
    if n == 0:
        return np.empty(0, np.uint64)
    size = min(size, n)
    rolled = ids[: n - size + 1].copy()
    for i in range(1, size):
        rolled = rolled * MULTIPLIER + ids[i : n - size + 1 + i]
    return mixed(rolled + np.uint64(size))


def shingles_of_units(ids: np.ndarray, lengths: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """``shingles`` of many texts with one word or more, joined, and how many each has."""
    ends = np.cumsum(lengths)
    starts = ends - lengths
    counts = np.maximum(lengths - size + 1, 1)
    rolled = np.zeros(len(ids), np.uint64)
    if len(ids) >= size:
        whole = ids[: len(ids) - size + 1].copy()
        for i in range(1, size):
            whole = whole * MULTIPLIER + ids[i : len(ids) - size + 1 + i]
        rolled[: len(whole)] = whole
    first = np.cumsum(counts) - counts
    at = np.repeat(starts - first, counts) + np.arange(counts.sum())
    values = mixed(rolled[at] + np.uint64(size))
    for unit in np.flatnonzero(lengths < size):
        values[first[unit]] = shingles(ids[starts[unit] : ends[unit]], size)[0]
    return values, counts


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of smaller over sum of larger weights; each side is sorted elements with weights.

    Two sides without elements are equal (1).
    """
    total = float(a[1].sum() + b[1].sum())
    if total == 0:
        return 1.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = float(np.minimum(a[1][i], b[1][j]).sum())
    return common / (total - common)

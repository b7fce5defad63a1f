"""Cost-balanced packing of tokenised documents into fixed-length training sequences.

The cost of a piece of n tokens is ``linear * n + quadratic * n * n``: feed-forward work plus
attention within the piece. A task tokenises its documents one after the other. Whole multiples
of the sequence length leave a document at once as full sequences. The rests wait in a buffer of
bounded size; when it is full, its pieces in descending order of cost go to the lowest-cost
sequence that still has room for them, pieces that fit nowhere whole are cut over the room that
is left, and what then remains waits for the next buffer. What a task has left at its end, less than
a sequence, is packed with the rests of up to ``RESTS`` tasks, whose last sequence alone is padded.
No text is shuffled, and a task that runs again makes the same sequences.

Cases: null and empty texts consist of the end token alone. Each row is a document of its own,
also where ids repeat or are null; ties in cost keep the order of arrival. An empty table gives
no rows. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import heapq
import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .book import query, table
from .storage import stored
from .words import texts

LENGTH = 4096
BUFFER_SEQUENCES = 256
RESTS = 256  # tasks whose rests are packed together
FLUSH_ROWS = 20_000
CHUNK_ROWS = 256
# What the vocabulary's file says of normalising and splitting.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END_ID = 2
_MARKS = b".,!?;:|#$%&*\"()"
_LOADED: dict[str, WordTokens] = {}


class WordTokens(dict):
    """Token ids (unsigned 32-bit, little-endian bytes) of words between white space.

    The tokenizer lowers letters and splits at white space and between letters and marks, so a word's
    ids do not depend on its neighbours, a run of letters ends in the only token of it that ends a
    word, and trailing marks are encoded apart. Distinct words of a chunk of texts are looked up
    once; new runs of letters are encoded together and cut after the ends of words. A file that
    normalises or splits in another way is refused. Two generations of ``LIMIT`` words are held, and
    the new ones of a chunk.
    """

    LIMIT = 400_000
    TOGETHER = 1_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.older: dict[bytes, bytes] = {}
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        self.suffix = rules["model"].get("end_of_word_suffix")
        kinds = [part["type"] for part in (rules["normalizer"] or {}).get("normalizers", [])]
        splits = [part.get("pattern", {}).get("Regex") for part in (rules["pre_tokenizer"] or {}).get("pretokenizers", [])]
        if kinds != NORMALIZERS or SPLIT not in splits or not self.suffix:
            raise ValueError(f"{path} does not split lower-case words as this packing expects")
        self.tokenizer = Tokenizer.from_file(path)
        n_ids = self.tokenizer.get_vocab_size()
        ends = [(self.tokenizer.id_to_token(i) or "").endswith(self.suffix) for i in range(n_ids)]
        self.ends_word = np.array(ends)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        split = [text.split() if b"<|" in text else text.lower().split() for text in texts]
        self.learn(set().union(*split))
        return [b"".join(map(self.__getitem__, found)) for found in split]

    def learn(self, found: set[bytes]) -> None:
        if len(self) >= self.LIMIT:
            self.older = dict(self)
            self.clear()
        letters, marked, other = [], [], []
        for word in found.difference(self):
            known = self.older.get(word)
            if known is not None:
                self[word] = known
            elif word.decode().isalpha():
                letters.append(word)
            else:
                core = word.rstrip(_MARKS)
                if core != word and b"<|" not in word and core.decode().isalpha():
                    marked.append((word, core))
                else:
                    other.append(word)
        fresh = set(letters)
        for _, core in marked:
            if core not in self and core not in fresh:
                fresh.add(core)
                letters.append(core)
        for at in range(0, len(letters), self.TOGETHER):
            self._learn_letters(letters[at : at + self.TOGETHER])
        for word in other:
            self[word] = self._single(word)
        for word, core in marked:
            marks = word[len(core) :]
            if marks not in self:
                self[marks] = self._single(marks)
            self[word] = self[core] + self[marks]

    def _single(self, word: bytes) -> bytes:
        return array("I", self.tokenizer.encode(word.decode(), add_special_tokens=False).ids).tobytes()

    def _learn_letters(self, found: list[bytes]) -> None:
        """Words of letters alone: each is one run, unless lowering or composing one changes that."""
        if len(found) == 1:
            self[found[0]] = self._single(found[0])
            return
        together = self.tokenizer.encode_batch_fast([b" ".join(found).decode()], add_special_tokens=False)[0].ids
        ids = np.array(together, "<u4")
        stops = np.flatnonzero(self.ends_word[ids]) + 1
        if len(stops) != len(found) or stops[-1] != len(ids):
            middle = len(found) // 2
            self._learn_letters(found[:middle])
            self._learn_letters(found[middle:])
            return
        raw, start = ids.tobytes(), 0
        for word, stop in zip(found, (4 * stops).tolist(), strict=True):
            self[word] = raw[start:stop]
            start = stop


def word_tokens(path: str) -> WordTokens:
    """One cache per worker process, kept from task to task."""
    if path not in _LOADED:
        _LOADED[path] = WordTokens(path)
    return _LOADED[path]


def balance(
    sizes: list[int], sequences: int, length: int, linear: float, quadratic: float
) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int]]]:
    """Pieces (item, start, size) of each sequence, and the parts (item, start) left over.

    ``sizes`` are at most ``length`` each and sum to ``sequences * length`` at least.
    """
    filled: list[list[tuple[int, int, int]]] = [[] for _ in range(sequences)]
    room = [length] * sequences
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    heap = [(0.0, s) for s in range(sequences)]
    unplaced = []
    for item in order:
        size, skipped, placed = sizes[item], [], False
        while heap:
            cost, s = heapq.heappop(heap)
            if room[s] >= size:
                filled[s].append((item, 0, size))
                room[s] -= size
                if room[s]:
                    heapq.heappush(heap, (cost + linear * size + quadratic * size * size, s))
                placed = True
                break
            skipped.append((cost, s))
        for entry in skipped:
            heapq.heappush(heap, entry)
        if not placed:
            unplaced.append(item)
    left = []
    for item in unplaced:
        start = 0
        while heap and start < sizes[item]:
            cost, s = heapq.heappop(heap)
            size = min(room[s], sizes[item] - start)
            filled[s].append((item, start, size))
            room[s] -= size
            start += size
            if room[s]:
                heapq.heappush(heap, (cost + linear * size + quadratic * size * size, s))
        if start < sizes[item]:
            left.append((item, start))
    return filled, left


class Packer:
    """Pieces of documents on their way into sequences; rows of placed pieces gather in ``rows``."""

    def __init__(self, length: int, linear: float, quadratic: float, first_sequence: int):
        self.length, self.linear, self.quadratic = length, linear, quadratic
        self.next_sequence = first_sequence
        self.waiting: list[tuple] = []  # doc_id, start, doc_tokens, ids
        self.tokens = 0
        self.rows: list[tuple] = []

    def add(self, doc_id, start: int, doc_tokens: int, ids: bytes) -> None:
        """Whole sequences leave at once; what is left waits until the buffer is full."""
        n, at = len(ids) // 4, 0
        while n - at >= self.length:
            self._place(0, (doc_id, start + at, doc_tokens, ids[4 * at : 4 * (at + self.length)]))
            self.next_sequence += 1
            at += self.length
        if at < n:
            self.waiting.append((doc_id, start + at, doc_tokens, ids[4 * at :]))
            self.tokens += n - at
        if self.tokens >= BUFFER_SEQUENCES * self.length:
            self.settle()

    def _place(self, offset: int, piece: tuple) -> None:
        doc_id, start, doc_tokens, ids = piece
        n = len(ids) // 4
        cost = self.linear * n + self.quadratic * n * n
        self.rows.append((doc_id, start, n, zlib.crc32(ids), doc_tokens, self.next_sequence, offset, cost, ids))

    def settle(self) -> None:
        """Fill as many sequences as the waiting pieces can."""
        sequences = self.tokens // self.length
        if not sequences:
            return
        sizes = [len(piece[3]) // 4 for piece in self.waiting]
        filled, left = balance(sizes, sequences, self.length, self.linear, self.quadratic)
        for pieces in filled:
            offset = 0
            for item, start, size in pieces:
                doc_id, at, doc_tokens, ids = self.waiting[item]
                self._place(offset, (doc_id, at + start, doc_tokens, ids[4 * start : 4 * (start + size)]))
                offset += size
            self.next_sequence += 1
        self.waiting = [
            (self.waiting[i][0], self.waiting[i][1] + start, self.waiting[i][2], self.waiting[i][3][4 * start :])
            for i, start in left
        ]
        self.tokens = sum(len(piece[3]) // 4 for piece in self.waiting)

    def close(self) -> None:
        """The last pieces, less than a sequence, in a padded one."""
        self.settle()
        offset = 0
        for piece in self.waiting:
            self._place(offset, piece)
            offset += len(piece[3]) // 4
        self.waiting, self.tokens = [], 0


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    end_id: int = END_ID,
    linear: float = 1.0,
    quadratic: float = 1.0 / LENGTH,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, cost.

    ``with_ids`` adds the piece's token ids as ``ids``.
    """
    selected = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = (
        f"doc_id {selected.schema[0].dataType.simpleString()}, start long, length long, ids_crc32 long,"
        " doc_tokens long, sequence_id long, offset long, cost double, ids binary, task int, place int"
    )
    names = [part.split()[0] for part in schema.split(", ")]
    end = np.array([end_id], "<u4").tobytes()

    def placed(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        arrays = [pa.array(columns[0], id_type)]
        arrays += [pa.array(c, pa.int64()) for c in columns[1:7]] + [pa.array(columns[7], pa.float64())]
        arrays.append(pa.array(columns[8], pa.binary()) if with_ids else pa.nulls(len(rows), pa.binary()))
        arrays += [pa.nulls(len(rows), pa.int32())] * 2
        return pa.RecordBatch.from_arrays(arrays, names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(tokenizer_path)
        task = TaskContext.get().partitionId()
        packer = Packer(length, linear, quadratic, task << 32)
        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for part in chunks(batch):
                for doc_id, ids in zip(part.column(0).to_pylist(), tokens.encode(texts(part)), strict=True):
                    packer.add(doc_id, 0, len(ids) // 4 + 1, ids + end)
                if len(packer.rows) >= FLUSH_ROWS:
                    yield placed(packer.rows, id_type)
                    packer.rows.clear()
        packer.settle()
        if packer.rows:
            yield placed(packer.rows, id_type)
        if packer.waiting:  # less than a sequence: joined with those of other tasks
            n = len(packer.waiting)
            ids, starts, sizes, rest = zip(*packer.waiting, strict=True)
            none = pa.nulls(n, pa.int64())
            arrays = [pa.array(ids, id_type), pa.array(starts, pa.int64()), none, none, pa.array(sizes, pa.int64())]
            arrays += [none, none, pa.nulls(n, pa.float64()), pa.array(rest, pa.binary())]
            arrays += [pa.array([task] * n, pa.int32()), pa.array(range(n), pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, names)

    def join(group: pa.Table) -> pa.Table:
        group = group.sort_by([("task", "ascending"), ("place", "ascending")])
        number = group.column("task")[0].as_py() // RESTS
        packer = Packer(length, linear, quadratic, (1 << 62) + (number << 32))
        rows = [group.column(name).to_pylist() for name in ("doc_id", "start", "doc_tokens", "ids")]
        for piece in zip(*rows, strict=True):
            packer.add(*piece)
        packer.close()
        return pa.Table.from_batches([placed(packer.rows, group.schema.field("doc_id").type)])

    made = stored(selected.mapInArrow(pack, schema))
    rests = made.where("task is not null").groupBy(F.floor(F.col("task") / RESTS)).applyInArrow(join, schema)
    pieces = made.where("task is null").unionAll(rests).drop("task", "place")
    if not with_ids:
        return pieces.drop("ids")
    shown = schema[: schema.index(", ids binary")] + ", ids array<long>"
    return pieces.mapInArrow(listed, shown)


def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the last column as lists of numbers."""
    for batch in batches:
        ids = [np.frombuffer(raw, "<u4").tolist() for raw in batch.column(batch.num_columns - 1).to_pylist()]
        columns = [*batch.columns[:-1], pa.array(ids, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, batch.schema.names)


def chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with a bounded number of rows, so that few words are new at a time."""
    for start in range(0, batch.num_rows, CHUNK_ROWS):
        yield batch.slice(start, CHUNK_ROWS)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op4_balanced_packing")
def op4_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary_path())

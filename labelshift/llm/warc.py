"""Web archives (WARC 1.1): pages written as records, archives read back as a table of chunks.

*Writing.* Pages with equal payloads are one ``response`` (the largest id) and ``revisit`` records that
refer to it. Digests are compared in a narrow table; whether a page is a revisit is then looked up
by filters, so a payload leaves its place only where a filter errs. A payload of more than
``CHUNK_BYTES`` is written as a segmented record: the first segment, then continuation records with
the origin's identifier and a segment number, one after the other in the same file. Files are
written by Spark's text writer, whose line separator is the two line ends that close a record, so
a task that runs again replaces its files.

*Reading.* A task streams its archives (plain or gzip, one file in one task) and yields rows of record
identifier, chunk number and at most ``CHUNK_BYTES`` of payload, with the bytes and the SHA-1 digest
of all chunks so far. A record, whatever its length and its segments, is never held whole. The row of
the last chunk bears the digest of the full payload and whether it is the one the archive states.

Cases: a null payload is an empty one; an empty payload has one chunk, without bytes. A null id
comes before all others, so it is a response only where all equal payloads have null ids. Rows that
repeat the id and the payload of a response are responses too, with its identifier. A null address
becomes the record's identifier; white space and control codes in it become ``%20``. An empty table
gives an archive without records. An archive that ends within a record, or holds a continuation
that does not follow its segments, raises. Columns other than the id, the address and the payload
are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .book import query, table
from .skew import join_groups, split_among
from .storage import shared_folder, stored

CHUNK_BYTES = 1 << 20
BATCH_BYTES = 4 << 20
BATCH_ROWS = 2_000
END = "\r\n"
DATE = "2020-01-01T00:00:00Z"
# Fixed values of the WARC 1.1 standard.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in base32: four times ten hexadecimal digits are eight of base 32."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def record_id(page: Column, digest: Column) -> Column:
    name = F.coalesce(F.url_encode(page.cast("string")), F.lit(""))
    return F.concat(F.lit("<urn:page:"), name, F.lit(":"), digest, F.lit(">"))


def page_of(record: Column) -> Column:
    """The page id, as text, in an identifier that ``record_id`` made; null where it has none."""
    name = F.regexp_extract(record, "^<urn:page:([^:]*):", 1)
    return F.when(name != "", F.url_decode(name))


def _lines(*pairs: tuple[str, Column]) -> Column:
    return F.concat(*[F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(END)) for name, value in pairs])


def _http(payload_bytes: Column) -> Column:
    return F.concat(
        F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "),
        payload_bytes.cast("string"),
        F.lit(END + END),
    )


def _record(kind: str, block_bytes: Column, *pairs: tuple[str, Column]) -> Column:
    head = [("WARC-Type", F.lit(kind)), *pairs, ("Content-Length", block_bytes)]
    return F.concat(F.lit(f"WARC/1.1{END}"), _lines(*head), F.lit(END))


def _address(url: Column, record: Column) -> Column:
    clean = F.regexp_replace(url, r"[\x00-\x20\x7F]", "%20")
    return F.coalesce(clean, F.regexp_extract(record, "^<(.*)>$", 1))


def _page_headers(digest: str = "digest") -> list[tuple[str, Column]]:
    own = record_id(F.col("page"), F.col(digest))
    return [
        ("WARC-Record-ID", own),
        ("WARC-Date", F.lit(DATE)),
        ("WARC-Target-URI", _address(F.col("url"), own)),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col(digest))),
        ("Content-Type", F.lit("application/http; msgtype=response")),
    ]


def _responses(pages: DataFrame, chunk_bytes: int) -> DataFrame:
    """``value``: each page as one record, or as its segments in order."""
    http = _http(F.col("payload_bytes"))
    total = F.octet_length(http) + F.col("payload_bytes")
    whole = F.concat(_record("response", total, *_page_headers()), http, F.col("payload"))
    raw = F.col("payload").cast("binary")
    pieces = F.ceil(F.col("payload_bytes") / chunk_bytes).cast("int")

    def segment(n: Column) -> Column:
        part = F.substring(raw, n * chunk_bytes + 1, F.lit(chunk_bytes))
        size = F.octet_length(part)
        first = F.concat(
            _record("response", F.octet_length(http) + size, *_page_headers(), ("WARC-Segment-Number", F.lit(1))), http
        )
        own = record_id(F.col("page"), F.col("digest"))
        later = [
            ("WARC-Record-ID", F.regexp_replace(own, ">$", F.concat(F.lit(":"), n.cast("string"), F.lit(">")))),
            ("WARC-Date", F.lit(DATE)),
            ("WARC-Segment-Origin-ID", own),
            ("WARC-Segment-Number", n + 1),
        ]
        more = F.when(
            n < pieces - 1, _record("continuation", size, *later)
        ).otherwise(_record("continuation", size, *later, ("WARC-Segment-Total-Length", total)))
        return F.concat(F.when(n == 0, first).otherwise(more), part.cast("string"))

    segments = F.transform(F.sequence(F.lit(0), pieces - 1), segment)
    records = F.when(F.col("payload_bytes") > chunk_bytes, segments).otherwise(F.array(whole))
    return pages.select(F.explode(records).alias("value"))


def _revisits(facts: DataFrame) -> DataFrame:
    http = _http(F.col("payload_bytes"))
    refers = ("WARC-Refers-To", record_id(F.col("top"), F.col("digest")))
    head = _record("revisit", F.octet_length(http), *_page_headers(), refers, ("WARC-Profile", F.lit(PROFILE)))
    return facts.select(F.concat(head, http).alias("value"))


def write_archives(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    least_bytes: int = 0,
    chunk_bytes: int = CHUNK_BYTES,
    compression: str = "gzip",
) -> None:
    """A record for each page; equal payloads of ``least_bytes`` and more are one response with revisits."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    whole = pages.select(
        F.col(id_col).alias("page"),
        F.col(url_col).cast("string").alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        base32_sha1(payload).alias("digest"),
    )
    facts = stored(whole.drop("payload"))
    alike = facts.where(F.col("payload_bytes") >= least_bytes)
    groups = alike.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("page").alias("top")).where("n > 1")
    revisits = stored(
        join_groups(alike, stored(groups), "digest").where(~F.col("page").eqNullSafe(F.col("top"))).drop("n")
    )
    spot = F.xxhash64("page", "digest")
    keys = revisits.select(spot.alias("spot"))
    known = revisits.select(F.col("page").alias("known"), F.col("digest").alias("known_digest")).distinct()

    def unknown(rows: DataFrame) -> DataFrame:
        same = (rows["digest"] == known["known_digest"]) & rows["page"].eqNullSafe(known["known"])
        return rows.join(known, same, "left_anti")

    # Pages that the first filter takes for revisits by error are found in the narrow table; only
    # pages that both filters hold move with their payload.
    taken, _ = split_among(facts, spot, keys)
    errors = stored(unknown(taken).select(spot.alias("spot")))
    maybe, certain = split_among(whole, spot, keys)
    both, _ = split_among(maybe, spot, errors)
    records = (
        _responses(certain, chunk_bytes)
        .unionAll(_responses(unknown(both), chunk_bytes))
        .unionAll(_revisits(revisits))
    )
    records.write.option("lineSep", END + END).option("compression", compression).option(
        "maxRecordsPerFile", 0
    ).text(folder)


class Chunk(NamedTuple):
    record_id: str
    record_type: str
    target_uri: str | None
    refers_to: str | None
    chunk: int
    data: bytes | None
    payload_bytes: int | None  # of this chunk and those before it; for a revisit as its HTTP header says
    payload_digest: str | None  # likewise; for a revisit the stated one
    last: bool
    intact: bool | None  # last chunk: the digest is the stated one; null where none is stated


CHUNKS = (
    "record_id string, record_type string, target_uri string, refers_to string, chunk long, data binary,"
    " payload_bytes long, payload_digest string, last boolean, intact boolean"
)
_KINDS = [pa.string()] * 4 + [pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()]


def _fields(stream: BinaryIO) -> tuple[dict[str, str], int]:
    """Header fields, by lower-case name, up to the empty line, and the bytes read."""
    found, size = {}, 0
    while True:
        line = stream.readline()
        size += len(line)
        if not line.strip():
            if not line:
                raise ValueError("An archive ends within a header")
            return found, size
        name, _, value = line.decode("utf-8", "replace").partition(":")
        found[name.strip().lower()] = value.strip()


def _digest(state) -> str:
    return base64.b32encode(state.digest()).decode()


def read_chunks(stream: BinaryIO, chunk_bytes: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The chunks of all records of one archive, in order, from a buffered stream."""
    origin = None  # facts of the record whose segments are being read
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"Not the start of a record: {line[:40]!r}")
        fields, _ = _fields(stream)
        kind, own = fields.get("warc-type"), fields.get("warc-record-id")
        left = int(fields["content-length"])
        segment = int(fields.get("warc-segment-number", 0))
        if kind == "continuation":
            if origin is None or fields.get("warc-segment-origin-id") != origin["id"] or segment != origin["segment"] + 1:
                raise ValueError(f"Continuation {own} does not follow its segments")
            origin["segment"] = segment
        else:
            if origin is not None:
                raise ValueError(f"Record {origin['id']} lacks its last segment")
            origin = {
                "id": own,
                "kind": kind,
                "uri": fields.get("warc-target-uri"),
                "refers": fields.get("warc-refers-to"),
                "stated": fields.get("warc-payload-digest", "").rpartition(":")[2] or None,
                "segment": segment,
                "sha1": hashlib.sha1(),
                "bytes": 0,
                "chunk": 0,
            }
            declared = None
            is_http = fields.get("content-type", "").startswith("application/http")
            if is_http and left and kind in ("response", "revisit"):
                status = stream.readline()
                http, size = _fields(stream)
                left -= len(status) + size
                declared = http.get("content-length")
            if kind == "revisit":
                if len(stream.read(left)) < left:
                    raise ValueError("An archive ends within a record")
                yield Chunk(
                    own, kind, origin["uri"], origin["refers"], 0, None,
                    None if declared is None else int(declared), origin["stated"], True, None,
                )
                origin = None
                continue
        final = origin["segment"] == 0 or "warc-segment-total-length" in fields
        while True:
            data = stream.read(min(left, chunk_bytes))
            if len(data) < min(left, chunk_bytes):
                raise ValueError("An archive ends within a record")
            left -= len(data)
            origin["sha1"].update(data)
            origin["bytes"] += len(data)
            last = final and left == 0
            digest = _digest(origin["sha1"])
            intact = digest == origin["stated"] if last and origin["stated"] else None
            yield Chunk(
                origin["id"], origin["kind"], origin["uri"], origin["refers"], origin["chunk"], data,
                origin["bytes"], digest, last, intact,
            )
            origin["chunk"] += 1
            if left == 0:
                break
        if final:
            origin = None
    if origin is not None:
        raise ValueError(f"Record {origin['id']} lacks its last segment")


def opened(path: str) -> BinaryIO:
    """A buffered stream of an archive at a path as Spark names it; gzip is recognised by its first bytes."""
    if path.startswith("file:"):
        raw: BinaryIO = open("/" + path[5:].lstrip("/"), "rb")
    else:
        from pyarrow import fs

        system, place = fs.FileSystem.from_uri(path)
        raw = system.open_input_stream(place)
    buffered = io.BufferedReader(raw, CHUNK_BYTES)
    return gzip.GzipFile(fileobj=buffered) if buffered.peek(2)[:2] == b"\x1f\x8b" else buffered


def read_archives(
    spark: SparkSession, folder: str, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True
) -> DataFrame:
    """The chunk table of all archives in a folder; ``with_data`` off leaves the bytes out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[Chunk] = []
        held = 0

        def batch() -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], list(Chunk._fields)
            )

        for paths in batches:
            for path in paths.column(0).to_pylist():
                with opened(path) as stream:
                    for chunk in read_chunks(io.BufferedReader(stream, CHUNK_BYTES), chunk_bytes):
                        rows.append(chunk if with_data else chunk._replace(data=None))
                        held += len(chunk.data or b"") if with_data else 0
                        if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                            yield batch()
                            rows.clear()
                            held = 0
        if rows:
            yield batch()

    # Only the paths of this source are read here: its contents would be whole files.
    files = spark.read.format("binaryFile").load(folder).select("path")
    return files.mapInArrow(run, CHUNKS)


@query(
    "op13_warc_chunks",
    f"""
    WITH payloads AS (
        SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
    groups AS (SELECT h, max(page_id) AS top FROM payloads GROUP BY h)
    SELECT page_id, octet_length(encode(payload)) AS payload_bytes,
           array_to_string(list_transform(range(32), lambda i: substr('{BASE32}',
               (((('0x' || substr(h, 10 * (i // 8) + 1, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31) + 1)::BIGINT, 1)), '')
               AS payload_digest,
           CASE WHEN page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to
    FROM payloads JOIN groups USING (h)
    """,
)
def op13_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for every page, written and read back; the last chunk of each bears its facts."""
    folder = shared_folder(spark)
    write_archives(table(spark, sf_dir, "pages"), folder)
    chunks = read_archives(spark, folder, with_data=False).where("last")
    return chunks.select(
        page_of(F.col("record_id")).cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        page_of(F.col("refers_to")).cast("long").alias("refers_to"),
    )

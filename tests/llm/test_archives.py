import base64
import gzip
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from labelshift.llm import skew, warc

PAGES = [
    (5, "http://a.example/x y\r\nWARC-Type: forged", "<p>same</p>"),
    (9, "http://b.example/", "<p>same</p>"),
    (7, None, "<p>same</p>"),
    (None, "http://c.example/", "<p>same</p>"),
    (None, "http://d.example/", "only without an id"),
    (11, "http://e.example/", None),
    (12, "http://e.example/", ""),
    (9, "http://b.example/", "<p>same</p>"),
    (13, "http://f.example/", "ü€" * 4_000 + "\r\n\r\nWARC/1.1\r\nend"),
    (14, "http://g.example/", "x" * 1_000),
    (15, "http://h.example/", "\r\n\r\n"),
]


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(*row, "own", i) for i, row in enumerate(PAGES)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, value string, digest int").repartition(3)


def expected(rows, least=0):
    top = {}
    for i, _, text in rows:
        if i is not None and len((text or "").encode()) >= least:
            top[digest(text)] = max(i, top.get(digest(text), i))
    found = []
    for i, _, text in rows:
        first = top.get(digest(text))
        revisit = first is not None and i != first
        size = len((text or "").encode())
        found.append((i, size, digest(text), "revisit" if revisit else "response", first if revisit else None))
    return sorted(found, key=repr)


def facts(chunks):
    rows = chunks.where("last").select(
        warc.page_of(F.col("record_id")).cast("long"), "payload_bytes", "payload_digest", "record_type",
        warc.page_of(F.col("refers_to")).cast("long"),
    )
    return sorted((tuple(row) for row in rows.collect()), key=repr)


@pytest.mark.parametrize("chunk_bytes", [100, 1 << 20])
@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_pages_come_back_from_the_archives(spark, pages, tmp_path, chunk_bytes, compression):
    warc.write_archives(pages, str(tmp_path / "w"), chunk_bytes=chunk_bytes, compression=compression)
    chunks = warc.read_archives(spark, str(tmp_path / "w"), chunk_bytes=64).cache()
    assert facts(chunks) == expected(PAGES)
    assert chunks.where("record_type = 'response' and last and not intact").count() == 0
    assert max(len(row.data) for row in chunks.where("data is not null").collect()) <= 64
    texts = {i: text or "" for i, _, text in PAGES if i is not None}
    joined = {}
    for row in chunks.where("record_type = 'response'").orderBy("record_id", "chunk").collect():
        joined[row.record_id] = joined.get(row.record_id, b"") + bytes(row.data)
        if row.record_id.split(":")[2] not in ("", "9"):  # repeated rows share an identifier
            assert row.payload_bytes == len(joined[row.record_id])
            running = hashlib.sha1(joined[row.record_id]).digest()
            assert row.payload_digest == base64.b32encode(running).decode()
    for i in (12, 13, 14, 15):
        (own,) = [data for name, data in joined.items() if name.startswith(f"<urn:page:{i}:")]
        assert own.decode() == texts[i]
    uris = {row.target_uri for row in chunks.collect()}
    assert "http://a.example/x%20y%20%20WARC-Type:%20forged" in uris


def test_small_payloads_are_never_revisits(spark, pages, tmp_path):
    warc.write_archives(pages, str(tmp_path / "w"), least_bytes=100)
    assert facts(warc.read_archives(spark, str(tmp_path / "w"))) == expected(PAGES, 100)


def test_empty_table(spark, pages, tmp_path):
    warc.write_archives(pages.where("false"), str(tmp_path / "w"))
    assert warc.read_archives(spark, str(tmp_path / "w")).count() == 0


def test_a_frequent_payload_and_a_filter_of_few_bits(spark, tmp_path, monkeypatch):
    random.seed(3)
    rows = [(i, f"u{i}", "hot" if i % 3 == 0 else f"text {random.randrange(150)}") for i in range(600)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    for name, least, most in (("few", 256, 256), ("some", 1024, 1 << 30)):
        monkeypatch.setattr(skew, "LEAST_BITS", least)
        monkeypatch.setattr(skew, "MOST_BITS", most)
        monkeypatch.setattr(skew, "BITS_PER_KEY", 2)
        warc.write_archives(frame, str(tmp_path / name))
        assert facts(warc.read_archives(spark, str(tmp_path / name))) == expected(rows)


def test_foreign_archives_and_broken_ones():
    block = b"software: x\r\n"
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:a>\r\nContent-Length: %d\r\n\r\n" % len(block)
    one = info + block + b"\r\n\r\n"
    (chunk,) = warc.read_chunks(io.BytesIO(one))
    assert (chunk.record_type, chunk.data, chunk.intact, chunk.last) == ("warcinfo", block, None, True)
    members = gzip.GzipFile(fileobj=io.BytesIO(gzip.compress(one) + gzip.compress(one)))
    assert len(list(warc.read_chunks(io.BufferedReader(members)))) == 2
    with pytest.raises(ValueError, match="ends within"):
        list(warc.read_chunks(io.BytesIO(one[:-10])))
    lost = b"WARC/1.1\r\nWARC-Type: continuation\r\nWARC-Segment-Origin-ID: <urn:z>\r\nWARC-Segment-Number: 2\r\n"
    with pytest.raises(ValueError, match="does not follow"):
        list(warc.read_chunks(io.BytesIO(lost + b"Content-Length: 1\r\n\r\nx\r\n\r\n")))


def test_groups_join_where_a_key_is_frequent(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i}") for i in range(40)], "id int, key string")
    groups = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    found = {row.id: (row.n, row.top) for row in skew.join_groups(rows, groups, "key").collect()}
    assert found == {i: (20, 39) if i % 2 else (1, i) for i in range(40)}

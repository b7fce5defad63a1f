import hashlib
import re

import pytest
from pyspark.sql import functions as F

from labelshift.llm import exact_dedup, sharding

DOCS = [
    (5, "a b\tc", "x"),
    (3, "a  b c", None),
    (9, "a b c ", "x"),
    (7, None, "y"),
    (8, "", "y"),
    (None, "a b c", "z"),
    (11, "long " * 5000, "z"),
    (12, "long " * 5000 + "end", "z"),
    (3, "a  b c", None),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, s, "own") for i, t, s in DOCS]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, prefix string").repartition(3)


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_refinement_finds_each_group_and_its_least_id(docs):
    parts = exact_dedup.refine(docs)
    rows = exact_dedup.grouped(parts.survivors).collect()
    by_text = {}
    for i, t, _ in DOCS:
        by_text.setdefault(hashlib.sha256(normal(t).encode()).digest(), []).append(i)
    for row in rows:
        ids = by_text[bytes(row.full)]
        assert row.group_size == len(ids)
        assert row.keep_id == min(i for i in ids if i is not None)
        assert row.kept == (row.id == row.keep_id)
    repeated = sorted(len(ids) for ids in by_text.values() if len(ids) > 1)
    assert sorted({(bytes(r.full)): r.group_size for r in rows if r.group_size > 1}.values()) == repeated


def test_deduplicate_keeps_columns_and_one_row_of_each_text(docs):
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    found = sorted((r.doc_id, normal(r.text)) for r in kept.collect())
    least = {}
    for i, t, _ in DOCS:
        if i is not None:
            least[normal(t)] = min(i, least.get(normal(t), i))
    assert found == sorted((i, t) for t, i in least.items())


def test_empty_table(docs):
    none = docs.where("false")
    assert exact_dedup.deduplicate(none).count() == 0
    assert sharding.assign_shards(none, 4).count() == 0


def test_group_of_null_ids_is_kept_whole(spark):
    frame = spark.createDataFrame([(None, "same"), (None, "same")], "doc_id long, text string")
    assert all(r.kept for r in exact_dedup.grouped(exact_dedup.refine(frame).survivors).collect())
    assert exact_dedup.deduplicate(frame).count() == 1


def test_best_fit_takes_the_tightest_bin():
    assert sharding.best_fit_decreasing([7, 6, 3, 2], 10) == [0, 1, 0, 1]
    assert sharding.best_fit_decreasing([5, 5, 5], 4) == [0, 1, 2]
    bins = sharding.even_bins([8, 7, 6, 5, 4], 3)
    loads = [sum(s for s, b in zip([8, 7, 6, 5, 4], bins) if b == k) for k in range(3)]
    assert max(loads) == 11


def test_shards_are_even_and_groups_whole(spark):
    texts = [f"text {i} " * (1 + i % 7) for i in range(400)] + ["copied text"] * 60 + [None]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = sharding.assign_shards(frame, 5).collect()
    assert len(rows) == len(texts)
    sizes, where, slots = {}, {}, {}
    for row in rows:
        size = len((texts[row.id] or "").encode()) + 8
        assert row.size == size
        sizes[row.shard] = sizes.get(row.shard, 0) + size
        where.setdefault(texts[row.id] or "", set()).add(row.shard)
        slots.setdefault(row.shard, []).append(row.slot)
    assert all(len(s) == 1 for s in where.values())
    assert max(sizes.values()) - min(sizes.values()) <= 0.02 * sum(sizes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_group_larger_than_a_share_has_its_own_shard(spark):
    frame = spark.range(100).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") < 60, "hot").otherwise(F.col("id").cast("string")).alias("text")
    )
    rows = sharding.assign_shards(frame, 4).collect()
    hot = {r.shard for r in rows if r.id < 60}
    assert len(hot) == 1 and {r.shard for r in rows} == {0, 1, 2, 3}
    loads = [sum(r.size for r in rows if r.shard == s) for s in {0, 1, 2, 3} - hot]
    assert max(loads) - min(loads) <= 20  # two rows of ten bytes

import zlib

import numpy as np
import pytest

from labelshift.llm import decontamination, packing
from labelshift.llm.words import WordHashes, hashed, words

TEXTS = [
    "It's a test.",
    None,
    "",
    "Éa ouvi, naïve's “quotes” x² 123.45 <|endoftext|> <|ENDOFTEXT|>",
    "word " * 9000,
    "Same text here",
    "Same text here",
    "tab\tnew\nline\x0bvertical\xa0hard space, d'accord! (x).",
]


def reference_ids(text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")


def test_pieces_cover_each_document_once(spark):
    rows = [(i if i != 5 else None, t, i) for i, t in enumerate(TEXTS)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(2)
    pieces = packing.pack_documents(frame, packing.vocabulary_path()).collect()
    by_sequence = {}
    for i, text in enumerate(TEXTS):
        if i == 5:
            continue
        ids, at = reference_ids(text), 0
        for p in sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.LENGTH
    assert packing.pack_documents(frame.where("false"), packing.vocabulary_path()).count() == 0


def test_ids_are_returned_on_request(spark):
    frame = spark.createDataFrame([(1, "a test")], "doc_id long, text string")
    row = packing.pack_documents(frame, packing.vocabulary_path(), with_ids=True).first()
    assert row.ids == reference_ids("a test").tolist()


def test_balance_fills_sequences_and_evens_cost():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 200, 400).tolist()
    sequences = sum(sizes) // 1000
    filled, left = packing.balance(sizes, sequences, 1000, 1.0, 0.001)
    assert all(sum(n for _, _, n in pieces) == 1000 for pieces in filled)
    assert sum(sizes[i] - s for i, s in left) == sum(sizes) - sequences * 1000
    cost = [sum(n + 0.001 * n * n for _, _, n in pieces) for pieces in filled]
    assert max(cost) < 1.1 * min(cost)


PROSE = "the quick brown fox jumps over a lazy dog while seven wizards brew potent green tea near old mills at dawn".split()


def brute(doc, items, threshold=0.8):
    from collections import Counter

    def bag(tokens):
        n = min(5, len(tokens))
        return Counter(tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1))

    tokens, found = doc.lower().split(), set()
    for item_id, item in items:
        wanted = item.lower().split()
        for at in range(len(tokens) - len(wanted) + 1 if wanted else 0):
            a, b = bag(tokens[at : at + len(wanted)]), bag(wanted)
            common = sum((a & b).values())
            if common / (sum(a.values()) + sum(b.values()) - common) >= threshold:
                found.add(item_id)
    return found


@pytest.fixture(scope="module")
def leak_case():
    rng = np.random.default_rng(7)
    vocabulary = PROSE + [f"w{i}" for i in range(200)]
    items = [(i, " ".join(rng.choice(vocabulary, n))) for i, n in enumerate([30, 30, 45, 3, 12, 60])]
    items.append((6, None))
    docs = []
    for d in range(60):
        tokens = rng.choice(vocabulary, 120).tolist()
        if d % 3 == 0:
            passage = (items[d % 6][1]).split()
            if d % 2:  # drop a word at the edge
                passage = passage[1:]
            tokens[50:50] = passage
        docs.append((d, " ".join(tokens).upper() if d % 5 == 0 else " ".join(tokens)))
    docs += [(100, None), (101, ""), (None, items[2][1]), (0, docs[0][1])]
    return docs, items


def test_leaks_match_brute_force(spark, leak_case):
    docs, items = leak_case
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontamination.find_leaks(frame, bench).collect()
    expected = {(d, i) for d, t in docs for i in brute(t or "", [(i, x or "") for i, x in items])}
    assert {(r.doc_id, r.item_id) for r in rows} == expected
    kept = decontamination.decontaminate(frame, bench)
    assert kept.columns == frame.columns
    leaking = {d for d, _ in expected}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, _ in docs if d not in leaking)


def test_items_cut_by_some_words_standing_alone(spark):
    def similarity(cut, size):  # of distinct words
        return (cut - 4) / (size - 4)

    docs, expected = [], {}
    items = [(size, " ".join(f"i{size}w{k}" for k in range(size))) for size in (16, 39, 59)]
    for size, item in items:
        for less in range(1, 15):
            for side, tokens in enumerate((item.split()[less:], item.split()[:-less])):
                doc = size * 100 + less * 2 + side
                docs.append((doc, " ".join(tokens)))
                if similarity(size - less, size) >= 0.8:
                    expected[doc] = (size, size - less, similarity(size - less, size))
    docs += [(1, "other words that no item holds"), (2, "i16w0"), (3, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([*items, (4, "only four words here")], "item_id long, text string")
    rows = decontamination.find_leaks(frame, bench).collect()
    found = {r.doc_id: (r.item_id, r.n_words, pytest.approx(r.similarity)) for r in rows}
    assert len(rows) == len(expected) and found == expected
    assert {r.first_word for r in rows} == {0}
    kept = {r.doc_id for r in decontamination.decontaminate(frame, bench).collect()}
    assert kept == {d for d, _ in docs} - set(expected)


def test_blocks_find_every_fingerprint_within_the_radius():
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 256, (5, 16), dtype=np.uint8)
    near = decontamination.near_values(prints, decontamination.RADIUS // decontamination.BLOCKS)
    for _ in range(300):
        bits = np.unpackbits(prints[2])
        bits[rng.choice(128, decontamination.RADIUS, replace=False)] ^= 1
        window = np.packbits(bits)
        assert any(near[b, window[b], 2] for b in range(16))


def test_empty_tables(spark, leak_case):
    docs, items = leak_case
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert decontamination.find_leaks(frame, bench.where("false")).count() == 0
    assert decontamination.find_leaks(frame.where("false"), bench).count() == 0
    assert decontamination.decontaminate(frame, bench.where("false")).count() == len(docs)


def test_items_in_several_blocks(spark, leak_case, monkeypatch):
    docs, items = leak_case
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = {tuple(r) for r in decontamination.find_leaks(frame, bench).collect()}
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 60)
    assert {tuple(r) for r in decontamination.find_leaks(frame, bench).collect()} == whole


def test_words_are_lowered_and_split_on_control_space_only():
    assert words("A\x0bÉ\xa0b".encode()) == [b"a", "É\xa0b".encode()]
    assert len(hashed(words(b"a b a"), WordHashes())) == 3


def test_many_tasks_leave_little_padding(spark):
    texts = ["word " * (10 + i % 90) for i in range(600)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(97)
    pieces = packing.pack_documents(frame, packing.vocabulary_path(), length=512).collect()
    check_pieces(pieces, dict(enumerate(texts)), 512)
    sequences = {p.sequence_id for p in pieces}
    assert sum(p.length for p in pieces) > (len(sequences) - 1) * 512


def check_pieces(pieces, texts, length):
    """Each id in one piece, each sequence gapless and within its length."""
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert by_doc.keys() == texts.keys()
    for doc_id, own in by_doc.items():
        ids, at = reference_ids(texts[doc_id]), 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= length


ODD = [
    "İstanbul İ", "ﬁne ½ ²x x²", "é é É ÉTÉ", "a b  c", "don't I'M we'LL 'tis", "...!? (x) [y] x.y,z.",
    "한국어 말 한", "<|endoftext|> <|ENDOFTEXT|> <|startoftext|>x", "ªº ǅ ß ẞ ŉ", "١٢٣ 12ab3", "\x1c\x1f\x0b a\x85b",
    "word, WORD. Word;; word?!", "😀 a😀b 👨‍👩‍👧", "ſ K Å", "x" * 5000, "</w> a</w>", "﻿b ​c",
]


def test_odd_words_have_the_ids_of_the_whole_text(spark):
    texts = [*ODD, " ".join(ODD), *(o + " " + p for o in ODD for p in ODD[:5])]
    tokens = packing.WordTokens(packing.vocabulary_path())
    tokens.LIMIT = 50
    for at in range(0, len(texts), 7):
        part = texts[at : at + 7]
        for text, ids in zip(part, tokens.encode([t.encode() for t in part]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == reference_ids(text)[:-1].tolist(), text


def test_other_vocabularies_are_refused(tmp_path):
    import json

    with open(packing.vocabulary_path(), encoding="utf-8") as file:
        rules = json.load(file)
    rules["normalizer"] = None
    path = tmp_path / "other.json"
    path.write_text(json.dumps(rules))
    with pytest.raises(ValueError, match="does not split"):
        packing.WordTokens(str(path))

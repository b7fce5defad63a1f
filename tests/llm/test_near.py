import numpy as np
import pytest

from labelshift.llm import near, near_dedup, paragraph_dedup
from labelshift.llm.components import components
from labelshift.llm.words import WordHashes, hashed, shingles, shingles_of_units, weighted_jaccard, words

H = WordHashes()


def bag(text):
    return near.expanded(shingles(hashed(words((text or "").encode()), H)))


def similar(a, b, threshold=0.8):
    x, y = bag(a), bag(b)
    if not len(x) or not len(y):
        return len(x) == len(y)
    common = len(np.intersect1d(x, y))
    return common / (len(x) + len(y) - common) >= threshold


def classes(texts):
    """Least index of each text's component of the exact similarity graph."""
    label = list(range(len(texts)))
    changed = True
    links = [(i, j) for i in range(len(texts)) for j in range(i) if similar(texts[i], texts[j])]
    while changed:
        changed = False
        for i, j in links:
            low = min(label[i], label[j])
            if label[i] != low or label[j] != low:
                label[i] = label[j] = low
                changed = True
    return label


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for length in [30, 60, 120, 250, 400]:
        for _ in range(6):
            base = rng.choice(vocabulary, length).tolist()
            texts.append(" ".join(base))
            for edits in (0, 1, 2, 4, 8, 16):
                copy = list(base)
                for at in rng.choice(length, min(edits, length // 2), replace=False):
                    copy[at] = str(rng.choice(vocabulary))
                texts.append(" ".join(copy))
    # a chain: each step is similar to the next, the ends are not
    chain = rng.choice(vocabulary, 300).tolist()
    for step in range(12):
        chain = list(chain)
        chain[step * 20 : step * 20 + 6] = rng.choice(vocabulary, 6).tolist()
        texts.append(" ".join(chain))
    # a large group of near copies with one common line
    base = rng.choice(vocabulary, 80).tolist()
    for _ in range(80):
        copy = list(base)
        for at in rng.choice(80, int(rng.integers(0, 5)), replace=False):
            copy[at] = str(rng.choice(vocabulary))
        texts.append(" ".join(copy))
    texts += ["", None, "  \n", "three short words", "Three  short WORDS", "x", "a " * 500, "a " * 450]
    return texts


def test_classes_match_brute_force(spark, corpus):
    rows = [(i, t, "en", b"k") for i, t in enumerate(corpus)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, label string, key binary").repartition(4)
    found = {r.id: r for r in near_dedup.near_classes(frame).collect()}
    expected = classes(corpus)
    assert [found[i].class_id for i in range(len(corpus))] == expected
    for i, label in enumerate(expected):
        assert found[i].kept == (i == label)
        assert found[i].class_size == expected.count(label)
    kept = near_dedup.keep_first(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(expected))


def test_blocks_of_a_large_bucket_lose_nothing(spark, corpus, monkeypatch):
    monkeypatch.setattr(near, "BLOCK_MEMBERS", 7)
    monkeypatch.setattr(near, "CELL_ROWS", 40)
    frame = spark.createDataFrame(list(enumerate(corpus)), "doc_id long, text string")
    found = {r.id: r.class_id for r in near_dedup.near_classes(frame).collect()}
    assert [found[i] for i in range(len(corpus))] == classes(corpus)


def test_nulls_and_repeats(spark):
    rows = [(None, "one two three four five six"), (4, "one two three four five six"), (4, "one two three four five six"),
            (None, None), (None, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_dedup.near_classes(frame).collect()
    assert len(found) == 5
    assert sorted((r.id or 0, r.class_id or 0, r.class_size, r.kept) for r in found) == [
        (0, 0, 2, True), (0, 0, 2, True), (0, 4, 3, False), (4, 4, 3, True), (4, 4, 3, True)
    ]
    assert near_dedup.near_classes(frame.where("false")).count() == 0
    assert paragraph_dedup.repeated_paragraphs(frame.where("false")).count() == 0


def test_dart_sketch_estimates_weighted_similarity():
    rng = np.random.default_rng(5)
    elements = np.sort(rng.integers(0, 2**63, 300).astype(np.uint64))
    agree, exact = [], []
    for _ in range(40):
        a, b = rng.gamma(1.0, 1.0, 300) + 1e-3, rng.gamma(1.0, 1.0, 300) + 1e-3
        b = np.where(rng.random(300) < 0.7, a, b)
        x = near_dedup.dart_sketch(elements, a, 256)
        agree.append(np.mean(x == near_dedup.dart_sketch(elements, b, 256)))
        exact.append(weighted_jaccard((elements, a), (elements, b)))
    assert abs(np.mean(agree) - np.mean(exact)) < 0.01
    assert np.max(np.abs(np.array(agree) - exact)) < 0.13


def test_banding_meets_its_recall():
    banding = near.tune(0.8, 0.9995, 64)
    assert banding.size <= 64 and banding.recall(0.8) >= 0.9995
    assert near.Banding(banding.rows + 1, 64 // (banding.rows + 1)).recall(0.8) < 0.9995


def test_components_of_path_star_and_clique(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)]
    edges += [(200 + i, 200 + j) for i in range(6) for j in range(i)] + [(5, 5), (1, 0)]
    frame = spark.createDataFrame(edges, "a long, b long")
    found = dict(components(frame).collect())
    expected = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {200 + i: 200 for i in range(6)}
    assert found == expected
    assert components(frame.where("false")).count() == 0


def paragraph_truth(texts, least=50):
    places, lines = [], []
    for i, text in enumerate(texts):
        for n, line in enumerate((text or "").split("\n")):
            if len(line.split()) >= least:
                places.append((i, n))
                lines.append(line)
    def linked(a, b):
        x, y = (set(shingles(hashed(words(t.encode()), H)).tolist()) for t in (a, b))
        return len(x & y) / len(x | y) >= 0.8
    label = list(range(len(lines)))
    for i in range(len(lines)):
        for j in range(i):
            if linked(lines[i], lines[j]):
                low, high = sorted((label[i], label[j]))
                label = [low if v == high else v for v in label]
    sizes = {v: label.count(v) for v in label}
    return {places[i]: (places[v][0], sizes[v], i != v) for i, v in enumerate(label) if sizes[v] > 1}


def test_paragraphs_match_brute_force(spark):
    rng = np.random.default_rng(2)
    vocabulary = [f"v{i}é" for i in range(900)]
    passages = [" ".join(rng.choice(vocabulary, n)) for n in (55, 70, 130)]
    texts = []
    for i in range(50):
        lines = [" ".join(rng.choice(vocabulary, int(rng.integers(5, 90)))) for _ in range(4)]
        if i % 3 == 0:
            passage = passages[i % 9 // 3].split()
            if i % 2:
                passage[10] = "changed"
            lines.insert(2, " ".join(passage))
        texts.append("\n".join([*lines, "common short line"]))
    texts += [None, "", "\n\n", passages[0] + "\n" + passages[0]]
    frame = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, unit int")
    rows = paragraph_dedup.repeated_paragraphs(frame).collect()
    found = {(r.id, r.paragraph): (r.cluster_id, r.cluster_size, r.removed) for r in rows}
    assert found == paragraph_truth(texts)
    for r in rows:
        raw = texts[r.id].encode()
        assert raw[r.start : r.stop].decode() == texts[r.id].split("\n")[r.paragraph]
    cut = paragraph_dedup.remove_repeats(frame)
    assert cut.columns == frame.columns
    removed = {(r.id, r.paragraph) for r in rows if r.removed}
    for row in cut.collect():
        text = texts[row.doc_id]
        if text is None:
            assert row.text is None
            continue
        lines = [line for n, line in enumerate(text.split("\n")) if (row.doc_id, n) not in removed]
        assert row.text.rstrip("\n") == "\n".join(lines).rstrip("\n")


def test_short_lines_and_passages_across_and_inside_lines(spark):
    rng = np.random.default_rng(8)
    fresh = iter(rng.permutation(20_000).tolist())

    def some(n):
        return [f"p{next(fresh)}é" for _ in range(n)]

    short, passage, chain = some(12), some(60), some(46)
    edited = [*passage[:30], "edited", *passage[31:]]
    texts = [
        "\n".join([" ".join(short), " ".join(some(40))]),
        "\n".join([" ".join(some(9)), " ".join(short), " ".join(short[:11] + some(2))]),
        " ".join(some(70) + passage + some(70)),  # inside a line
        "\n".join(" ".join(x) for x in (some(20), some(5) + passage[:18], passage[18:40], passage[40:] + some(9))),
        " ".join(some(80) + edited + some(80)),  # near, inside a line
        "\n".join([" ".join(chain), " ".join(some(30))]),
        "\n".join([" ".join(chain[:-1]), " ".join(some(30))]),  # a short line without its last word
        " ".join(some(300)),
        None,
        "",
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = paragraph_dedup.repeated_passages(frame).collect()
    lines = {(r.id, r.paragraph): (r.cluster_id, r.cluster_size, r.removed) for r in rows if r.kind == "line"}
    assert lines == {(0, 0): (0, 2, False), (1, 1): (0, 2, True), (5, 0): (5, 2, False), (6, 0): (5, 2, True)}
    windows = [r for r in rows if r.kind == "window"]
    assert {(r.id, r.cluster_id, r.removed) for r in windows} == {(2, 2, False), (3, 2, True), (4, 2, True)}
    for r in windows:
        held = texts[r.id].encode()[r.start : r.stop].decode().split()
        assert len(held) == r.n_words and set(held) <= set(passage)
        assert r.paragraph == texts[r.id].encode()[: r.start].count(b"\n")
    cut = {r.doc_id: r.text for r in paragraph_dedup.remove_repeats(frame).collect()}
    assert cut[2] == texts[2] and cut[7] == texts[7] and cut[8] is None
    kept = " ".join(x or "" for x in cut.values()).split()
    assert set(passage) <= set(kept) and len([w for w in kept if w in passage]) < 60 + 24 * 3


def test_every_shared_run_holds_a_shared_window():
    rng = np.random.default_rng(4)
    least = paragraph_dedup.WINDOW + paragraph_dedup.REACH - 1
    for _ in range(200):
        run = rng.integers(0, 2**63, least).astype(np.uint64)
        found = []
        for _ in range(2):
            before = rng.integers(0, 2**63, int(rng.integers(0, 30))).astype(np.uint64)
            ids = np.concatenate([before, run, rng.integers(0, 2**63, 20).astype(np.uint64)])
            at = paragraph_dedup.anchors(shingles(ids)) - len(before)
            found.append({a for a in at.tolist() if 0 <= a <= least - paragraph_dedup.WINDOW})
        assert found[0] & found[1]


def test_units_sketched_together_have_their_own_sketches():
    rng = np.random.default_rng(4)
    lengths = np.array([1, 5, 4, 30, 2, 6, 5, 77])
    ids = rng.integers(0, 40, lengths.sum()).astype(np.uint64)
    values, counts = shingles_of_units(ids, lengths)
    together = paragraph_dedup.min_hashes(12)(ids, lengths)
    ends = np.cumsum(lengths)
    for unit, (n, end) in enumerate(zip(lengths, ends)):
        own = ids[end - n : end]
        at = counts[:unit].sum()
        assert values[at : at + counts[unit]].tolist() == shingles(own).tolist()
        assert together[unit].tolist() == paragraph_dedup.min_hashes(12)(own, np.array([n]))[0].tolist()


def test_lines_that_share_a_frequent_shingle_do_not_meet(spark):
    """Rows of the comparison across components grow no faster than the lines."""
    rows = []
    for n in (300, 1200):
        lines = ["all lines share this start " + " ".join(f"w{i * 31 + j}" for j in range(20)) for i in range(n)]
        frame = spark.createDataFrame(list(enumerate(lines)), "id long, text string")
        banding = near.tune(0.8, paragraph_dedup.RECALL, paragraph_dedup.SKETCH)
        made = near.sketch_units(
            frame, paragraph_dedup.paragraphs(5), paragraph_dedup.min_hashes(banding.size), banding, "id", "text"
        )
        placed = made.selectExpr("key", "explode(bands) as bucket")
        rows.append(placed.groupBy("bucket").count().where("count > 1").selectExpr("coalesce(sum(count), 0)").first()[0])
    assert rows[1] <= 8 * rows[0] + 100


A, B = "one two three four five six seven", "eight nine ten eleven twelve thirteen"


@pytest.mark.parametrize(
    "rows, kept",
    [
        ([(0, A), (None, A), (None, B)], [(0, A), (None, B)]),
        ([(0, A), (1, A), (1, B)], [(0, A), (1, B)]),
        ([(None, A), (None, A), (None, B)], [(None, A), (None, A), (None, B)]),
        ([(3, A + " x"), (3, A + " x"), (3, B)], [(3, A + " x"), (3, A + " x"), (3, B)]),
    ],
)
def test_unique_documents_with_null_or_shared_ids_stay(spark, rows, kept):
    frame = spark.createDataFrame([(*row, "own") for row in rows], "doc_id long, text string, row string").repartition(2)
    found = near_dedup.keep_first(frame)
    assert found.columns == frame.columns
    assert sorted(map(repr, [(r.doc_id, r.text) for r in found.collect()])) == sorted(map(repr, kept))


def test_spans_belong_to_an_id_and_its_text(spark):
    odd = "é" * 40
    rows = [(0, A), (None, A + "\nxx"), (None, odd), (0, "yy\n" + A)]
    frame = spark.createDataFrame([(*row, "own") for row in rows], "doc_id long, text string, own string").repartition(2)
    found = paragraph_dedup.remove_repeats(frame)
    kept = sorted(r.text for r in found.collect())
    # The line stays in one of the two rows with id 0 and goes everywhere else.
    assert kept in (sorted([A, "xx", odd, "yy\n"]), sorted(["", "xx", odd, "yy\n" + A]))

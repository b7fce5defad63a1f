import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelshift.llm import importance, language, ppm, toxicity

SYLLABLES = ["an", "er", "th", "on", "ti", "re", "ed", "st", "ou", "ing"]


@pytest.fixture(scope="module")
def prose():
    rng = np.random.default_rng(4)
    vocabulary = ["".join(rng.choice(SYLLABLES, int(rng.integers(1, 4)))) for _ in range(150)]
    return [" ".join(rng.choice(vocabulary, int(rng.integers(20, 60)))) for _ in range(120)]


def ppm_brute(training, texts):
    """The method byte by byte, with dictionaries."""
    order, end = ppm.ORDER, b"\n"

    def data(text):
        return end * order + b" ".join((text or "").encode().lower().split()) + end

    counts = [{} for _ in range(order + 1)]
    for text in training:
        d = data(text)
        for i in range(order, len(d)):
            for k in range(order + 1):
                counts[k].setdefault(d[i - k : i], Counter())[d[i]] += 1
    out = []
    for text in texts:
        d, total = data(text), 0.0
        for i in range(order, len(d)):
            excluded = set()
            for k in range(order, -1, -1):
                table = counts[k].get(d[i - k : i])
                if table is None:
                    continue
                left = {s: n for s, n in table.items() if s not in excluded}
                if not left:
                    continue
                whole = sum(left.values()) + len(left)
                if d[i] in left:
                    total += math.log10(left[d[i]] / whole)
                    break
                total += math.log10(len(left) / whole)
                excluded = set(table)
            else:
                total -= math.log10(256 - len(excluded))
        out.append(total)
    return out


def test_ppm_matches_brute_force(spark, prose, monkeypatch):
    monkeypatch.setattr(ppm, "CHUNK_BYTES", 5000)
    monkeypatch.setattr(ppm, "BATCH_BYTES", 700)
    texts = [*prose, None, "", "Zebra§ QUITE new\twords\n", prose[0], "x" * 5000]
    rows = [(i, t, 0.0, "c") for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, score double, chunk string").repartition(3)
    held = F.col("doc_id") % 5 == 2
    found = {r.id: r for r in ppm.train_and_score(frame, held).collect()}
    training = [t for i, t in enumerate(texts) if i % 5 != 2]
    tokens = {i: (t or "").lower().split() + [None] for i, t in enumerate(texts)}
    counts = Counter(w for i in tokens if i % 5 != 2 for w in tokens[i])
    n, v = sum(counts.values()), len(counts)
    for i, expected in enumerate(ppm_brute(training, texts)):
        row = found[i]
        assert row.score == pytest.approx(expected, abs=1e-7)
        assert row.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens[i]), abs=1e-7)
        assert (row.held_out, row.n_tokens, row.train_tokens) == (i % 5 == 2, len(tokens[i]), n)
        assert row.n_known == sum(counts[w] > 0 for w in tokens[i])
    held_rows = [r for r in found.values() if r.held_out and r.n_tokens > 10]
    assert sum(r.score for r in held_rows) > 0.6 * sum(r.base_score for r in held_rows) * 2


def test_trie_is_a_distribution(prose):
    lists = [t.encode().split() for t in prose[:30]]
    codes, _ = ppm.grams(lists)
    trie = ppm.Trie({k: ppm.merged([ppm.counted(codes & ppm._mask(k), True)]) for k in range(ppm.ORDER + 1)})
    for context in [codes[7] >> np.uint64(8), codes[900] >> np.uint64(8), np.uint64(0x7A7A7A7A7A)]:
        symbols = (context << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert np.sum(10 ** trie.log10(symbols)) == pytest.approx(1.0)


def test_ppm_without_training_or_rows(spark, prose):
    frame = spark.createDataFrame([(1, "ab"), (None, None)], "doc_id long, text string")
    rows = ppm.train_and_score(frame, F.lit(True)).collect()
    assert sorted(round(r.score, 6) for r in rows) == sorted(round(-n * math.log10(256), 6) for n in (3, 1))
    assert ppm.train_and_score(frame.where("false"), F.lit(False)).count() == 0


def test_lookup_survives_collisions():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 2**63, 50_000).astype(np.uint64))
    values = rng.random(len(keys))
    order = rng.permutation(len(keys))
    assert np.array_equal(ppm.Lookup(keys, values)(keys[order]), values[order])


@pytest.fixture(scope="module")
def toxic_case(spark, prose):
    rng = np.random.default_rng(9)
    rows, labels = [], []
    for i in range(900):
        tokens = prose[i % len(prose)].split()
        rng.shuffle(tokens)
        toxic, junk = i % 6 == 0, i % 5 == 0
        if toxic:
            for at in rng.choice(len(tokens), 4, replace=False):
                tokens[at] = str(rng.choice(["vilest", "rotteny", "vilestly"]))
        if junk:
            tokens = [t + "###" for t in tokens]
        rows.append((i, " ".join(tokens), i))
        labels.append((i, int(junk), int(toxic)))
    docs = spark.createDataFrame([*rows, (5000, None, 1), (5001, "", 1), (None, "vilest vilest rotteny " * 3, 1)],
                                 "doc_id long, text string, toxic int")
    table = spark.createDataFrame([*labels, (1, None, None), (99999, 1, 1), (None, 1, 1)], "doc_id long, junk int, toxic int")
    return docs, table, labels


def test_chain_is_accurate_on_held_out_rows(spark, toxic_case):
    docs, table, labels = toxic_case
    chain = toxicity.train(docs, table.where("doc_id % 2 = 0 or doc_id is null"), ["junk", "toxic"])
    rows = {r.id: r for r in toxicity.score(docs, chain, ["junk", "toxic"]).collect()}
    held = [(i, t) for i, _, t in labels if i % 2]
    assert sum((rows[i].toxic >= 0.5) == bool(t) for i, t in held) >= 0.98 * len(held)
    assert sum((rows[i].junk >= 0.5) == bool(j) for i, j, _ in labels if i % 2) >= 0.98 * len(held)
    assert rows[None].toxic > 0.5 and rows[5000].toxic == rows[5001].toxic < 0.5
    kept = toxicity.keep_clean(docs, chain, 1)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if r.toxic < 0.5}


def test_chain_uses_out_of_fold_logits_of_earlier_categories():
    rng = np.random.default_rng(3)
    n = 600
    first = rng.integers(0, 2, n)
    # the second category equals the first, and has no feature of its own beyond noise
    indices = [np.array([int(f), 2 + int(rng.integers(0, 50))]) for f in first]
    data = (np.arange(0, 2 * n + 1, 2), np.concatenate(indices), np.full(2 * n, 1.0))
    labels = np.column_stack([first, first]).astype(float)
    chain = toxicity.fit_chain(data, labels, np.arange(n) % 3)
    assert chain.earlier[1, 0] > 0


def test_chain_without_labels(spark, toxic_case):
    docs, table, _ = toxic_case
    chain = toxicity.train(docs, table.where("false"), ["junk", "toxic"])
    assert {r.toxic for r in toxicity.score(docs, chain, ["junk", "toxic"]).collect()} == {0.5}
    one_class = toxicity.train(docs, table.where("toxic = 0"), ["junk", "toxic"])
    assert max(r.toxic for r in toxicity.score(docs, one_class, ["junk", "toxic"]).collect()) < 0.05
    assert toxicity.score(docs.where("false"), chain, ["junk", "toxic"]).count() == 0


def test_importance_weights_match_brute_force(spark, prose):
    texts = [*prose, None, "", prose[0]]
    frame = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "doc_id long, text string, tie double")
    good = frame.where("doc_id % 4 = 0").select("doc_id")
    rows = {r.id: r for r in importance.resample(frame, good, 0.4).collect()}
    from labelshift.llm.words import WordHashes, hashed, words

    hashes = WordHashes()

    def grams(text):
        ids = hashed(words((text or "").encode()), hashes)
        return importance.ngram_buckets(ids).tolist() if len(ids) else []

    target, raw = Counter(), Counter()
    for i, t in enumerate(texts):
        raw.update(grams(t))
        if i % 4 == 0:
            target.update(grams(t))
    nt, nr, b = sum(target.values()), sum(raw.values()), importance.BUCKETS
    for i, t in enumerate(texts):
        expected = sum(math.log((target[g] + 1) / (nt + b)) - math.log((raw[g] + 1) / (nr + b)) for g in grams(t))
        assert rows[i].log_weight == pytest.approx(expected, abs=1e-9)
    chosen = sorted((r.gumbel_key for r in rows.values() if r.selected), reverse=True)
    assert len(chosen) == round(0.4 * len(texts))
    assert chosen == sorted((r.gumbel_key for r in rows.values()), reverse=True)[: len(chosen)]


def test_top_k_is_exact_with_ties(spark):
    rng = np.random.default_rng(8)
    values = [(int(v), i) for i, v in enumerate(rng.integers(-40, 40, 300))] + [(2**62, -5), (-(2**62), 900)]
    frame = spark.createDataFrame(values, "rank_key long, tie long")
    for k in (1, 7, 150, 301):
        found = {(r.rank_key, r.tie) for r in importance.top_k(frame, k).where("selected").collect()}
        assert found == set(sorted(values, reverse=True)[:k])
    assert importance.top_k(frame, 1000).where("selected").count() == len(values)


def test_gumbel_sampling_follows_the_weights(spark):
    frame = spark.range(40_000).select(F.col("id"), F.col("id").alias("content"))
    draws = np.array([r[0] for r in frame.select(importance.gumbel(3)).collect()])
    assert abs(draws.mean() - 0.5772) < 0.02 and abs(draws.var() - math.pi**2 / 6) < 0.05


def test_importance_without_rows(spark, prose):
    frame = spark.createDataFrame([(1, "a"), (None, None)], "doc_id long, text string")
    assert importance.resample(frame.where("false"), frame.select("doc_id"), 0.5).count() == 0
    assert {r.log_weight for r in importance.resample(frame, frame.where("false").select("doc_id"), 1.0).collect()} == {0.0}


@pytest.fixture(scope="module")
def text_model(spark):
    rng = np.random.default_rng(1)
    parts = {"xx": ["ka", "lo", "mi"], "yy": ["ber", "tun", "sch"]}
    rows = [(lang, " ".join("".join(rng.choice(s, 3)) for _ in range(60))) for lang, s in parts.items() for _ in range(20)]
    docs = spark.createDataFrame([*rows, (None, "zzz"), ("xx", None)], "lang string, text string")
    return language.train_text(docs), parts


def test_language_uses_each_kind_of_evidence(spark, text_model):
    model, parts = text_model
    rng = np.random.default_rng(2)
    rows = []
    for i in range(240):
        lang = "xx" if i % 2 else "yy"
        body = " ".join("".join(rng.choice(parts[lang], 3)) for _ in range(15))
        page = f'<html lang="{lang}"><script>berschtun ber</script><p>{body}&amp;</p></html>'
        rows.append((i, f"http://h{i % 8}.{'aa' if i % 2 else 'bb'}.{'x' if i % 2 else 'y'}/p", page, "s"))
    silent = [
        (1000, "http://h1.aa.x/", "<html><p> </p></html>"),  # host with xx
        (1001, "http://new.aa.x/", None),  # domain with xx
        (1002, "http://new.cc.y/", ""),  # suffix with yy
        (1003, None, '<html lang="yy"><p></p></html>'),  # declaration
        (1004, "http://[bad", "<p>kalomi kalomi lomika</p>"),
    ]
    frame = spark.createDataFrame([*rows, *((*s, "s") for s in silent)], "page_id long, url string, html string, host string")
    found = {r.id: r for r in language.classify_pages(frame, model).collect()}
    assert len(found) == len(rows) + len(silent)
    assert all(found[i].language == ("xx" if i % 2 else "yy") for i in range(240))
    assert [found[i].language for i in (1000, 1001, 1002, 1003, 1004)] == ["xx", "xx", "yy", "yy", "xx"]
    assert all(0.5 <= r.probability <= 1.0 for r in found.values())
    assert language.classify_pages(frame.where("false"), model).count() == 0


def test_language_without_documents(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    pages = spark.createDataFrame([(1, "http://a.b/", "x")], "page_id long, url string, html string")
    assert language.classify_pages(pages, language.train_text(docs)).first().language is None


def test_held_out_fold_is_unsigned_crc():
    assert zlib.crc32(b"123") % 7 == 0xFFFFFFFF & zlib.crc32(b"123") - 7 * (zlib.crc32(b"123") // 7)

"""Language evidence, sharding, the classifier chain and the pipeline against slow versions."""

import math
import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from labelshift.llm import language, sharding, toxicity
from labelshift.llm.words import WordHashes, hashed, shingles, weighted_jaccard, words


# -- language evidence ---------------------------------------------------------


def slow_languages(docs, pages):
    """Every sum and product of the fusion in dictionaries."""
    names = sorted({lang for lang, _ in docs if lang is not None})
    counts = {lang: Counter() for lang in names}
    for lang, text in docs:
        if lang is not None and text:
            counts[lang].update(language.trigrams(text.encode()).tolist())
    totals = {lang: sum(c.values()) + language.BUCKETS * language.SMOOTHING for lang, c in counts.items()}
    facts = []
    for page_id, url, html in pages:
        raw = (html or "").encode()
        found = language._DECLARED.search(raw)
        text = language.visible(raw)
        score = {lang: 0.0 for lang in names}
        if text.strip():
            for gram in language.trigrams(text).tolist():
                for lang in names:
                    score[lang] += math.log((counts[lang][gram] + language.SMOOTHING) / totals[lang]) / 3
        most = max(score.values())
        share = {lang: math.exp(v - most) for lang, v in score.items()}
        posterior = {lang: v / sum(share.values()) for lang, v in share.items()}
        host = language.host_of(url)
        groups = {
            "host": host,
            "domain": ".".join(host.split(".")[-2:]),
            "suffix": host.rpartition(".")[2],
            "declared": found.group(1).decode().lower() if found else "",
        }
        facts.append((page_id, groups, {lang: v - most for lang, v in score.items()}, posterior))
    sums = {}
    for _, groups, _, posterior in facts:
        for kind, value in groups.items():
            for lang in names:
                key = (kind, value, lang)
                sums[key] = sums.get(key, 0.0) + posterior[lang]
    everything = {lang: sum(f[3][lang] for f in facts) for lang in names}
    total = sum(everything.values())
    result = {}
    for page_id, groups, evidence, posterior in facts:
        logs = {}
        for lang in names:
            own = {kind: max(sums[kind, value, lang] - posterior[lang], 0.0) for kind, value in groups.items()}
            whole = {
                kind: max(sum(sums[kind, value, other] for other in names) - 1, 0.0) for kind, value in groups.items()
            }
            base = (everything[lang] + 1) / (total + len(names))
            domain = (own["domain"] + 20 * base) / (whole["domain"] + 20)
            host = (own["host"] + 5 * domain) / (whole["host"] + 5)
            logs[lang] = evidence[lang] + math.log(host)
            for kind in ("suffix", "declared"):
                logs[lang] += math.log((own[kind] + 5 * (whole[kind] + 1) / (total + 1)) / (everything[lang] + 5))
        most = max(logs.values())
        best = min(lang for lang in names if logs[lang] == most)
        result[page_id] = (best, 1 / sum(math.exp(v - most) for v in logs.values()))
    return result


@pytest.mark.parametrize("together", [2, 256])
def test_languages_match_brute_force(spark, monkeypatch, together):
    monkeypatch.setattr(language, "LANGUAGES_TOGETHER", together)
    choose = random.Random(7)
    parts = {"aa": "kalomi", "bb": "bertunsch", "cc": "kaberloze", "dd": "ozuriq", "ee": "zzyaab"}
    docs = [(lang, " ".join("".join(choose.choices(s, k=4)) for _ in range(40))) for lang, s in parts.items() for _ in range(4)]
    docs += [(None, "kalomi"), ("aa", None), ("bb", "")]
    pages = []
    for i in range(60):
        lang = choose.choice(list(parts))
        body = " ".join("".join(choose.choices(parts[lang], k=4)) for _ in range(choose.randrange(6)))
        declared = choose.choice(["", f' lang="{lang}"', ' lang="bb"'])
        host = choose.choice(["h1.x.de", "h2.x.de", "y.fr", "z.y.fr"])
        pages.append((i, f"http://{host}/{i}", f"<html{declared}><p>{body}&eacute;</p></html>"))
    pages += [(100, None, None), (101, "http://[bad", ""), (102, "http://h1.x.de/", "<p> </p>")]
    model = language.train_text(spark.createDataFrame(docs, "lang string, text string").repartition(3))
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    found = {r.id: (r.language, r.probability) for r in language.classify_pages(frame, model).collect()}
    want = slow_languages(docs, pages)
    assert {i: v[0] for i, v in found.items()} == {i: v[0] for i, v in want.items()}
    assert all(found[i][1] == pytest.approx(want[i][1]) for i in want)


# -- sharding --------------------------------------------------------------------


def slow_best_fit(sizes, capacity):
    """The fullest bin with room, by looking at all of them."""
    rooms, bins = [], []
    for size in sizes:
        fitting = [(room, b) for b, room in enumerate(rooms) if room >= size]
        if fitting:
            _, chosen = min(fitting)
        else:
            chosen = len(rooms)
            rooms.append(max(capacity, size))
        rooms[chosen] -= size
        bins.append(chosen)
    return bins


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_matches_brute_force(seed):
    choose = random.Random(seed)
    sizes = sorted((choose.randrange(1, 60) for _ in range(80)), reverse=True)
    for capacity in (60, 97, 200):
        assert sharding.best_fit_decreasing(sizes, capacity) == slow_best_fit(sizes, capacity)


def test_shards_of_large_groups_match_brute_force(spark):
    """With few rows each group is an item, so the whole placement can be followed."""
    choose = random.Random(5)
    texts = ["x" * choose.randrange(200, 900) + str(i) for i in range(40)]
    texts += [t for t in texts[:10] for _ in range(2)] + [None, None]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = sharding.assign_shards(frame, 6).collect()
    sizes = {}
    for text in texts:
        sizes[text or ""] = sizes.get(text or "", 0) + len((text or "").encode()) + 8
    ordered = sorted(sizes.values(), reverse=True)
    capacity = next(
        c for c in range(-(-sum(ordered) // 6), 2 * sum(ordered)) if max(slow_best_fit(ordered, c)) < 6
    )
    loads = [0] * 6
    for size, b in zip(ordered, slow_best_fit(ordered, capacity), strict=True):
        loads[b] += size
    found = [sum(r.size for r in rows if r.shard == s) for s in range(6)]
    assert max(found) <= max(capacity, max(loads)) + 1


# -- classifier chain ----------------------------------------------------------------


def slow_logistic(rows, extra, labels, chosen):
    """AdaGrad over the same mini-batches, one document and feature at a time."""
    positive = sum(labels[r] for r in chosen)
    negative = len(chosen) - positive
    bias = math.log((positive + 0.5) / (negative + 0.5))
    more = [0.0] * (len(extra[0]) if extra else 0)
    if positive in (0, len(chosen)):
        return {}, bias, more
    seen = {1: Counter(), 0: Counter()}
    for r in chosen:
        seen[labels[r]].update(rows[r].keys())
    used = set()
    for f in seen[0].keys() | seen[1].keys():
        a, b = seen[1][f], seen[0][f]
        share = (a + b) / len(chosen)
        error = math.sqrt(max(share * (1 - share), 1e-12) * (1 / positive + 1 / negative))
        if a + b >= toxicity.LEAST_DOCS and abs(a / positive - b / negative) / error >= toxicity.LEAST_Z:
            used.add(f)
    weights, squares = Counter(), {}
    bias_square, more_squares = 1e-4, [1e-4] * len(more)
    for _ in range(toxicity.EPOCHS):
        for start in range(0, len(chosen), toxicity.BATCH):
            batch = chosen[start : start + toxicity.BATCH]
            errors = []
            for r in batch:
                logit = sum(v * weights[f] for f, v in rows[r].items() if f in used) + bias
                logit += sum(x * m for x, m in zip(extra[r], more, strict=True)) if more else 0.0
                errors.append(1 / (1 + math.exp(-max(-30.0, min(30.0, logit)))) - labels[r])
            gradient = Counter()
            for r, e in zip(batch, errors, strict=True):
                for f, v in rows[r].items():
                    if f in used:
                        gradient[f] += v * e / len(batch)
            for f, g in gradient.items():
                g += toxicity.L2 * weights[f]
                squares[f] = squares.get(f, 1e-4) + g * g
                weights[f] -= toxicity.RATE * g / math.sqrt(squares[f])
            step = sum(errors) / len(batch)
            bias_square += step**2
            bias -= toxicity.RATE * 0.2 * step / math.sqrt(bias_square)
            for j in range(len(more)):
                slope = sum(extra[r][j] * e for r, e in zip(batch, errors, strict=True)) / len(batch) + toxicity.L2 * more[j]
                more_squares[j] += slope**2
                more[j] -= toxicity.RATE * 0.2 * slope / math.sqrt(more_squares[j])
    return {f: weights[f] for f in used}, bias, more


def test_chain_matches_brute_force(monkeypatch):
    monkeypatch.setattr(toxicity, "EPOCHS", 4)
    choose = random.Random(3)
    texts, labels = [], []
    for _ in range(150):
        first, second = choose.random() < 0.4, choose.random() < 0.3
        words_ = choose.choices(["plain", "text", "here", "some"], k=6) + ["badly"] * first + ["awful!"] * second
        texts.append(" ".join(words_))
        labels.append((float(first), float(second or (first and choose.random() < 0.5))))
    labels[5] = (float("nan"), 1.0)
    rows = []
    for text in texts:
        tokens = words(text.encode())
        found = Counter(f for word in tokens for f in toxicity.word_features(word))
        rows.append({f: float(np.float32(n / math.sqrt(len(tokens)))) for f, n in sorted(found.items())})
    folds = [i % 3 for i in range(150)]
    indptr = np.cumsum([0, *map(len, rows)])
    data = (
        indptr,
        np.concatenate([list(r) for r in rows]).astype(np.int32),
        np.concatenate([list(r.values()) for r in rows]),
    )
    chain = toxicity.fit_chain(data, np.array(labels), np.array(folds))
    known = [i for i in range(150) if i != 5]
    first = [0 if math.isnan(y) else int(y) for y, _ in labels]
    weights, bias, _ = slow_logistic(rows, [[] for _ in rows], first, known)
    assert chain.intercepts[0] == pytest.approx(bias)
    for f in weights:
        assert chain.weights[f, 0] == pytest.approx(weights[f])
    held_out = [[0.0] for _ in rows]
    for fold in range(toxicity.FOLDS):
        w, b, _ = slow_logistic(rows, [[] for _ in rows], first, [i for i in known if folds[i] != fold])
        for i in range(150):
            if folds[i] == fold:
                held_out[i] = [sum(v * w.get(f, 0.0) for f, v in rows[i].items()) + b]
    weights, bias, more = slow_logistic(rows, held_out, [int(y) for _, y in labels], list(range(150)))
    assert chain.intercepts[1] == pytest.approx(bias) and chain.earlier[1, 0] == pytest.approx(more[0])
    assert all(chain.weights[f, 1] == pytest.approx(w) for f, w in weights.items())
    assert np.count_nonzero(chain.weights[:, 1]) <= len(weights)


# -- the pipeline ------------------------------------------------------------------------


def shingle_bag(text, hashes):
    return np.unique(shingles(hashed(words((text or "").encode()), hashes)), return_counts=True)


def slow_stages(rows, items):
    """Exact, near and benchmark stages over (doc_id, text, extra), comparing all with all."""
    import re

    hashes = WordHashes()
    last = lambda row: (row[0] is None, row[0] or 0)

    def first_of(group):
        return min(group, key=last)

    groups = {}
    for row in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", row[1] or ""), []).append(row)
    exact = [first_of(group) for group in groups.values()]
    label = list(range(len(exact)))
    bags = [shingle_bag(row[1], hashes) for row in exact]
    for i in range(len(exact)):
        for j in range(i):
            if weighted_jaccard(bags[i], bags[j]) >= 0.8:
                low, high = sorted((label[i], label[j]))
                label = [low if v == high else v for v in label]
    classes = {}
    for row, own in zip(exact, label, strict=True):
        classes.setdefault(own, []).append(row)
    near = [first_of(group) for group in classes.values()]
    clean = []
    for row in near:
        tokens = words((row[1] or "").encode())
        hit = False
        for item in items:
            wanted = words(item.encode())
            for at in range(max(1, len(tokens) - len(wanted) + 1)):
                window = tokens[at : at + len(wanted)]
                pair = [np.unique(shingles(hashed(t, hashes)), return_counts=True) for t in (window, wanted)]
                hit |= len(window) >= 5 and weighted_jaccard(*pair) >= 0.8
        if not hit:
            clean.append(row)
    return exact, near, clean


def corpus():
    choose = random.Random(11)
    vocabulary = [f"w{i}é" for i in range(400)]

    def text(n):
        return " ".join(choose.choices(vocabulary, k=n))

    items = [text(20), text(33)]
    base = text(120)
    edited = base.split()
    edited[60] = "changed"
    rows = [
        (0, base), (1, " ".join(edited)), (2, base.replace(" ", "  ")), (None, base), (None, text(40)), (None, text(41)),
        (7, text(50)), (7, text(50)), (8, None), (9, ""), (10, " \n"), (11, "one two"), (12, "One two"),
        (13, text(30) + " " + items[0] + " " + text(9)), (14, items[1]), (15, text(8_000)),
    ]
    rows += [(16, rows[6][1]), (17, "tie tie tie tie tie tie"), (17, "tie tie tie tie tie tie")]
    return [(*row, f"extra {n}") for n, row in enumerate(rows)], items


def test_pipeline_stages_match_brute_force(spark, tmp_path):
    rows, items = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(4)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    exact, near, clean = slow_stages(rows, items)
    frame = docs
    for name, want in (("exact_dedup", exact), ("near_dedup", near), ("decontamination", clean)):
        frame = stages[name](spark, frame, str(tmp_path)).cache()
        assert frame.columns == docs.columns
        kept = [(r.doc_id, r.text or "") for r in frame.collect()]
        if name == "exact_dedup":  # white space may differ between the row kept here and there
            kept = [(i, " ".join(t.split())) for i, t in kept]
            want = [(i, " ".join((t or "").split()), e) for i, t, e in want]
        assert sorted(map(repr, kept)) == sorted(repr((i, t or "")) for i, t, _ in want), name
    packed = stages["packing"](spark, frame, str(tmp_path)).collect()
    assert Counter(p.doc_id for p in packed if p.start == 0) == Counter(i for i, _, _ in clean)


def test_whole_pipeline_keeps_unique_documents(spark, tmp_path):
    rows, items = corpus()
    toxic = [(100 + i, f"awful words number {i} filth filth", "x") for i in range(60)]
    mild = [(200 + i, f"kind words number {i} here w{i}é", "x") for i in range(60)]
    frame = spark.createDataFrame([*rows, *toxic, *mild], "doc_id long, text string, row string")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 0, 1) for i, _, _ in toxic] + [(i, 1, 0) for i, _, _ in mild]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(
        str(tmp_path / "benchmark.parquet")
    )
    left = Counter(p.doc_id for p in corpus_pipeline.run(spark, str(tmp_path)).collect() if p.start == 0)
    assert not any(100 <= (i or 0) < 160 for i in left)
    _, _, clean = slow_stages([*rows, *mild], items)
    assert left == Counter(i for i, _, _ in clean)

"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other. Each is a logistic model over hashed features of
the words and, as further inputs, the logits of the categories before it. For training, those
earlier logits are out-of-fold predictions, so that a later model sees them as wrong as they
will be on new text; for prediction they come from models fitted on all training rows.

A word without surrounding marks yields itself, its prefixes of 5 to 8 bytes and the marks after
it as features. A model uses those that occur in ``LEAST_DOCS`` of its training rows and whose
share of rows differs between the classes by ``LEAST_Z`` standard errors. A feature's value is its count over the square root of the number of words. So a document's logit
is a sum over words, and long documents are neither favoured nor diluted.

The models are fitted on at most ``MAX_LABELLED`` labelled rows (those with the least hash of
id), in one task; everything else runs over all rows. Training needs both classes of a category:
a category with one class only, or none, gets that class's smoothed rate as probability.

Cases: null and empty texts have no features and get the probability of the intercept. Labels
that are null are left out category by category; label rows without a document are ignored;
ids that repeat in the labels use the row with the greatest labels. Documents with a null id are
scored, not trained on. Repeated documents are scored alike. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .book import query, table
from .words import Remembered, texts, words

MAX_LABELLED = 6000
FOLDS = 3
DIMENSIONS = 1 << 18
PREFIXES = (5, 6, 7, 8)
EPOCHS = 60
BATCH = 64
RATE = 1.0
L2 = 1e-6
LEAST_DOCS = 8
LEAST_Z = 4.0
_MARKS = b".,!?;:|#$%&*\"()[]{}'-_/"


def word_features(word: bytes) -> list[int]:
    core = word.strip(_MARKS) or word
    parts = [b"w" + core] + [b"p" + core[:n] for n in PREFIXES if len(core) >= n]
    tail = word[len(word.rstrip(_MARKS)) :]
    if tail:
        parts.append(b"m" + tail)
    return [xxhash.xxh3_64_intdigest(part) % DIMENSIONS for part in parts]


class WordSums(Remembered):
    """The summed weights of a word's features, one for each category."""

    LIMIT = 75_000

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def make(self, word: bytes) -> tuple[float, ...]:
        return tuple(self.weights[word_features(word)].sum(axis=0).tolist())


class Chain:
    """Fitted weights: features x categories, intercepts, and weights of earlier logits."""

    def __init__(self, weights: np.ndarray, intercepts: np.ndarray, earlier: np.ndarray):
        self.weights, self.intercepts, self.earlier = weights, intercepts, earlier

    def logits(self, sums: np.ndarray) -> np.ndarray:
        """From each document's scaled sums of word weights."""
        out = np.zeros_like(sums)
        for c in range(sums.shape[1]):
            out[:, c] = sums[:, c] + self.intercepts[c] + out[:, :c] @ self.earlier[c, :c]
        return out


def informative(indptr: np.ndarray, indices: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which features tell the classes apart; a row lists a feature once."""
    with_feature = []
    for value in (1, 0):
        spans = [indices[indptr[r] : indptr[r + 1]] for r in rows[labels[rows] == value]]
        with_feature.append(np.bincount(np.concatenate(spans), minlength=DIMENSIONS))
    positive = labels[rows].sum()
    negative = len(rows) - positive
    share = (with_feature[0] + with_feature[1]) / len(rows)
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / positive + 1 / negative))
    z = np.abs(with_feature[0] / positive - with_feature[1] / negative) / error
    return (with_feature[0] + with_feature[1] >= LEAST_DOCS) & (z >= LEAST_Z)


def _batches(rows: np.ndarray, indptr: np.ndarray, indices: np.ndarray, values: np.ndarray) -> list[tuple]:
    made = []
    for start in range(0, len(rows), BATCH):
        chosen = rows[start : start + BATCH]
        spans = [np.arange(indptr[r], indptr[r + 1]) for r in chosen]
        at = np.concatenate(spans)
        owner = np.repeat(np.arange(len(chosen)), [len(s) for s in spans])
        unique, place = np.unique(indices[at], return_inverse=True)
        made.append((chosen, unique, place, owner, values[at]))
    return made


def fit_logistic(
    data: tuple[np.ndarray, np.ndarray, np.ndarray], extra: np.ndarray, labels: np.ndarray, rows: np.ndarray
) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, intercept and weights of ``extra`` by AdaGrad over fixed mini-batches."""
    weights, more = np.zeros(DIMENSIONS), np.zeros(extra.shape[1])
    positive = labels[rows].sum()
    bias = math.log((positive + 0.5) / (len(rows) - positive + 0.5))
    if positive in (0, len(rows)):
        return weights, bias, more
    indptr, indices, values = data
    used = informative(indptr, indices, labels, rows)[indices]
    data = (np.concatenate([[0], np.cumsum(used)])[indptr], indices[used], values[used])
    squares, bias_square, more_squares = np.full(DIMENSIONS, 1e-4), 1e-4, np.full(extra.shape[1], 1e-4)
    batches = _batches(rows, *data)
    for _ in range(EPOCHS):
        for chosen, unique, place, owner, value in batches:
            logit = np.bincount(owner, value * weights[unique][place], len(chosen)) + bias + extra[chosen] @ more
            error = 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[chosen]
            gradient = np.bincount(place, value * error[owner], len(unique)) / len(chosen) + L2 * weights[unique]
            squares[unique] += gradient**2
            weights[unique] -= RATE * gradient / np.sqrt(squares[unique])
            step = error.mean()
            bias_square += step**2
            bias -= RATE * 0.2 * step / math.sqrt(bias_square)
            slope = extra[chosen].T @ error / len(chosen) + L2 * more
            more_squares += slope**2
            more -= RATE * 0.2 * slope / np.sqrt(more_squares)
    return weights, bias, more


def fit_chain(data: tuple[np.ndarray, np.ndarray, np.ndarray], labels: np.ndarray, folds: np.ndarray) -> Chain:
    """``labels`` is rows x categories with NaN where unknown."""
    indptr, indices, values = data
    n, categories = labels.shape
    owner = np.repeat(np.arange(n), np.diff(indptr))
    earlier_logits = np.zeros((n, 0))
    weights, intercepts = np.zeros((DIMENSIONS, categories)), np.zeros(categories)
    earlier = np.zeros((categories, categories))
    for c in range(categories):
        known = np.flatnonzero(~np.isnan(labels[:, c]))
        target = np.nan_to_num(labels[:, c])
        weights[:, c], intercepts[c], earlier[c, :c] = fit_logistic(data, earlier_logits, target, known)
        if c + 1 < categories:
            held_out = np.zeros(n)
            for fold in range(FOLDS):
                w, b, m = fit_logistic(data, earlier_logits, target, known[folds[known] != fold])
                logit = np.bincount(owner, values * w[indices], n) + b + earlier_logits @ m
                held_out[folds == fold] = logit[folds == fold]
            earlier_logits = np.column_stack([earlier_logits, held_out])
    return Chain(weights, intercepts, earlier)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse features of training documents."""
    for batch in batches:
        indices, values = [], []
        for text in texts(batch):
            tokens = words(text)
            found = np.array([f for word in tokens for f in word_features(word)], np.int64)
            unique, counts = np.unique(found, return_counts=True)
            indices.append(unique.astype(np.int32))
            values.append((counts / math.sqrt(max(1, len(tokens)))).astype(np.float32))
        columns = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "text"]
        names = [name for name in batch.schema.names if name != "text"]
        columns += [pa.array(indices, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))]
        yield pa.RecordBatch.from_arrays(columns, [*names, "indices", "counts"])


def train(
    docs: DataFrame, labels: DataFrame, categories: Sequence[str], id_col: str = "doc_id", text_col: str = "text"
) -> Chain:
    """A chain over label columns (0, 1 or null), in the order given."""
    names = [f"y{i}" for i in range(len(categories))]
    sample = (
        labels.where(F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg(*[F.max(F.col(c).cast("double")).alias(n) for c, n in zip(categories, names, strict=True)])
        .orderBy(F.xxhash64("id"), "id")
        .limit(MAX_LABELLED)
    )
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    joined = chosen.join(F.broadcast(sample), "id").dropDuplicates(["id"])
    joined = joined.select("text", F.pmod(F.xxhash64("id"), F.lit(FOLDS)).cast("int").alias("fold"), "id", *names)
    kind = joined.schema["id"].dataType.simpleString()
    schema = f"fold int, id {kind}, {''.join(f'{n} double, ' for n in names)}indices array<int>, counts array<float>"
    featured = joined.mapInArrow(_features, schema)

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        indptr = np.concatenate([[0], np.cumsum([len(x) for x in rows["indices"]])]).astype(np.int64)
        data = (indptr, np.concatenate(list(rows["indices"])), np.concatenate(list(rows["counts"])).astype(np.float64))
        chain = fit_chain(data, rows[names].to_numpy(float), rows["fold"].to_numpy())
        parts = (chain.weights, chain.intercepts, chain.earlier)
        return pd.DataFrame([[part.astype("<f8").tobytes() for part in parts]], columns=["w", "b", "e"])

    fitted = featured.groupBy().applyInPandas(fit, "w binary, b binary, e binary").collect()
    n = len(categories)
    if not fitted:
        return Chain(np.zeros((DIMENSIONS, n)), np.zeros(n), np.zeros((n, n)))
    w, b, e = (np.frombuffer(part, "<f8") for part in fitted[0])
    return Chain(w.reshape(DIMENSIONS, n), b, e.reshape(n, n))


def _scored(chain: Chain, batch: pa.RecordBatch, column: str, sums: WordSums) -> np.ndarray:
    out = []
    for text in texts(batch, column):
        tokens = words(text)
        found = np.array(list(map(sums.__getitem__, tokens))).reshape(-1, len(chain.intercepts))
        out.append(found.sum(axis=0) / math.sqrt(max(1, len(tokens))))
    logits = chain.logits(np.array(out).reshape(-1, len(chain.intercepts)))
    return 1 / (1 + np.exp(-logits))


def score(
    docs: DataFrame, chain: Chain, categories: Sequence[str], id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id and the probability of each category, for each row."""
    fitted = docs.sparkSession.sparkContext.broadcast(chain)
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"{c} double" for c in categories)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = WordSums(fitted.value.weights)
        for batch in batches:
            found = _scored(fitted.value, batch, "text", sums)
            arrays = [batch.column(0), *[pa.array(found[:, c]) for c in range(found.shape[1])]]
            yield pa.RecordBatch.from_arrays(arrays, ["id", *categories])

    return chosen.mapInArrow(run, schema)


def keep_clean(docs: DataFrame, chain: Chain, category: int, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents, with all columns, whose probability of a category is below the threshold."""
    fitted = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = WordSums(fitted.value.weights)
        for batch in batches:
            found = _scored(fitted.value, batch, text_col, sums)
            yield batch.filter(pa.array(found[:, category] < threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


CATEGORIES = ("low_quality", "toxic")


def chain_labels(labels: DataFrame) -> DataFrame:
    """The two labelled categories, the less specific first."""
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


@query("op8_classifier_chain")
def op8_classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of the labelled categories for every document, and the decision."""
    docs, labels = table(spark, sf_dir, "documents"), chain_labels(table(spark, sf_dir, "labels"))
    scored = score(docs, train(docs, labels, CATEGORIES), CATEGORIES)
    return scored.select(
        F.col("id").alias("doc_id"),
        F.col("low_quality").alias("p_low_quality"),
        F.col("toxic").alias("p_toxic"),
        (F.col("toxic") >= 0.5).alias("is_toxic"),
    )

"""Language of web pages by Bayesian fusion of evidence.

Four kinds of evidence, taken as independent given the language, are added as log likelihoods:

* text: a naive Bayes model of hashed byte trigrams, learnt from documents of known language;
* the language that the markup declares (no declaration is a value, too);
* the address suffix, the last label of the host;
* a prior of the host, smoothed towards its domain (last two labels), and that towards all pages.

The last three are learnt from the pages themselves: grouped sums of the text posteriors (soft
counts). A page's own share is taken out of the sums of its host, domain, suffix and
declaration before they are applied to it. Each byte lies in three trigrams, so the text's log
likelihood has weight 1/3.

Cases: null and empty pages have no text evidence; null or malformed addresses share the host
'' and get that group's prior. Documents without language or text are not learnt from. Ties go
to the language first in the alphabet. Repeated pages count and are classified each. Without
documents the result has null languages; an empty page table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .book import query, table
from .storage import stored
from .words import mixed, texts

BUCKETS = 1 << 15
LANGUAGES_TOGETHER = 256
TEXT_WEIGHT = 1 / 3
SMOOTHING = 0.5
HOST_STRENGTH = 5.0
DOMAIN_STRENGTH = 20.0
VALUE_STRENGTH = 5.0

_HIDDEN = re.compile(rb"<!--.*?-->|<(script|style)\b.*?</\1\s*>", re.DOTALL | re.IGNORECASE)
_TAG = re.compile(rb"<[^>]*>")
_DECLARED = re.compile(rb"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})\b", re.IGNORECASE)
_SPACE = re.compile(rb"[\x20\x09-\x0D]+")


def trigrams(text: bytes) -> np.ndarray:
    data = np.frombuffer(b" " + _SPACE.sub(b" ", text.lower()) + b" ", np.uint8).astype(np.uint64)
    if len(data) < 3:
        return np.empty(0, np.int64)
    codes = data[:-2] << np.uint64(16) | data[1:-1] << np.uint64(8) | data[2:]
    return (mixed(codes) % np.uint64(BUCKETS)).astype(np.int64)


def visible(page: bytes) -> bytes:
    """Text outside tags, comments, scripts and styles, with entities resolved."""
    text = _TAG.sub(b" ", _HIDDEN.sub(b" ", page))
    return html.unescape(text.decode("utf-8", "replace")).encode() if b"&" in text else text


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


class TextModel:
    """Languages, in order, and the counts of their trigram buckets (lang, bucket, n)."""

    def __init__(self, languages: list[str], counts: DataFrame):
        self.languages, self.counts = languages, counts

    def block(self, start: int) -> np.ndarray:
        """Log likelihoods, buckets x languages, of up to ``LANGUAGES_TOGETHER`` languages."""
        chosen = self.languages[start : start + LANGUAGES_TOGETHER]
        place = {lang: i for i, lang in enumerate(chosen)}
        smooth = np.full((BUCKETS, len(chosen)), SMOOTHING)
        own = self.counts.where(F.col("lang").between(chosen[0], chosen[-1]))
        for row in own.toLocalIterator():  # at most BUCKETS rows a language
            smooth[row.bucket, place[row.lang]] += row.n
        return np.log(smooth / smooth.sum(axis=0, keepdims=True))


def train_text(docs: DataFrame, language_col: str = "lang", text_col: str = "text") -> TextModel:
    chosen = docs.where(F.col(language_col).isNotNull()).select(
        F.col(language_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
                if lang not in totals:
                    totals[lang] = np.zeros(BUCKETS, np.int64)
                if text:
                    totals[lang] += np.bincount(trigrams(text), minlength=BUCKETS)
        for lang, found in totals.items():
            used = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(found[used])],
                ["lang", "bucket", "n"],
            )

    counts = stored(
        chosen.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    )
    languages = sorted(row.lang for row in counts.select("lang").distinct().collect())
    return TextModel(languages, counts)


def text_evidence(pages: DataFrame, model: TextModel, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """id, host, domain, suffix, declared, log likelihoods and text posterior of each page.

    Up to ``LANGUAGES_TOGETHER`` languages are one pass with one table of likelihoods in each worker;
    more are added pass by pass, with the pages stored in between.
    """
    chosen = pages.select(
        F.col(id_col).alias("id"),
        F.col(url_col).cast("string").alias("url"),
        F.col(html_col).cast("string").alias("html"),
        F.array().cast("array<double>").alias("scores"),
    )
    last = (len(model.languages) - 1) // LANGUAGES_TOGETHER * LANGUAGES_TOGETHER
    for start in range(0, last, LANGUAGES_TOGETHER):
        chosen = stored(_with_scores(chosen, model.block(start)))
    return _with_facts(chosen, model.block(last))


def _page_scores(batch: pa.RecordBatch, log_likelihood: np.ndarray) -> list[np.ndarray]:
    """The scores so far, and those of one block of languages, of each page."""
    found = []
    for page, before in zip(texts(batch, "html"), batch.column(3).to_pylist(), strict=True):
        text = visible(page)
        score = np.zeros(log_likelihood.shape[1])
        if text.strip():
            score = TEXT_WEIGHT * log_likelihood[trigrams(text)].sum(axis=0)
        found.append(np.concatenate([before or [], score]))
    return found


def _with_scores(pages: DataFrame, log_likelihood: np.ndarray) -> DataFrame:
    shared = pages.sparkSession.sparkContext.broadcast(log_likelihood)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array(_page_scores(batch, shared.value), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], scores], batch.schema.names)

    return pages.mapInArrow(run, pages.schema)


def _with_facts(pages: DataFrame, log_likelihood: np.ndarray) -> DataFrame:
    shared = pages.sparkSession.sparkContext.broadcast(log_likelihood)
    schema = (
        f"id {pages.schema['id'].dataType.simpleString()}, host string, domain string, suffix string, declared string,"
        " evidence array<double>, posterior array<double>"
    )
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts = [host_of(url) for url in batch.column(1).to_pylist()]
            declared, evidence, posterior = [], [], []
            for page in texts(batch, "html"):
                found = _DECLARED.search(page)
                declared.append(found.group(1).decode().lower() if found else "")
            for score in _page_scores(batch, shared.value):
                share = np.exp(score - score.max())
                evidence.append(score - score.max())
                posterior.append(share / share.sum())
            arrays = [
                batch.column(0),
                pa.array(hosts, pa.string()),
                pa.array([".".join(h.split(".")[-2:]) for h in hosts], pa.string()),
                pa.array([h.rpartition(".")[2] for h in hosts], pa.string()),
                pa.array(declared, pa.string()),
                pa.array(evidence, pa.list_(pa.float64())),
                pa.array(posterior, pa.list_(pa.float64())),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return pages.mapInArrow(run, schema)


def classify_pages(
    pages: DataFrame, model: TextModel, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """id, host, declared, text_language, language, probability of each page."""
    languages = model.languages
    if not languages:
        none = F.lit(None).cast("string")
        return pages.select(
            F.col(id_col).alias("id"), none.alias("host"), none.alias("declared"), none.alias("text_language"),
            none.alias("language"), F.lit(None).cast("double").alias("probability"),
        )
    n = len(languages)
    evidence = stored(text_evidence(pages, model, id_col, url_col, html_col))

    def sums(*keys: str, source: DataFrame = evidence) -> DataFrame:
        each = [F.sum(F.get("posterior", F.lit(i))).alias(f"s{i}") for i in range(n)]
        summed = source.groupBy(*keys).agg(*each)
        return summed.select(*keys, F.array(*[f"s{i}" for i in range(n)]).alias("posterior"))

    by_host = stored(sums("host", "domain", "suffix"))
    by_domain, by_suffix = sums("domain", source=by_host), sums("suffix", source=by_host)
    everything = sums(source=by_host).first()
    totals = [float(x or 0.0) for x in everything.posterior] if everything else [0.0] * n
    total = sum(totals)
    hosts = stored(
        by_host.withColumnRenamed("posterior", "of_host")
        .join(by_domain.withColumnRenamed("posterior", "of_domain"), "domain")
        .join(by_suffix.withColumnRenamed("posterior", "of_suffix"), "suffix")
        .select("host", "of_host", "of_domain", "of_suffix")
    )
    # Declarations have two or three letters, so there are at most 18,279 of them.
    by_declared = sums("declared").withColumnRenamed("posterior", "of_declared")

    def value(of: str, i: int) -> Column:
        return F.greatest(F.get(of, F.lit(i)) - F.get("posterior", F.lit(i)), F.lit(0.0))

    def whole(of: str) -> Column:
        return F.greatest(F.aggregate(of, F.lit(0.0), lambda a, x: a + x) - 1, F.lit(0.0))

    logs = []
    for i in range(n):
        base = F.lit((totals[i] + 1) / (total + n))
        domain = (value("of_domain", i) + DOMAIN_STRENGTH * base) / (whole("of_domain") + DOMAIN_STRENGTH)
        host = (value("of_host", i) + HOST_STRENGTH * domain) / (whole("of_host") + HOST_STRENGTH)
        likelihoods = [
            (value(of, i) + VALUE_STRENGTH * (whole(of) + 1) / (total + 1)) / (totals[i] + VALUE_STRENGTH)
            for of in ("of_suffix", "of_declared")
        ]
        logs.append(F.get("evidence", F.lit(i)) + F.log(host) + F.log(likelihoods[0]) + F.log(likelihoods[1]))
    joined = evidence.join(hosts, "host").join(F.broadcast(by_declared), "declared")
    scored = joined.select("id", "host", "declared", "posterior", F.array(*logs).alias("logs")).withColumn(
        "best", F.array_max("logs")
    )
    names = F.array(*[F.lit(name) for name in languages])

    def named(values: str, most: Column) -> Column:
        return F.element_at(names, F.array_position(values, most).cast("int"))

    return scored.select(
        "id",
        "host",
        "declared",
        named("posterior", F.array_max("posterior")).alias("text_language"),
        named("logs", F.col("best")).alias("language"),
        (1 / F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("best")))).alias("probability"),
    )


@query("op2_language_evidence")
def op2_language_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every page."""
    model = train_text(table(spark, sf_dir, "documents"))
    return classify_pages(table(spark, sf_dir, "pages"), model).withColumnRenamed("id", "page_id")

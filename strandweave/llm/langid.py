"""Language identification by Bayesian fusion of text, markup, address and host evidence (operator 4)."""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.core.session import bounded, checkpoint, ship
from strandweave.llm import textscan

BUCKETS = 1 << 16
MOST_LANGUAGES = 200  #: of the documents, all together; more are refused before any page is read
HELD_LANGUAGES = 32  #: whose counts a task holds before it gives its sums so far
BROADCAST = 4_000_000  #: most numbers of an evidence table that is broadcast
#: Weight of a byte trigram's log likelihood: neighbours overlap, so they are not independent.
TEMPER = 0.1
DOMAIN_WEIGHT, HOST_WEIGHT, TABLE_WEIGHT = 10.0, 5.0, 5.0

_DROP = re.compile(r"<!--.*?-->|<(script|style|nav|template)\b[^>]*>.*?</\1\s*>|<[^>]*>", re.S | re.I)
_DECLARED = r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})"
_META = r"(?i)<meta\b[^>]*?content-language[^>]*?content\s*=\s*[\"']?([A-Za-z]{2,3})"


def trigrams(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed lower-case byte trigrams of texts end to end, and the text of each; runs of white space, digits and punctuation are one space."""
    if len(raw) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    b = textscan.LOWER[raw]
    gap = ((b < 0x61) | ((b > 0x7A) & (b < 0x80)))
    b = np.where(gap, 0x20, b).astype(np.int64)
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))
    keep = np.ones(len(b), dtype=bool)
    keep[1:] = ~(gap[1:] & gap[:-1] & (text[1:] == text[:-1]))
    b, text = b[keep], text[keep]
    key = (b[:-2] * 2654435761 + b[1:-1] * 40503 * 257 + b[2:] * 69069) % 1_000_003 % BUCKETS
    same = text[:-2] == text[2:]
    return key[same], text[:-2][same]


class TextModel:
    """Log likelihood of each language's trigrams, smoothed towards the even spread."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        share = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True) if len(languages) else counts
        self.log = np.log(share)

    @staticmethod
    def fit(docs: DataFrame) -> TextModel:
        """Counts over all documents with a language: every task sums its own rows into one table a language before anything is shuffled.

        Over MOST_LANGUAGES distinct languages raise a ValueError, however the
        rows are partitioned.
        """
        ship(docs.sparkSession)
        known = docs.where("lang is not null and text is not null")
        languages = sorted(r[0] for r in known.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
        if len(languages) > MOST_LANGUAGES:
            raise ValueError(f"over {MOST_LANGUAGES} languages")
        place = {x: i for i, x in enumerate(languages)}

        def give(total):
            for i, c in sorted(total.items()):
                at = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, dtype=np.int32)), pa.array(at.astype(np.int32)), pa.array(c[at])], names=["lang", "bucket", "n"])

        def run(batches):
            total: dict[int, np.ndarray] = {}
            for part in textscan.runs(batches):
                raw, off = textscan.text_bytes(part.column(1))
                key, text = trigrams(raw, off)
                code = np.array([place[x] for x in part.column(0).to_pylist()])[text]
                for i in np.unique(code).tolist():
                    total[i] = total.get(i, 0) + np.bincount(key[code == i], minlength=BUCKETS)
                if len(total) > HELD_LANGUAGES:
                    yield from give(total)
                    total = {}
            yield from give(total)

        rows = known.select("lang", "text").mapInArrow(run, "lang int, bucket int, n long")
        table = rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros((len(languages), BUCKETS))
        counts[table["lang"], table["bucket"]] = table["n"]
        return TextModel(languages, counts)

    def likelihoods(self, column: pa.Array) -> np.ndarray:
        """Tempered log likelihood of each text for each language, the best one at zero."""
        raw, off = textscan.text_bytes(column)
        key, text = trigrams(raw, off)
        out = np.stack([np.bincount(text, weights=row[key], minlength=len(column)) for row in self.log], axis=1) * TEMPER
        return out - out.max(axis=1, keepdims=True)


def visible(markup: str | None) -> str:
    return html.unescape(_DROP.sub(" ", markup or ""))


def evidence(pages: DataFrame, model: TextModel) -> DataFrame:
    """(page_id, declared, host, domain, suffix, ll): the evidence of each page; the texts are read once and not shuffled."""
    ship(pages.sparkSession)
    names = ["page_id", "declared", "host", "domain", "suffix", "ll"]

    def run(batches):
        for part in textscan.runs(batches, "html"):
            ll = model.likelihoods(pa.array([visible(t) for t in part.column(5).to_pylist()], pa.string()))
            yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array(list(ll), pa.list_(pa.float64()))], names=names)

    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    tag = F.regexp_extract(F.coalesce("html", F.lit("")), _DECLARED, 1)
    declared = F.lower(F.when(tag != "", tag).otherwise(F.regexp_extract(F.coalesce("html", F.lit("")), _META, 1)))
    rows = pages.select(
        F.col("page_id").cast("long"), declared.alias("declared"), host.alias("host"), F.substring_index(host, ".", -2).alias("domain"),
        F.substring_index(host, ".", -1).alias("suffix"), "html",
    )
    return rows.mapInArrow(run, "page_id long, declared string, host string, domain string, suffix string, ll array<double>")


def _normal(logs):
    """Shares from log weights."""
    top = F.array_max(logs)
    up = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(up, F.lit(0.0), lambda a, x: a + x)
    return F.transform(up, lambda x: x / total)


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """(page_id, lang, probability, text_lang, declared, host) of every page.

    Posterior: text likelihood, times the chance of the declared language and
    of the address suffix given the language, times the host's prior. Those
    tables are sums of the pages' text-only posteriors by group, without the
    page's own; the host's prior is smoothed towards its domain's and that
    towards all pages'. All are aggregates with map-side combine over all
    pages, joined back by host, suffix and declaration. Null or empty pages
    have even text likelihoods; a missing declaration or host is a value like
    any other. Without any labelled text lang is null. Repeated rows are
    judged each.
    """
    model = TextModel.fit(docs)
    langs = model.languages
    if not langs:
        none = F.lit(None).cast("string")
        return pages.select(F.col("page_id").cast("long"), none.alias("lang"), F.lit(None).cast("double").alias("probability"), none.alias("text_lang"), none.alias("declared"), none.alias("host"))
    n = len(langs)
    base = checkpoint(evidence(pages, model).withColumn("t", _normal(F.col("ll"))))
    sums = [F.sum(F.col("t")[i]) for i in range(n)]

    def table(key: str, name: str) -> DataFrame:
        """Sums by key, broadcast if they are few, so that the rows of a hot key stay where they are."""
        return bounded(checkpoint(base.groupBy(key).agg(F.array(*sums).alias(name))), BROADCAST // n)

    all_ = [x or 0.0 for x in (base.agg(F.array(*sums)).first()[0] or [0.0] * n)]
    whole = sum(all_) or 1.0
    prior = F.array(*[F.lit((x + 1.0) / (whole + n)) for x in all_])
    total = F.array(*[F.lit(x) for x in all_])
    rows = base.join(table("host", "in_host"), "host").join(table("domain", "in_domain"), "domain").join(table("suffix", "in_suffix"), "suffix").join(table("declared", "in_declared"), "declared")
    plus = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    less = lambda c: F.zip_with(c, "t", lambda a, b: F.greatest(a - b, F.lit(0.0)))
    for c in ("in_host", "in_domain", "in_suffix", "in_declared"):
        rows = rows.withColumn(c, less(c))
    smooth = lambda counts, to, weight: F.zip_with(counts, to, lambda a, p: (a + weight * p) / (plus(F.col(counts)) + weight))
    rows = rows.withColumn("rest", less(total)).withColumn("by_domain", smooth("in_domain", prior, DOMAIN_WEIGHT)).withColumn("by_host", smooth("in_host", F.col("by_domain"), HOST_WEIGHT))
    # chance of the declaration and of the suffix given the language, smoothed by their share of all pages
    given = lambda c: F.zip_with(c, "rest", lambda a, b: F.log((a + TABLE_WEIGHT * (plus(F.col(c)) + 1.0) / (whole + 1.0)) / (b + TABLE_WEIGHT)))
    log = F.zip_with(F.zip_with("ll", F.transform("by_host", lambda x: F.log(x)), lambda a, b: a + b), F.zip_with(given("in_declared"), given("in_suffix"), lambda a, b: a + b), lambda a, b: a + b)
    rows = rows.withColumn("p", _normal(log))
    best = lambda c: F.element_at(F.array(*[F.lit(x) for x in langs]), F.array_position(c, F.array_max(c)).cast("int"))
    return rows.select("page_id", best("p").alias("lang"), F.array_max("p").alias("probability"), best("t").alias("text_lang"), "declared", "host")

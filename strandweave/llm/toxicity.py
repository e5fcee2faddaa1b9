"""Toxicity scores from a counterfactually regularised linear classifier (operator 2)."""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.core.session import extended, free_name, ship
from strandweave.llm import textscan

BUCKETS = 1 << 18  #: hashed word features
SAMPLE = 6_000  #: most labelled rows that training takes, a third of them toxic where there are enough
TOXIC_WEIGHT = 3.0  #: of a toxic row against a clean one in training
PREFIXES = (4, 5, 6, 7, 8)  #: bytes of a word's beginning that are features too
#: Identity terms by pair; a counterfactual swaps each for its partner.
IDENTITY_PAIRS = (
    ("woman", "man"), ("women", "men"), ("girl", "boy"), ("girls", "boys"), ("she", "he"), ("her", "his"), ("mother", "father"),
    ("black", "white"), ("muslim", "christian"), ("jewish", "hindu"), ("gay", "straight"), ("immigrant", "citizen"), ("old", "young"),
    ("frau", "mann"), ("frauen", "männer"), ("sie", "er"), ("femme", "homme"), ("femmes", "hommes"), ("elle", "il"),
    ("mujer", "hombre"), ("mujeres", "hombres"), ("ella", "él"),
)


def word_ids(column: pa.Array, prefixes=PREFIXES) -> tuple[np.ndarray, np.ndarray]:
    """Hashed ids of each text's features, and each text's first feature.

    A feature is a lower-cased word without the ASCII punctuation around it,
    or the first 4 to 8 bytes of a longer one; each word gives as many ids,
    repeating its own where it is too short.
    """
    w = textscan.words(column, lower=True)
    letter = (w.raw >= 0x80) | ((w.raw >= 0x30) & (w.raw <= 0x39)) | ((w.raw >= 0x61) & (w.raw <= 0x7A))
    solid = np.flatnonzero(letter)
    a, b = np.searchsorted(solid, w.start), np.searchsorted(solid, w.end)
    some = b > a
    start, end = w.start, w.end
    if len(solid):
        start = np.where(some, solid[np.minimum(a, len(solid) - 1)], start)
        end = np.where(some, solid[np.maximum(b - 1, 0)] + 1, end)
    whole = textscan.segment_hash(w.raw, start, end, (0,))[0]
    out = np.empty((len(start), 1 + len(prefixes)), dtype=np.int64)
    out[:, 0] = whole % np.uint64(BUCKETS)
    term = _terms()[out[:, 0]] if len(prefixes) else None  # an identity term is one feature, so that swapping it is whole
    total = None
    for i, n in enumerate(prefixes):
        longer = end - start > n
        h, total = textscan.prefix_hash(w.raw, start, np.minimum(end, start + n), total)
        longer &= ~term
        out[:, i + 1] = np.where(longer, textscan.mix(h ^ np.uint64(n)) % np.uint64(BUCKETS), out[:, 0])
    return out.ravel(), w.first * (1 + len(prefixes))


@lru_cache
def _terms() -> np.ndarray:
    out = np.zeros(BUCKETS, dtype=bool)
    out[_term_ids([t for pair in IDENTITY_PAIRS for t in pair])] = True
    return out


def _term_ids(terms) -> np.ndarray:
    return word_ids(pa.array([" ".join(terms)]), ())[0]


def swaps(pairs=IDENTITY_PAIRS) -> np.ndarray:
    """The feature that a counterfactual text has in place of each feature."""
    other = np.arange(BUCKETS)
    a, b = _term_ids([p[0] for p in pairs]), _term_ids([p[1] for p in pairs])
    other[a], other[b] = b, a
    return other


class Model:
    """P(toxic) = sigmoid(bias + the weights of a text's distinct words)."""

    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight, bias

    @staticmethod
    def fit(texts: list[np.ndarray], labels: np.ndarray, pairs=IDENTITY_PAIRS, fairness: float = 1.0, l2: float = 1e-3, rounds: int = 40, least: int = 5, toxic_weight: float = TOXIC_WEIGHT, seed: int = 7) -> Model:
        """Fit to texts given as their distinct features, in any fixed order.

        Minimises log loss + fairness * (score change under identity swaps)^2 + l2 * |w|^2 by Adam.
        Rows of either label are weighted by ``toxic_weight``. Features of fewer than ``least`` sampled texts keep weight zero, but a
        term and its partner are kept or left together.
        """
        other = swaps(pairs)
        weight, bias = np.zeros(BUCKETS), 0.0
        if not len(texts) or labels.min() == labels.max():
            return Model(weight, (6.0 if len(labels) and labels.min() else -6.0))
        seen = np.zeros(BUCKETS, dtype=np.int64)
        for t in texts:
            seen[t] += 1
        keep = (seen + np.where(other != np.arange(BUCKETS), seen[other], 0)) >= least
        ids = np.flatnonzero(keep)
        dense = np.full(BUCKETS, -1, dtype=np.int32)
        dense[ids] = np.arange(len(ids))
        texts = [dense[t[keep[t]]] for t in texts]
        partner = dense[other[ids]]
        touched = partner != np.arange(len(ids))
        w, rng = np.zeros(len(ids)), np.random.default_rng(seed)
        m, v, step = np.zeros(len(ids) + 1), np.zeros(len(ids) + 1), 0
        share, cost = labels.mean(), np.where(labels == 1, toxic_weight, 1.0)
        bias = float(np.log(share / (1 - share)))
        for turn in range(rounds):
            order = rng.permutation(len(texts))
            rate = 0.1 * (1 - turn / rounds) + 0.005
            for at in range(0, len(order), 256):
                rows = order[at : at + 256]
                x = np.concatenate([texts[i] for i in rows])
                of = np.repeat(np.arange(len(rows)), [len(texts[i]) for i in rows])
                z = np.bincount(of, weights=w[x], minlength=len(rows)) + bias
                gz = cost[rows] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[rows]) / len(rows)
                g = np.zeros(len(ids) + 1)
                g[:-1] = np.bincount(x, weights=gz[of], minlength=len(ids)) + l2 * w
                t = touched[x]
                if t.any():  # z minus the swapped text's z is a sum over the identity terms in the text
                    xs, fs = x[t], of[t]
                    gap = np.bincount(fs, weights=w[xs] - w[partner[xs]], minlength=len(rows))
                    push = 2 * fairness * gap[fs] / len(rows)
                    g[:-1] += np.bincount(xs, weights=push, minlength=len(ids)) - np.bincount(partner[xs], weights=push, minlength=len(ids))
                g[-1] = gz.sum()
                step += 1
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                w -= move[:-1]
                bias -= move[-1]
        weight[ids] = w
        return Model(weight, float(bias))

    def scores(self, column: pa.Array) -> np.ndarray:
        x, first = word_ids(column)
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        own = self.weight[x]
        heavy = np.flatnonzero(own != 0)
        key = np.unique(text[heavy] * BUCKETS + x[heavy])
        z = np.bincount(key // BUCKETS, weights=self.weight[key % BUCKETS], minlength=len(first) - 1)
        return 1 / (1 + np.exp(-np.clip(z + self.bias, -30, 30)))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and labels of at most ``sample`` labelled training rows, chosen by a hash of doc_id.

    Rows are chosen before the texts are touched, so the only thing broadcast
    is the list of at most ``sample`` ids, and only their hashed features come
    to the driver.
    """
    ship(docs.sparkSession)

    def run(batches):
        for part in textscan.runs(batches):
            x, first = word_ids(part.column(1))
            rows = [np.unique(x[a:b]).astype(np.int32).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.binary())], names=["toxic", "features"])

    train = (
        labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out("doc_id"))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    )
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = train.where("toxic = 1").orderBy(*order).limit(sample // 3).union(train.where("toxic = 0").orderBy(*order).limit(sample - sample // 3))
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = texts.join(F.broadcast(chosen), "doc_id").select("toxic", "text").mapInArrow(run, "toxic int, features binary").toPandas()
    rows = sorted(zip(rows["toxic"].tolist(), rows["features"], strict=True), key=lambda r: (r[0], zlib.crc32(r[1]), r[1]))  # tasks end in any order
    return [np.frombuffer(b, np.int32) for _, b in rows], np.array([float(y) for y, _ in rows])


def held_out(doc_id: str):
    """Whether crc32 of doc_id as text leaves no remainder by 5; false without doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, **options) -> Model:
    return Model.fit(*labelled_sample(docs, labels, sample), **options)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with one more, last column ``score``, the chance of being toxic from the whole text alone; null texts count as empty.

    An input column of that name keeps its values; the new one is then called ``score_``.
    """
    ship(docs.sparkSession)
    name = free_name(docs, "score")
    names = [*docs.columns, name]
    at = docs.columns.index("text")

    def run(batches):
        for part in textscan.runs(batches):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.scores(part.column(at)))], names=names)

    return docs.mapInArrow(run, extended(docs, **{name: "double"}))


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents whose score is under ``threshold``, as they are."""
    scored = score(docs, model)
    return scored.where(F.col(scored.columns[-1]) < threshold).select(*docs.columns)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document.

    Labels are learnt from rows outside the held-out fold only. Without any
    usable label every score is near 0. Labels repeated for a doc_id count
    once, toxic if any says so; rows without doc_id are scored like the rest
    and are not held out.
    """
    model = train(docs, labels, sample)
    ship(docs.sparkSession)
    names = ["doc_id", "held_out", "score"]

    def run(batches):
        for part in textscan.runs(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(model.scores(part.column(2)))], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"), "text")
    out = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return out.select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"))

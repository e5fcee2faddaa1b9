"""Benchmark decontamination by SimHash of item-sized windows, with exact verification (operator 8)."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.core.session import ship
from strandweave.llm import textscan

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 20
BLOCK_BYTES = 16 << 20  #: benchmark text that is sent to the executors at once; a larger benchmark takes several passes


def normal_words(column: pa.Array) -> textscan.Words:
    """Lower-cased words without the ASCII punctuation around them; words of punctuation alone stay whole."""
    w = textscan.words(column, lower=True)
    letter = (w.raw >= 0x80) | ((w.raw >= 0x30) & (w.raw <= 0x39)) | ((w.raw >= 0x61) & (w.raw <= 0x7A))
    solid = np.flatnonzero(letter)
    if len(solid):
        a, b = np.searchsorted(solid, w.start), np.searchsorted(solid, w.end)
        some = b > a
        w.start = np.where(some, solid[np.minimum(a, len(solid) - 1)], w.start)
        w.end = np.where(some, solid[np.maximum(b - 1, 0)] + 1, w.end)
    return w


def simhash(g: np.ndarray) -> np.ndarray:
    """The fingerprint of each row of shingle hashes, every occurrence weighing one."""
    out = np.zeros(len(g), dtype=np.uint64)
    step = max(1, (1 << 17) // max(1, g.shape[1]))
    for a in range(0, len(g), step):
        bits = np.unpackbits(np.ascontiguousarray(g[a : a + step]).view(np.uint8).reshape(-1, g.shape[1], 8), axis=2, bitorder="little")
        out[a : a + step] = np.packbits(2 * bits.sum(axis=1, dtype=np.int64) > g.shape[1], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def weighted_similarity(a: Counter, b: Counter) -> float:
    shared = sum((a & b).values())
    return shared / (sum(a.values()) + sum(b.values()) - shared)


class MultiIndex:
    """Fingerprints by radius + 1 disjoint blocks of bits: any two within the radius agree on a block."""

    def __init__(self, fp: np.ndarray, radius: int):
        self.fp, self.radius = fp, radius
        edge = [64 * i // (radius + 1) for i in range(radius + 2)]
        self.blocks = [(np.uint64(a), np.uint64((1 << (b - a)) - 1)) for a, b in zip(edge[:-1], edge[1:], strict=True)]
        self.tables = []
        for shift, mask in self.blocks:
            value = fp >> shift & mask
            order = np.argsort(value, kind="stable")
            self.tables.append((value[order], order))

    def near(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of ``fp``, indexed row) of all pairs within the radius."""
        pairs = []
        for (shift, mask), (value, order) in zip(self.blocks, self.tables, strict=True):
            own = fp >> shift & mask
            a, b = np.searchsorted(value, own), np.searchsorted(value, own, side="right")
            n = b - a
            q = np.repeat(np.arange(len(fp)), n)
            pairs.append(q * len(self.fp) + order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)])
        key = np.unique(np.concatenate(pairs))
        q, i = key // len(self.fp), key % len(self.fp)
        ok = np.bitwise_count(fp[q] ^ self.fp[i]) <= self.radius
        return q[ok], i[ok]


class Benchmark:
    """The items of one block, indexed by length and fingerprint."""

    def __init__(self, items: list[tuple[int, str]], radius: int = RADIUS, similarity: float = SIMILARITY, shingle: int = SHINGLE):
        self.radius, self.similarity, self.shingle = radius, similarity, shingle
        w = normal_words(pa.array([t for _, t in items], pa.string()))
        h = w.hashes()
        by: dict[int, list[int]] = defaultdict(list)
        for i, n in enumerate(w.count.tolist()):
            if n:
                by[n].append(i)
        self.lengths = {}
        for n, rows in by.items():
            k = min(shingle, n)
            g = np.stack([textscan.grams(h[w.first[i] : w.first[i] + n], k) for i in rows])
            self.lengths[n] = (k, [items[i][0] for i in rows], [Counter(r) for r in g.tolist()], MultiIndex(simhash(g), radius), np.unique(g))

    def matches(self, column: pa.Array) -> list[tuple[int, int, int, int, float]]:
        """(row, item_id, start, words, similarity): the best window of each text for each item it holds."""
        w = normal_words(column)
        h = w.hashes()
        grams = {k: textscan.grams(h, k) for k in {v[0] for v in self.lengths.values()}}
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        known = {}
        for k, g in grams.items():  # shingles of any item; windows without one have similarity zero
            every = np.unique(np.concatenate([v[4] for v in self.lengths.values() if v[0] == k]))
            low = np.zeros(1 << 20, dtype=bool)
            low[(every & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            at = np.flatnonzero(low[(g & np.uint64((1 << 20) - 1)).astype(np.int64)])
            at = at[every[np.minimum(np.searchsorted(every, g[at]), len(every) - 1)] == g[at]]
            known[k] = at
        for n, (k, ids, counters, index, shingles) in self.lengths.items():
            at, g = known[k], grams[k]
            at = at[shingles[np.minimum(np.searchsorted(shingles, g[at]), len(shingles) - 1)] == g[at]] if len(at) else at
            if not len(at):
                continue
            size = n - k + 1
            need = math.ceil(2 * size * self.similarity / (1 + self.similarity) - 1e-9)  # shingles that such a window shares
            start = np.unique((at[:, None] - np.arange(size - need + 1)[None, :]).ravel())
            start = start[(start >= 0) & (start + n <= len(h))]
            text = np.searchsorted(w.first, start, side="right") - 1
            inside = start + n <= w.first[text + 1]
            start, text = start[inside], text[inside]
            for a in range(0, len(start), 4096):
                s, t = start[a : a + 4096], text[a : a + 4096]
                windows = g[s[:, None] + np.arange(size)[None, :]]
                q, i = index.near(simhash(windows))
                for row, item in zip(q.tolist(), i.tolist(), strict=True):
                    sim = weighted_similarity(Counter(windows[row].tolist()), counters[item])
                    if sim >= self.similarity:
                        key = (int(t[row]), ids[item])
                        new = (-sim, int(s[row] - w.first[t[row]]), n)
                        if key not in best or new < best[key]:
                            best[key] = new
        return [(row, item, at, n, -sim) for (row, item), (sim, at, n) in sorted(best.items())]


def _blocks(benchmark: DataFrame) -> list[Benchmark]:
    """Yields the benchmark in blocks of about BLOCK_BYTES; null texts and ids take no part."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, math.ceil(total / BLOCK_BYTES))
    for b in range(count):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == b).collect()
        if rows:
            yield Benchmark(sorted((r[0], r[1]) for r in rows))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, n_words, similarity): for each document and each item that it holds the best window.

    A window has as many words as the item; it holds the item if the
    similarity of their 5-word shingles, counted with repeats, is 0.8 or more.
    One pass over the texts for each block of the benchmark and no shuffle:
    every task has the block's index, whose size BLOCK_BYTES bounds. Items of
    fewer than five words have one shingle; empty ones and null texts match
    nothing. Repeated documents are judged each.
    """
    ship(docs.sparkSession)
    schema = "doc_id long, item_id long, start long, n_words long, similarity double"
    out = docs.sparkSession.createDataFrame([], schema)
    for block in _blocks(benchmark):

        def run(batches, block=block):
            for part in textscan.runs(batches):
                rows = block.matches(part.column(1))
                if rows:
                    row, item, start, n, sim = (pa.array(c) for c in zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(row), item, start, n, sim.cast(pa.float64())], names=["doc_id", "item_id", "start", "n_words", "similarity"])

        found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
        out = out.union(found)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, unchanged."""
    ship(docs.sparkSession)
    at = docs.columns.index("text")
    schema = docs.schema
    for block in _blocks(benchmark):

        def run(batches, block=block):
            for part in textscan.runs(batches):
                clean = np.ones(part.num_rows, dtype=bool)
                clean[[r[0] for r in block.matches(part.column(at))]] = False
                yield part.filter(pa.array(clean))

        docs = docs.mapInArrow(run, schema)
    return docs

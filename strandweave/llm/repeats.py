"""Removal of word sequences that repeat across documents, by fixed-block anchors (operator 7).

For every window of so many words it is found whether an equal window starts
in a document with a smaller doc_id:

1. Texts are kept as compressed chunks in the shared checkpoint folder,
   partitioned by chunk, so that later steps join small results to them
   without shuffling text again.
2. Non-overlapping reference blocks and the rolling windows that probe them
   meet by hash range: every chunk sends its sorted, delta-coded hashes, each
   distinct one once however often the chunk holds it. Neighbours with equal
   hashes from two chunks, or from two documents of one chunk, are hits. A bit
   mask comes back.
3. A hit is extended by up to a block less one word to either side, to every
   window that holds it. Keys of these windows (64 bits and those that the
   range takes off) meet by range, each chunk sending only its least document
   for a window, and windows of later documents come back as marks.
4. Marked windows are merged into maximal repeats in their chunk.

Ranges are cells of about CELL_WORDS words. Tasks are as many as the session
has shuffle partitions and take their cells one at a time, in sorted order.
What a chunk sends a cell is one row; with more cells than a chunk has anchors
a row is one anchor, so what is shuffled stays in proportion to the words. A
passage that a third of all documents hold costs one entry a chunk, not one a
document, and no pairs of documents are formed.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.core.session import checkpoint_by, ship
from strandweave.llm import textscan

CHUNK_BYTES = 4 << 20
CELL_WORDS = 1 << 20  #: words whose anchors meet in one cell
_TYPES = ["u1", "<u4", "<u8", "<i8"]


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays as compressed byte planes: high bytes that are all alike cost next to nothing."""
    head = [len(arrays)]
    for a in arrays:
        head += [_TYPES.index(a.dtype.str.replace("|", "")), len(a)]
    planes = [np.ascontiguousarray(a.view("u1").reshape(len(a), -1).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=level).compress(np.array(head, "<i8").tobytes() + b"".join(planes))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "u1")
    n = int(raw[:8].view("<i8")[0])
    head, at, out = raw[8 : 8 + 16 * n].view("<i8"), 8 + 16 * n, []
    for kind, size in head.reshape(n, 2).tolist():
        wide = np.dtype(_TYPES[kind]).itemsize
        out.append(np.ascontiguousarray(raw[at : at + size * wide].reshape(wide, size).T).reshape(-1).view(_TYPES[kind]))
        at += size * wide
    return out


def chunked(docs: DataFrame) -> tuple[DataFrame, int]:
    """(chunk, n_words, blob) in the shared checkpoint folder, partitioned by chunk; and the number of words."""
    spark = docs.sparkSession
    ship(spark)

    def run(batches):
        made = 0
        for part in textscan.runs(batches, limit=CHUNK_BYTES):
            raw, off = textscan.text_bytes(part.column(1))
            ids = part.column(0)
            known = np.asarray(ids.is_valid()).astype("u1")
            blob = pack(ids.fill_null(0).to_numpy().astype("<i8"), known, off.astype("<i8"), raw, level=5)
            n = int(textscan.words(part.column(1)).first[-1])
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() << 24 | made]), pa.array([n]), pa.array([blob], pa.binary())], names=["chunk", "n_words", "blob"])
            made += 1

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "chunk long, n_words long, blob binary")
    table = checkpoint_by(rows, parts, "chunk")
    return table, table.agg(F.sum("n_words")).first()[0] or 0


@dataclass
class Chunk:
    ids: np.ndarray
    known: np.ndarray
    words: textscan.Words
    h: np.ndarray
    doc: np.ndarray  #: doc_id of each word
    usable: np.ndarray  #: words of documents with a doc_id

    @staticmethod
    def of(blob: bytes) -> Chunk:
        ids, known, off, raw = unpack(blob)
        texts = pa.LargeStringArray.from_buffers(len(ids), pa.py_buffer(off), pa.py_buffer(raw))
        w = textscan.words(texts)
        at = w.doc_of_word()
        return Chunk(ids, known.astype(bool), w, w.hashes(), ids[at], known.astype(bool)[at])

    def within(self, k: int) -> np.ndarray:
        """Whether the k words from each position lie in one document that has a doc_id."""
        n = max(0, len(self.h) - k + 1)
        return textscan.inner(self.words.first, k, len(self.h)) & self.usable[:n]

    def place(self) -> np.ndarray:
        """Each word's position in its document."""
        return np.arange(len(self.h)) - np.repeat(self.words.first[:-1], self.words.count)


@dataclass(frozen=True)
class BlockAnchors:
    """Every rolling window of ``size`` words probes; those at multiples of ``size`` in their document are reference blocks.

    A window of 2 * size - 1 words contains a whole reference block wherever
    it lies, so an equal window elsewhere has a probe that equals the block.
    """

    size: int = 7

    def find(self, c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.flatnonzero(c.within(self.size))
        return at, textscan.grams(c.h, self.size)[at], c.place()[at] % self.size == 0

    def slack(self, window: int) -> int:
        return window - self.size


def _route(key: np.ndarray, parts: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _heads(*columns: np.ndarray) -> np.ndarray:
    new = np.ones(len(columns[0]), dtype=bool)
    if len(new):
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return new


def _sorted_anchors(c: Chunk, anchors, parts: int):
    """Anchor positions by (part, 32-bit key) with their group numbers; and per group part, key, block flag, several documents."""
    at, g, block = anchors.find(c)
    key = _route(g, parts).astype(np.uint64) << np.uint64(32) | g & np.uint64(0xFFFFFFFF)
    order = np.argsort(key, kind="stable")
    key, at = key[order], at[order]
    new = _heads(key)
    group = np.cumsum(new) - 1
    head = np.flatnonzero(new)
    if not len(head):
        return at, group, np.zeros(0, np.int64), np.zeros(0, "<u4"), np.zeros(0, "u1")
    doc = c.doc[at]
    several = np.minimum.reduceat(doc, head) != np.maximum.reduceat(doc, head)
    blocks = np.maximum.reduceat(block[order].astype("u1"), head)
    return at, group, (key[head] >> np.uint64(32)).astype(np.int64), key[head].astype("<u4"), (blocks | several.astype("u1") << 1).astype("u1")


def _spans(part: np.ndarray):
    cut = np.flatnonzero(_heads(part))
    return zip(part[cut].tolist(), cut.tolist(), [*cut[1:].tolist(), len(part)], strict=True)


def _rows(names, types, rows):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def _by_part(batches, work):
    """``work(rows)`` for each part of batches sorted by part; rows are (part, kind, chunk, blob)."""
    held, part = [], None
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if row[0] != part and held:
                yield from work(held)
                held = []
            part = row[0]
            held.append(row)
    if held:
        yield from work(held)


_SENT = "part int, kind int, chunk long, blob binary"
_SENT_NAMES, _SENT_TYPES = ["part", "kind", "chunk", "blob"], [pa.int32(), pa.int32(), pa.int64(), pa.binary()]


def _meet(sent: DataFrame, parts: int, work) -> DataFrame:
    """``work`` on all blobs of each of ``parts`` cells; returns (chunk, blobs), the results of a chunk together."""
    tasks = min(parts, int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches):
        for rows in _by_part(batches, work):
            if rows:
                yield _rows(["chunk", "blob"], [pa.int64(), pa.binary()], rows)

    got = sent.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(run, "chunk long, blob binary")
    return got.groupBy("chunk").agg(F.collect_list("blob").alias("blobs"))


def _hits(rows):
    """Groups of equal neighbours that two chunks or two documents share and that hold a reference block; one bit mask a chunk."""
    own = [unpack(r[3]) for r in rows]
    size = [len(o[0]) for o in own]
    key = np.concatenate([np.cumsum(o[0], dtype="<u8").astype("<u4") for o in own])
    flag = np.concatenate([o[1] for o in own])
    order = np.argsort(key, kind="stable")
    new = _heads(key[order])
    head = np.flatnonzero(new)
    count = np.diff(np.r_[head, len(key)])
    flags = np.bitwise_or.reduceat(flag[order], head)
    hit = np.empty(len(key), dtype=bool)
    hit[order] = (((count > 1) | (flags & 2 > 0)) & (flags & 1 > 0))[np.cumsum(new) - 1]
    out, at = [], 0
    for r, n in zip(rows, size, strict=True):
        mine = hit[at : at + n]
        at += n
        if mine.any():
            out.append((r[2], pack(np.array([r[0]], "<i8"), np.packbits(mine))))
    yield out


def _later(rows):
    """Positions of windows that start in a smaller document too, a blob for each chunk."""
    passed = [(r[2], r[3]) for r in rows if r[1] == 1]
    if passed:
        yield passed
    rows = [r for r in rows if r[1] == 0]
    if not rows:
        return
    own = [unpack(r[3]) for r in rows]
    key = np.concatenate([np.cumsum(o[0], dtype="<u8") for o in own])
    doc = np.concatenate([o[1] for o in own])
    order = np.argsort(key, kind="stable")
    new = _heads(key[order])
    least = np.empty(len(key), dtype="<i8")
    least[order] = np.minimum.reduceat(doc[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    out, at = [], 0
    for r, o in zip(rows, own, strict=True):
        mine = slice(at, at + len(o[0]))
        at += len(o[0])
        late = doc[mine] > least[mine]
        if late.any():
            out.append((r[2], pack(o[2][late])))
    yield out


def marks(table: DataFrame, n_words: int, anchors: BlockAnchors, window: int) -> DataFrame:
    """(chunk, blobs): the windows of each chunk that also start in a document with a smaller doc_id, as packed word positions."""
    parts = max(8, math.ceil(n_words / CELL_WORDS))

    def probes(batches):
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                _, _, part, key, flag = _sorted_anchors(Chunk.of(blob), anchors, parts)
                rows = [(p, 0, chunk, pack(np.diff(key[a:b], prepend=np.uint32(0)).astype("<u4"), flag[a:b])) for p, a, b in _spans(part)]
                if rows:
                    yield _rows(_SENT_NAMES, _SENT_TYPES, rows)

    def windows(batches):
        for batch in batches:
            for chunk, blob, masks in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                c = Chunk.of(blob)
                at, group, part, _, _ = _sorted_anchors(c, anchors, parts)
                hit = np.zeros(len(part), dtype=bool)
                for m in masks:
                    p, bits = unpack(m)
                    a, b = np.searchsorted(part, p[0]), np.searchsorted(part, p[0], side="right")
                    hit[a:b] = np.unpackbits(bits)[: b - a]
                total = np.zeros(len(c.h) + 1, dtype=np.int64)
                total[at[hit[group]] + 1] = 1
                np.cumsum(total, out=total)
                ok = c.within(window)
                start = np.arange(len(ok))
                where = np.flatnonzero(ok & (total[np.minimum(start + anchors.slack(window) + 1, len(c.h))] > total[start]))
                if not len(where):
                    continue
                g, more = textscan.grams(c.h, window)[where], textscan.grams(c.h, window, 1)[where]
                part, key, doc = _route(g, parts), g << np.uint64(32) | more & np.uint64(0xFFFFFFFF), c.doc[where]
                order = np.lexsort((where, doc, key, part))
                part, key, doc, where = part[order], key[order], doc[order], where[order]
                new = _heads(part, key)
                late = doc > doc[new][np.cumsum(new) - 1]
                rows = [(chunk % parts, 1, chunk, pack(where[late].astype("<u4")))] if late.any() else []
                part, key, doc, where = part[~late], key[~late], doc[~late], where[~late]
                rows += [(p, 0, chunk, pack(np.diff(key[a:b], prepend=np.uint64(0)).astype("<u8"), doc[a:b].astype("<i8"), where[a:b].astype("<u4"))) for p, a, b in _spans(part)]
                yield _rows(_SENT_NAMES, _SENT_TYPES, rows)

    masks = _meet(table.select("chunk", "blob").mapInArrow(probes, _SENT), parts, _hits)
    sent = table.join(masks, "chunk").select("chunk", "blob", "blobs").mapInArrow(windows, _SENT)
    return _meet(sent, parts, _later)


def _marked(blobs) -> np.ndarray:
    return np.concatenate([*(unpack(b)[0].astype(np.int64) for b in blobs or ()), np.zeros(0, np.int64)])


def without_repeats(docs: DataFrame, window: int = 13) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept): every document after removal of repeated words.

    A word goes if a window of ``window`` words that covers it also starts in
    a document with a smaller doc_id; windows are judged on the input. ``kept``
    is the words left, joined by one space. Null texts have no words. Rows
    without doc_id take no part and keep every word; rows that repeat a doc_id
    do not remove each other's words.
    """
    if window % 2 == 0:
        raise ValueError("the window must be odd, twice a block less one")
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]

    def run(batches):
        for batch in batches:
            for blob, blobs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                c = Chunk.of(blob)
                at = _marked(blobs)
                cover = np.zeros(len(c.h) + 1, dtype=np.int64)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + window, -1)
                keep = np.cumsum(cover[:-1]) == 0
                start, length = c.words.start[keep], (c.words.end - c.words.start)[keep]
                upto = np.concatenate([[0], np.cumsum(length + 1)])
                joined = np.full(upto[-1], 0x20, dtype="u1")
                inside = np.arange(length.sum()) + np.repeat(np.arange(len(length)), length)
                joined[inside] = c.words.raw[np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(start, length)]
                first = np.concatenate([[0], np.cumsum(keep)])[c.words.first]
                data = joined.tobytes()
                kept = [data[a : max(a, b - 1)] for a, b in zip(upto[first[:-1]].tolist(), upto[first[1:]].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(c.ids, pa.int64(), mask=~c.known), pa.array(c.words.count), pa.array(c.words.count - np.diff(first)),
                        pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array([k.decode() for k in kept], pa.string()),
                    ],
                    names=names,
                )

    table, n_words = chunked(docs)
    found = marks(table, n_words, BlockAnchors((window + 1) // 2), window)
    rows = table.join(found, "chunk", "left").select("blob", "blobs")
    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")

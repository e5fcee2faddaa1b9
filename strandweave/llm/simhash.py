"""SimHash near-duplicate groups with bit-sliced comparison (operator 9)."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.core.session import checkpoint, ship
from strandweave.llm import textscan
from strandweave.llm.graph import components, local_roots

SEED = 42
BITS = 64
TILE = 4096  #: fingerprints of one bucket that one comparison task holds
SLAB = 1 << 15  #: (query, word of 64 candidates) blocks compared at once
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


# --- fingerprints -----------------------------------------------------------


def shingle_hashes(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of each text's lower-cased k-word shingles, and each text's first shingle."""
    w = textscan.words(column, lower=True)
    length = w.end - w.start
    start = np.concatenate([[0], np.cumsum(length + 1)]).astype(np.int64)
    joined = np.full(int(start[-1]), 0x20, dtype=np.uint8)
    inside = int(length.sum())
    joined[np.arange(inside) + np.repeat(np.arange(len(length)), length)] = w.raw[~textscan.IS_SPACE[w.raw]]
    text, end = joined.tobytes(), start[:-1] + length
    count = w.count
    shingles = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    first = np.concatenate([[0], np.cumsum(shingles)])
    at = np.arange(first[-1]) + np.repeat(w.first[:-1] - first[:-1], shingles)
    to = at + np.repeat(np.minimum(k, count), shingles) - 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(text[a:b], SEED) for a, b in zip(start[at].tolist(), end[to].tolist(), strict=True)), np.uint64, len(at))
    return h, first


def majority(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text the bits set in over half of its hashes; zero without any."""
    out = np.zeros(len(first) - 1, dtype=np.uint64)
    full = np.flatnonzero(np.diff(first) > 0)
    if not len(full):
        return out
    step = 1 << 16
    counts = np.zeros((len(full), BITS), dtype=np.int64)
    text_of = np.repeat(np.arange(len(full)), np.diff(first)[full])
    for a in range(0, len(h), step):
        bits = np.unpackbits(h[a : a + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        here = text_of[a : a + step]
        cut = np.flatnonzero(np.r_[True, here[1:] != here[:-1]])
        counts[here[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int64)
    set_ = 2 * counts > np.diff(first)[full][:, None]
    out[full] = np.packbits(set_, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprints(docs: DataFrame, k: int = 4) -> DataFrame:
    """(doc_id, fp bigint) of every document, in one pass over the texts without a shuffle."""
    ship(docs.sparkSession)

    def run(batches):
        for part in textscan.runs(batches):
            fp = majority(*shingle_hashes(part.column(1), k))
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


# --- bit-sliced comparison --------------------------------------------------


def _planes(fp: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Vertical bit planes of sorted groups: (64, words), each group's first word, members of the lanes, and words a group."""
    size = np.bincount(group)
    words = (size + 63) // 64
    base = np.concatenate([[0], np.cumsum(words)])
    lane = np.arange(len(fp)) - np.repeat(np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.repeat(base[:-1] * 64, size)
    member = np.full(base[-1] * 64, -1, dtype=np.int64)
    member[lane] = np.arange(len(fp))
    bits = np.zeros((base[-1] * 64, 64), dtype=np.uint8)
    bits[lane] = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    planes = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)
    return planes, base, member, words


class _Counter:
    """Many saturating counters side by side, one bit of each in a word: carry-save addition of bit planes."""

    def __init__(self, n: int, radius: int):
        self.level = [np.zeros(n, np.uint64) for _ in range(max(1, int(radius + 1).bit_length()))]
        self.over = np.zeros(n, np.uint64)
        self.radius = radius

    def add(self, x: np.ndarray, at: int = 0) -> None:
        for i in range(at, len(self.level)):
            carry = self.level[i] & x
            self.level[i] ^= x
            x = carry
        self.over |= x

    def add3(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> None:
        """A full adder first: three planes of weight one become one of weight one and one of weight two."""
        t = a ^ b
        self.add(t ^ c)
        self.add((a & b) | (t & c), 1)

    def beyond(self) -> np.ndarray:
        """Bits of the counters that are over the radius."""
        more, same = np.zeros_like(self.over), np.full_like(self.over, _FULL)
        for i in reversed(range(len(self.level))):
            if self.radius >> i & 1:
                same &= self.level[i]
            else:
                more |= same & self.level[i]
                same &= ~self.level[i]
        return self.over | more

    def keep(self, at: np.ndarray) -> None:
        self.level = [x[at] for x in self.level]
        self.over = self.over[at]


def close_pairs(fp: np.ndarray, group: np.ndarray, radius: int, asks: np.ndarray | None = None):
    """Yields (i, j) index arrays of all pairs i < j in one group at most ``radius`` bits apart; with ``asks`` only those whose i asks.

    ``group`` is non-decreasing from 0. A block is one query against a word of
    64 candidates; planes are added until every lane of a block is over the
    radius, and such blocks are abandoned.
    """
    if not len(fp):
        return
    planes, base, member, words = _planes(fp, group)
    flip = np.where(np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool), _FULL, np.uint64(0)).T.copy()
    own_word = np.searchsorted(member.reshape(-1, 64).max(axis=1), np.arange(len(fp)))  # only words from a query's own on
    todo = base[group + 1] - own_word
    if asks is not None:
        todo = np.where(asks, todo, 0)
    ends = np.cumsum(todo)
    at = 0
    while at < len(fp):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLAB, side="right")))
        n = todo[at:to]
        q = np.repeat(np.arange(at, to), n)
        w = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(own_word[at:to], n)
        count = _Counter(len(q), radius)
        for p in range(0, 63, 3):
            count.add3(*(planes[p + i][w] ^ flip[p + i][q] for i in range(3)))
            if p in (12, 18, 24, 33, 45):
                live = np.flatnonzero(count.beyond() != _FULL)
                if len(live) < 0.8 * len(q):
                    q, w = q[live], w[live]
                    count.keep(live)
                    if not len(q):
                        break
        if len(q):
            count.add(planes[63][w] ^ flip[63][q])
            hit = ~count.beyond()
            block = np.flatnonzero(hit)
            lanes = np.unpackbits(hit[block].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            b, lane = np.nonzero(lanes)
            i, j = q[block[b]], member[w[block[b]] * 64 + lane]
            ok = j > i
            yield i[ok], j[ok]
        at = to


# --- groups -----------------------------------------------------------------


def block_tables(distinct: int, radius: int) -> list[list[tuple[int, int]]]:
    """Tables of (shift, width) blocks such that any two values within ``radius`` agree on all blocks of one table.

    With m blocks at least m - radius agree. m is the least for which an even
    spread puts at most TILE values in a bucket, so that work a value stays
    bounded at every size; the pairs found are the same for every m.
    """
    m = radius + 1
    while m < 16 and distinct / 2 ** (BITS * (m - radius) // m) > TILE:
        m += 1
    edge = [BITS * i // m for i in range(m + 1)]
    blocks = [(edge[i], edge[i + 1] - edge[i]) for i in range(m)]
    return [list(c) for c in combinations(blocks, m - radius)]


def _key(blocks: list[tuple[int, int]]):
    mask = 0
    for shift, width in blocks:
        mask |= ((1 << width) - 1) << shift
    return F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long"))


def bucketed(nodes: DataFrame, tables: list[list[tuple[int, int]]]) -> DataFrame:
    """Each node in its bucket of each table; buckets of over TILE nodes are split into pairs of tiles."""
    keys = nodes.select(
        "fp", "rep", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), _key(b).alias("key")) for t, b in enumerate(tables)])).alias("b")
    ).select("fp", "rep", "b.t", "b.key")
    hot = keys.groupBy("t", "key").count().where(F.col("count") > TILE).select("t", "key", F.ceil(F.col("count") / (TILE // 2)).cast("int").alias("tiles"))
    tile = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    pairs = F.when(F.col("tiles").isNull(), F.array(F.lit(0))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda j: F.least(tile, j) * 1_000_000 + F.greatest(tile, j))
    )
    return keys.join(hot, ["t", "key"], "left").select("t", "key", "fp", "rep", F.explode(pairs).alias("tile"))


def _numpy(column) -> np.ndarray:
    """A column as an array; binary values as objects."""
    return np.array(column.to_pylist(), dtype=object) if pa.types.is_binary(column.type) else column.to_numpy()


def bucket_runs(batches, columns: int, by: int = 3):
    """Whole buckets, equal in the first ``by`` columns, from sorted batches, many small ones together; yields numpy columns and bucket numbers."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def give(table, upto):
        cols = [_numpy(table.column(c).slice(0, upto)) for c in range(columns)]
        new = np.zeros(upto, dtype=bool)
        for c in cols[:by]:
            new[1:] |= c[1:] != c[:-1]
        return cols, np.cumsum(new)

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < 2 * TILE:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        last = np.zeros(rows, dtype=bool)
        for c in range(by):
            x = table.column(c).to_numpy()
            last |= x != x[-1]
        cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
        if cut:
            yield give(table, cut)
        held = table.slice(cut).to_batches()
        rows -= cut
    if rows:
        table = pa.Table.from_batches(held).combine_chunks()
        yield give(table, rows)
    textscan.release()


def links(nodes: DataFrame, radius: int, distinct: int) -> DataFrame:
    """Edges (a, b) over ``rep`` that connect all nodes (fp, rep) whose fingerprints are within ``radius``.

    Within a bucket only a star for each local component is returned, at most
    one edge a node, however many pairs are close.
    """
    ship(nodes.sparkSession)

    def run(batches):
        for (_, _, _, fp, rep), bucket in bucket_runs(batches, 5):
            root = local_roots(len(fp), close_pairs(np.ascontiguousarray(fp).view(np.uint64), bucket, radius))
            moved = np.flatnonzero(root != np.arange(len(root)))
            if len(moved):
                yield pa.RecordBatch.from_arrays([pa.array(rep[moved]), pa.array(rep[root[moved]])], names=["a", "b"])

    keys = bucketed(nodes, block_tables(distinct, radius)).select("t", "key", "tile", "fp", "rep")
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keys.repartition(parts, "t", "key", "tile").sortWithinPartitions("t", "key", "tile").mapInArrow(run, "a long, b long")


def groups(docs: DataFrame, k: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id): documents linked by chains of fingerprints within ``radius`` bits.

    Equal fingerprints collapse into one node before any comparison, so a group
    of copies of any size costs one. Null and empty texts have fingerprint zero
    and are linked like any other; a row without doc_id gets the group of its
    fingerprint but links nothing itself. Repeated rows stay repeated.
    """
    marks = checkpoint(fingerprints(docs, k))
    nodes = checkpoint(marks.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    linked = components(links(nodes, radius, nodes.count()))
    label = nodes.join(linked, nodes["rep"] == linked["id"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return marks.join(label, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

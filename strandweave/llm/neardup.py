"""Near-duplicate documents by their five-word shingles: operator 9's bit-sliced comparison inside buckets that hold every similar pair.

All shingle sets are sorted in one order, shingles that many documents hold
last. Two sets of sizes x and y that are similar enough share so many that the
least one they share is among the first x - ceil(0.8 x) + 1 of either, so they
meet in the bucket of that shingle, at any size of the input. Within a bucket
64-bit fingerprints are compared bit-sliced, sets' sizes and places bound what
two can share, parity sketches rule out more, and whole sets decide.

Pairs are found in two rounds, so that a large group of near copies costs no
square: first every document proposes its neighbour by fingerprint and the
middle document of each of its buckets, and what proves similar is joined; then
all pairs of documents that are not joined yet are looked at.

RADIUS is set so that a pair at the least similarity is beyond it with a chance
of 1e-8 (differing bits are binomial, with 9.7 of 64 expected).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.core.session import bounded, checkpoint, checkpoint_by, ship
from strandweave.llm import simhash, textscan
from strandweave.llm.graph import components

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 28
SAMPLE, COMMON, LISTED = 8, 4, 500_000  #: texts sampled one in SAMPLE; shingles in COMMON of them or more come last in the order, LISTED at most
TILE = 2048  #: expected documents of a common shingle's bucket that one comparison holds from either side
SLAB = 1 << 17  #: bucket entries made at once
HELD = 1_000_000  #: most rows of ids that are broadcast
_SLACK = 1e-9  #: against rounding of similarity * size
FOLD = 512  #: bits of the sketch that pairs of one bucket are held against
_CUT = np.uint64(16)  #: bits of a shingle's hash that its bucket leaves out


def _sets(column: pa.Array, k: int = SHINGLE) -> list[np.ndarray]:
    """Each text's sorted 64-bit hashes of its distinct lower-cased k-word shingles, or of all its words if fewer."""
    w = textscan.words(column, lower=True)
    h = w.hashes()
    g = textscan.grams(h, k)
    spans = zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)
    return [np.unique(g[a : b - k + 1] if b - a >= k else textscan.grams(h[a:b], b - a) if b > a else g[:0]) for a, b in spans]


def _prefix(x: np.ndarray, common: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """The first shingles of a sorted set, common ones last: as many as must hold the least one shared with any similar set."""
    if len(common):
        late = np.isin(x, common, assume_unique=True)
        x = np.concatenate([x[~late], x[late]])
    return x[: len(x) - int(np.ceil(similarity * len(x) - _SLACK)) + 1]


def common_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many of a sample of texts(t, text) hold, sorted, and about how many texts hold them.

    They only set the order of the shingles and how buckets are split, so the
    pairs found do not depend on the sample.
    """

    def run(batches):
        for part in textscan.runs(batches):
            x = np.concatenate([*_sets(part.column(0)), np.zeros(0, np.uint64)])
            key, n = np.unique(x, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n, pa.int64())], names=["key", "n"])

    sample = texts.where(F.pmod("t", F.lit(SAMPLE)) == 0).select("text")
    found = sample.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON)
    rows = found.orderBy(F.col("n").desc(), "key").limit(LISTED).toPandas()
    key, n = rows["key"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64)
    order = np.argsort(key)
    return key[order], n[order] * SAMPLE


def _sketch(x: np.ndarray, bits: int = 0) -> bytes:
    """The parities of a set's members in two cells a member or more, or in ``bits``; two sets differ in as many members or more as their sketches in bits."""
    bits = bits or max(64, 1 << int(2 * len(x)).bit_length())
    return np.packbits((np.bincount((x & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def _differ(x: bytes, y: bytes) -> int:
    """The bits in which two sketches differ, the longer one folded onto the other."""
    short, long = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    return int(np.bitwise_count(np.bitwise_xor.reduce(long.reshape(-1, len(short)), axis=0) ^ short).sum())


def nodes_of(texts: DataFrame, common: np.ndarray) -> DataFrame:
    """(t, n, fp, prefix, sketch, fold) of texts(t, text): a set's size, SimHash, bucket keys and parities, in many bits and in FOLD; texts without words have no row."""

    def run(batches):
        for part in textscan.runs(batches):
            sets = _sets(part.column(1))
            n = np.array([len(x) for x in sets], dtype=np.int64)
            fp = simhash.majority(np.concatenate([*sets, np.zeros(0, np.uint64)]), np.concatenate([[0], np.cumsum(n)]))
            some = np.flatnonzero(n)
            prefix = [np.ascontiguousarray((_prefix(sets[i], common) >> _CUT).view(np.uint8).reshape(-1, 8)[:, :6]).tobytes() for i in some]
            cols = [pa.array(n[some]), pa.array(fp.view(np.int64)[some]), pa.array(prefix, pa.binary()), *(pa.array([_sketch(sets[i], b) for i in some], pa.binary()) for b in (0, FOLD))]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(some)), *cols], names=["t", "n", "fp", "prefix", "sketch", "fold"])

    return texts.select("t", "text").mapInArrow(run, "t long, n long, fp long, prefix binary, sketch binary, fold binary")


def _keys(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(np.int64).ravel()


_ENTRY = ["key", "tile", "t", "at", "fp"]


def entries(nodes: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(key, tile, t, at, fp): each node in the bucket of each key of its prefix; ``at`` has the set's size and the key's place.

    Buckets of common shingles are dealt over tiles, differently for each key.
    """
    listed, tiles_of = common[0] >> _CUT, np.maximum(1, -(-common[1] // TILE))

    def run(batches):
        for batch in batches:
            ends = np.cumsum(pa.compute.binary_length(batch.column(3)).to_numpy() // 6)
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SLAB, side="right")))
                part, width = batch.slice(a, b - a), np.diff(ends[a:b], prepend=ends[a - 1] if a else 0)
                a = b
                key = _keys(b"".join(part.column(3).to_pylist()))
                t, fp = (np.repeat(part.column(c).to_numpy(), width) for c in (0, 2))
                at = np.repeat(part.column(1).to_numpy() << 32, width) | np.arange(len(key)) - np.repeat(np.cumsum(width) - width, width)
                tile = np.full(len(key), -1, dtype=np.int64)
                if len(listed) and len(key):
                    place = np.minimum(np.searchsorted(listed, key.view(np.uint64)), len(listed) - 1)
                    split = (listed[place] == key.view(np.uint64)) & (tiles_of[place] > 1)
                    tile[split] = (textscan.mix(t[split].view(np.uint64) ^ key[split].view(np.uint64)) % tiles_of[place[split]].astype(np.uint64)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (key, tile, t, at, fp)], names=_ENTRY)

    return nodes.select("t", "n", "fp", "prefix").mapInArrow(run, "key long, tile long, t long, at long, fp long")


def _may(at: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the sets of entries i and j can be similar if they share no lesser shingle than their bucket's."""
    x, y = at[i] >> 32, at[j] >> 32
    shared = np.minimum(x - (at[i] & 0xFFFFFFFF), y - (at[j] & 0xFFFFFFFF))
    return (shared >= similarity / (1 + similarity) * (x + y) - _SLACK) & (np.minimum(x, y) >= similarity * np.maximum(x, y) - _SLACK)


def _buckets(rows: DataFrame, order: list[str], run, schema: str) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "key", "tile").sortWithinPartitions("key", "tile", *order).mapInArrow(run, schema)


def proposals(met: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The entries that have company in their bucket, with ``near`` and ``hub``: the next node by fingerprint and the bucket's middle, where similar ones are possible.

    The middle is the node nearest to the bits that most of the bucket have: of
    copies of one text with edits of their own that is the text itself.
    """

    def run(batches):
        for (key, tile, t, at, fp), bucket in simhash.bucket_runs(batches, 5, 2):
            once = np.ones(len(t), dtype=bool)
            once[1:] = (bucket[1:] != bucket[:-1]) | (t[1:] != t[:-1])
            key, tile, t, at, fp, bucket = (c[once] for c in (key, tile, t, at, fp, bucket))
            head = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1])
            size = np.diff(np.append(head, len(t)))
            of, wide = np.repeat(np.arange(len(head)), size), np.repeat(size, size)
            bits = np.ascontiguousarray(fp).view(np.uint64)
            votes = np.add.reduceat(np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), head, axis=0, dtype=np.int32)
            most = np.packbits(2 * votes > size[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
            first = np.lexsort((np.bitwise_count(bits ^ most[of]), of))[head][of]
            close = lambda i, j: _may(at, i, j, similarity) & (np.bitwise_count(bits[i] ^ bits[j]) <= RADIUS)  # noqa: E731, B023
            here = np.arange(len(t))
            hub = np.where((here != first) & close(here, first), first, -1)
            ranked = np.lexsort((bits, bucket))
            a, b = ranked[1:], ranked[:-1]
            near = np.full(len(t), -1, dtype=np.int64)
            near[a] = np.where((bucket[a] == bucket[b]) & (first[a] != b) & close(a, b), b, -1)
            keep = np.flatnonzero((wide > 1) | (tile >= 0))
            mate = [pa.array(t[x[keep]], mask=x[keep] < 0) for x in (near, hub)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c[keep]) for c in (key, tile, t, at, fp)), *mate], names=[*_ENTRY, "near", "hub"])

    return _buckets(met, ["t"], run, "key long, tile long, t long, at long, fp long, near long, hub long")


def _spread(common: tuple[np.ndarray, np.ndarray]):
    """Entries of split buckets once for each pair of tiles that theirs is in."""
    listed, tiles_of = (common[0] >> _CUT).view(np.int64), np.maximum(1, -(-common[1] // TILE))

    def run(batches):
        for batch in batches:
            tile = batch.column(1).to_numpy()
            tiles = np.ones(len(tile), dtype=np.int64)
            split = tile >= 0
            tiles[split] = tiles_of[np.searchsorted(listed, batch.column(0).to_numpy()[split])]
            ends = np.cumsum(tiles)
            a = 0
            while a < len(tile):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SLAB, side="right")))
                row = np.repeat(np.arange(a, b), tiles[a:b])
                other = np.arange(len(row)) - np.repeat(np.cumsum(tiles[a:b]) - tiles[a:b], tiles[a:b])
                pair = np.where(split[row], np.minimum(tile[row], other) << 24 | np.maximum(tile[row], other), -1)
                cols = [c.take(pa.array(row)) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([cols[0], pa.array(pair), *cols[2:]], names=batch.schema.names)
                a = b

    return run


def _most_apart(total: np.ndarray, similarity: float) -> np.ndarray:
    """In how many members two similar sets may differ, by the sum of their sizes."""
    return total - 2 * np.ceil(similarity / (1 + similarity) * total - _SLACK)


def crossing(found: DataFrame, comps: DataFrame, nodes: DataFrame, common: tuple[np.ndarray, np.ndarray], similarity: float = SIMILARITY) -> DataFrame:
    """Pairs (a, b), a > b, of entries in one bucket that are in different components and can be similar by size, place, fingerprint and sketch.

    Split buckets whose nodes are all of one component are left out before
    their entries are dealt to pairs of tiles; there are LISTED keys at most.
    """
    label = F.coalesce("component", "t").alias("comp")
    rows = found.join(comps.withColumnRenamed("id", "t"), "t", "left").select(*_ENTRY, label)
    several = checkpoint(rows.groupBy("key", "tile").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi or tile >= 0").select("key", "tile"))
    rows = rows.join(several, ["key", "tile"], "left_semi").join(nodes.select("t", "fold").distinct(), "t").select(*_ENTRY, "comp", "fold")
    mixed = rows.where("tile >= 0").groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    rows = rows.where("tile < 0").unionByName(rows.where("tile >= 0").join(F.broadcast(mixed), "key", "left_semi").select(*_ENTRY, "comp", "fold"))

    def run(batches):
        for (_, _, comp, t, at, fp, fold), bucket in simhash.bucket_runs(batches, 7, 2):
            head = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1])
            size = np.diff(np.append(head, len(t)))
            mixed = np.flatnonzero(np.repeat(comp[head] != comp[np.append(head[1:], len(t)) - 1], size))
            if not len(mixed):
                continue
            comp, t, at, fp, fold, bucket = (c[mixed] for c in (comp, t, at, fp, fold, bucket))
            # the largest component of each bucket comes last and doesn't ask
            new = np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (comp[1:] != comp[:-1])])
            held = np.diff(np.append(np.flatnonzero(new), len(t)))[np.cumsum(new) - 1]
            order = np.lexsort((comp, held, bucket))
            comp, t, at, fp, fold, bucket = (c[order] for c in (comp, t, at, fp, fold, bucket))
            folds = np.frombuffer(b"".join(fold), np.uint64).reshape(len(t), -1)
            last = np.append(bucket[1:] != bucket[:-1], True)
            group = np.cumsum(np.concatenate([[0], last[:-1]]))
            asks = comp != comp[np.flatnonzero(last)][group]
            pairs = []
            for i, j in simhash.close_pairs(np.ascontiguousarray(fp).view(np.uint64), group, RADIUS, asks):
                ok = (comp[i] != comp[j]) & _may(at, i, j, similarity)
                i, j = i[ok], j[ok]
                ok = np.ones(len(i), dtype=bool)
                for a in range(0, len(i), SLAB):
                    x, y = i[a : a + SLAB], j[a : a + SLAB]
                    ok[a : a + SLAB] = np.bitwise_count(folds[x] ^ folds[y]).sum(axis=1) <= _most_apart((at[x] >> 32) + (at[y] >> 32), similarity)
                i, j = i[ok], j[ok]
                pairs.append(np.stack([np.maximum(t[i], t[j]), np.minimum(t[i], t[j])], axis=1))
                if sum(map(len, pairs)) > SLAB:
                    pairs = [np.unique(np.concatenate(pairs), axis=0)]
                    if len(pairs[0]) > SLAB // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(pairs[0][:, 0]), pa.array(pairs[0][:, 1])], names=["a", "b"])
                        pairs = []
            pairs = np.unique(np.concatenate([*pairs, np.zeros((0, 2), np.int64)]), axis=0)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    spread = rows.select("key", "tile", "comp", "t", "at", "fp", "fold").mapInArrow(_spread(common), "key long, tile long, comp long, t long, at long, fp long, fold binary")
    return _buckets(spread, ["comp", "t"], run, "a long, b long").distinct()


def possible(pairs: DataFrame, nodes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs but for those whose sketches differ in more bits than similar sets of their sizes can; ``nodes`` has (t, n, sketch)."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            total = batch.column(2).to_numpy() + batch.column(4).to_numpy()
            off = np.array([_differ(x, y) for x, y in zip(batch.column(3).to_pylist(), batch.column(5).to_pylist(), strict=True)])
            keep = off <= _most_apart(total, similarity)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    side = lambda c: nodes.select(F.col("t").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "s_a", "n_b", "s_b")
    return both.mapInArrow(run, "a long, b long").distinct()


def _packed(x: np.ndarray) -> bytes:
    """The upper 48 bits of a sorted set of hashes."""
    return np.ascontiguousarray((x >> _CUT).view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs whose shingle sets have at least that Jaccard similarity.

    Only texts of pairs that their sketches allow are read for their sets, and
    a set meets its partners' one at a time, however many there are.
    """
    pairs = checkpoint(possible(pairs, nodes, similarity))
    wanted = checkpoint(pairs.select(F.col("a").alias("t")).union(pairs.select(F.col("b").alias("t"))).distinct())

    def sets(batches):
        for part in textscan.runs(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([_packed(x) for x in _sets(part.column(1))], pa.binary())], names=["t", "x"])

    def run(batches):
        own, x = None, np.zeros(0, np.int64)
        for batch in batches:
            hit = ([], [])
            for a, b, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b is None:
                    own, x = a, _keys(data)
                    continue
                y = _keys(data)
                if own != a or not len(x) or min(len(x), len(y)) < similarity * max(len(x), len(y)) - _SLACK:
                    continue
                both = len(np.intersect1d(x, y))
                if both >= similarity * (len(x) + len(y) - both) - _SLACK:
                    hit[0].append(a)
                    hit[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in hit], names=["a", "b"])

    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    read = texts.join(bounded(wanted, HELD), "t", "left_semi").select("t", "text").mapInArrow(sets, "t long, x binary")
    held = checkpoint_by(read, parts, "t")
    asked = pairs.join(held.select(F.col("t").alias("b"), "x"), "b").select("a", "b", "x")
    own = held.join(pairs.select(F.col("a").alias("t")).distinct(), "t", "left_semi").select(F.col("t").alias("a"), F.lit(None).cast("long").alias("b"), "x")
    return own.unionByName(asked).repartition(parts, "a").sortWithinPartitions("a", F.col("b").asc_nulls_first()).mapInArrow(run, "a long, b long")


def labels(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, t, component_id, stays) of every row with a doc_id; ``t`` is the text's hash.

    Rows with equal texts and rows linked by chains of similar ones have one
    component, named by its least doc_id. Of each component stay the rows of
    one document: the least doc_id, with the least ``t`` should it have several
    texts. Texts are told apart by 64-bit hashes. Texts without words (null
    ones too, which count as empty) are similar to equal ones only.
    """
    ship(docs.sparkSession)
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"), "text")
    ids = rows.select("doc_id", "t")
    held = checkpoint(ids.groupBy("t").agg(F.min("doc_id").alias("first")))
    copies = checkpoint(ids.join(held, "t").where("doc_id <> first").select("doc_id", "t").distinct())
    texts = rows.join(bounded(copies, HELD), ["doc_id", "t"], "left_anti").select("t", "text")
    common = common_shingles(texts)
    nodes = checkpoint(nodes_of(texts, common[0]))
    found = checkpoint(proposals(entries(nodes, common), similarity))
    pairs = found.select("t", F.explode(F.array("near", "hub")).alias("m")).where("m is not null")
    links = checkpoint(verified(pairs.select(F.greatest("t", "m").alias("a"), F.least("t", "m").alias("b")).distinct(), nodes, texts, similarity))
    more = verified(crossing(found, components(links), nodes, common, similarity), nodes, texts, similarity)
    joined = components(links.unionByName(more)).withColumnRenamed("id", "t")
    known = held.join(joined, "t", "left").select("t", "first", F.coalesce("component", "t").alias("component"))
    least = known.groupBy("component").agg(F.min(F.struct("first", "t")).alias("least"))
    known = checkpoint(known.join(least, "component").select("t", F.col("least.first").alias("component_id"), (F.col("t") == F.col("least.t")).alias("own")))
    return ids.join(known, "t").select("doc_id", "t", "component_id", (F.col("own") & (F.col("doc_id") == F.col("component_id"))).alias("stays"))


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id) of every row with a doc_id, in a group or alone: see ``labels``."""
    return labels(docs).select("doc_id", "component_id")


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents, one of each group of copies and near copies, as they are.

    Rows without doc_id stay. A row repeated as it is counts as one document
    and stays as often as it came.
    """
    gone = checkpoint(labels(docs).where(~F.col("stays")).select(F.col("doc_id").alias("__doc"), F.col("t").alias("__t")).distinct())
    on = (docs["doc_id"].cast("long") == F.col("__doc")) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col("__t"))
    return docs.join(bounded(gone, HELD), on, "left_anti")

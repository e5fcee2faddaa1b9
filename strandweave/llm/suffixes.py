"""Repeated passages by sparse suffix arrays (operator 3).

Suffixes are kept where an 8-word hash is the least of 20 consecutive ones.
That choice depends on content alone: a window of 50 words belongs to the
suffix kept at the minimiser of its first 20 positions, at most 19 words in,
wherever else the window stands.

1. Kept suffixes are grouped by a hash of their first 31 words, which all
   windows of a suffix share; those that one document alone holds go.
2. The others meet in the bucket of that hash and are sorted as suffixes: 50
   words to the right, each a 32-bit symbol. A bucket of over GROUP suffixes is
   dealt over parts by document.
3. Neighbours are compared word by word: the common prefixes of neighbours
   extend a match to the right, and the words on the left, nearest first,
   split its group step by step. Each window so meets its equals, of which the
   least document is told. Windows of buckets in parts are decided by an
   aggregate over the parts, with map-side combine.

No pairs are formed; a passage that a third of all documents hold costs a few
rows a document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandweave.core.session import bounded, checkpoint, ship
from strandweave.llm import textscan

K, SPAN, WINDOW = 8, 20, 50
HELD = 200_000  #: most rows of hashes that are broadcast
BYTES = 64 << 20  #: most bytes of places that are broadcast
ROWS = 1 << 14  #: suffixes that one step writes or compares at least
GROUP = 1 << 15  #: suffixes of a bucket beyond which it is dealt over parts


def anchors(h: np.ndarray, first: np.ndarray, k: int, span: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, least, most) of the kept suffixes: windows from ``least`` to ``most`` words before ``place`` belong to it.

    ``h`` has the word hashes of texts end to end, ``first`` each text's first word.
    """
    g = textscan.grams(h, k)
    none = np.zeros(0, np.int64)
    if len(h) < window:
        return none, none, none, none
    ok = textscan.inner(first, window, len(h))
    low = np.lib.stride_tricks.sliding_window_view(g, span)
    at = np.flatnonzero(ok)  # starts of windows
    place = np.empty(len(at), dtype=np.int64)
    for a in range(0, len(at), 1 << 15):
        part = at[a : a + (1 << 15)]
        place[a : a + len(part)] = part + low[part].argmin(axis=1)
    if not len(at):
        return none, none, none, none
    text = np.searchsorted(first, at, side="right") - 1
    new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (text[1:] != text[:-1])])
    last = np.r_[new[1:] - 1, len(at) - 1]
    return text[new], place[new], place[new] - at[last], place[new] - at[new]


def _runs(batches, column: int, k: int, span: int, window: int):
    """(batch, word hashes, first words, text, place, least, most) of each run of texts."""
    for part in textscan.runs(batches):
        w = textscan.words(part.column(column))
        h = w.hashes()
        yield (part, h, w.first, *anchors(h, w.first, k, span, window))


def _known(docs: DataFrame) -> DataFrame:
    """(doc_id, tid, text); tid tells texts of one doc_id apart."""
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tid"), "text")


def _shared(rows: DataFrame, k: int, span: int, window: int) -> DataFrame:
    """(doc_id, tid, place) of the kept suffixes whose first words stand in several documents; ``place`` has the part of its bucket in the upper 32 bits, -1 if it has one only."""

    def run(batches):
        for part, h, first, text, place, _, _ in _runs(batches, 2, k, span, window):
            g = textscan.grams(h, window - span + 1)[place]
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), part.column(0).take(pa.array(text)), part.column(1).take(pa.array(text)), pa.array((place - first[text]).astype(np.int32))], names=["g", "doc_id", "tid", "place"])

    kept = rows.mapInArrow(run, "g long, doc_id long, tid long, place int")
    several = kept.groupBy("g").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi")
    several = checkpoint(several.select("g", F.ceil(F.col("n") / GROUP).cast("long").alias("parts")))
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("doc_id", "tid"), F.col("parts"))).otherwise(F.lit(-1).cast("long"))
    return kept.join(several, "g").select("doc_id", "tid", F.shiftleft(part, 32).bitwiseOR(F.col("place").cast("long")).alias("place"))


_SUFFIX = "g long, part int, doc_id long, tid long, place int, least int, most int, suffix binary, before binary"


def _written(rows: DataFrame, places: DataFrame, k: int, span: int, window: int) -> DataFrame:
    """The suffixes at those places: ``window`` symbols from each on, and the ``span`` - 1 before it, nearest first; zeros beyond a text's ends."""
    names = [c.split()[0] for c in _SUFFIX.split(", ")]

    def run(batches):
        for part, h, first, text, place, least, most in _runs(batches, 2, k, span, window):
            lists = [np.asarray(p, dtype=np.int64) for p in part.column(3).to_pylist()]
            wanted = np.concatenate([*((p & 0xFFFFFFFF) + first[i] for i, p in enumerate(lists)), np.zeros(0, np.int64)])
            piece = np.concatenate([*lists, np.zeros(0, np.int64)]) >> 32
            order = np.argsort(wanted)
            wanted, piece = wanted[order], piece[order]
            at = np.flatnonzero(np.isin(place, wanted))
            symbol, g = (h >> np.uint64(32)).astype(np.uint32), textscan.grams(h, window - span + 1)
            for a in range(0, len(at), ROWS):
                some = at[a : a + ROWS]
                t, p = text[some], place[some]
                right, left = p[:, None] + np.arange(window), p[:, None] - 1 - np.arange(span - 1)
                right = np.where(right < first[t + 1][:, None], symbol[np.minimum(right, len(h) - 1)], 0).astype(">u4")
                left = np.where(left >= first[t][:, None], symbol[np.maximum(left, 0)], 0).astype(">u4")
                own = piece[np.searchsorted(wanted, p)].astype(np.int32)
                cols = [pa.array(g[p].view(np.int64)), pa.array(own), part.column(0).take(pa.array(t)), part.column(1).take(pa.array(t)), *(pa.array(x.astype(np.int32)) for x in (p - first[t], least[some], most[some])), _binary(right), _binary(left)]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    lists = checkpoint(places.groupBy("doc_id", "tid").agg(F.collect_set("place").alias("places")))
    size = lists.agg(F.sum(40 + 8 * F.size("places"))).first()[0] or 0
    return rows.join(F.broadcast(lists) if size <= BYTES else lists, ["doc_id", "tid"]).select("doc_id", "tid", "text", "places").mapInArrow(run, _SUFFIX)


def _binary(x: np.ndarray) -> pa.Array:
    """Each row of a matrix as bytes."""
    wide = x.shape[1] * x.dtype.itemsize
    offsets = np.arange(len(x) + 1, dtype=np.int32) * wide
    return pa.BinaryArray.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x).tobytes())])


def _symbols(column, wide: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u4").reshape(-1, wide).astype(np.uint32)


def equal_windows(right: np.ndarray, left: np.ndarray, least: np.ndarray, most: np.ndarray):
    """Yields (before, rows, group) for each number of words before the suffix: the sorted suffixes that have such a window, and numbers equal for equal windows.

    To the right, the words that neighbours share decide; to the left, groups
    are split by one word more at each step.
    """
    window = right.shape[1]
    same = right[1:] == right[:-1]
    shared = np.where(same.all(axis=1), window, same.argmin(axis=1)) if len(same) else np.zeros(0, np.int64)
    side = np.zeros(len(right), dtype=np.int64)
    for before in range(left.shape[1] + 1):
        if before:
            side = np.unique(side << 32 | left[:, before - 1], return_inverse=True)[1]
        rows = np.flatnonzero((least <= before) & (before <= most))
        if not len(rows):
            continue
        run = np.cumsum(np.r_[0, shared < window - before]) if len(right) else np.zeros(0, np.int64)
        yield before, rows, np.unique(run[rows] << 32 | side[rows], return_inverse=True)[1]


def repeated_windows(suffixes: DataFrame, window: int, span: int) -> DataFrame:
    """(doc_id, tid, at, last, earlier): windows that also start in a document with a smaller id, from ``at`` to ``last``, and the least such document."""
    names = ["doc_id", "tid", "at", "last", "earlier", "lo", "hi"]
    weight = textscan.mix(np.arange(1, window + 1, dtype=np.uint64)) | np.uint64(1)

    def judge(table: pa.Table):
        """All suffixes of some buckets, or of parts of buckets."""
        right, left = _symbols(table.column("suffix"), window), _symbols(table.column("before"), span - 1)
        doc, tid, place, least, most, part = (table.column(c).to_numpy() for c in ("doc_id", "tid", "place", "least", "most", "part"))
        late = []
        for before, rows, group in equal_windows(right, left, least, most):
            order = np.argsort(group, kind="stable")
            head = np.flatnonzero(np.r_[True, group[order][1:] != group[order][:-1]])
            first = np.minimum.reduceat(doc[rows][order], head)[group]
            whole = part[rows] < 0
            shut = np.flatnonzero(whole & (doc[rows] > first))
            late.append(np.stack([rows[shut], place[rows[shut]] - before, first[shut]]))
            r = rows[~whole]
            if len(r):
                words = np.concatenate([left[r, :before][:, ::-1], right[r, : window - before]], axis=1).astype(np.uint64)
                # 128 bits of the window's words in their order
                key = [pa.array(textscan.mix((textscan.mix(words + np.uint64(seed << 40)) * weight).sum(axis=1, dtype=np.uint64)).view(np.int64)) for seed in (1, 2)]
                at = pa.array((place[r] - before).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(doc[r]), pa.array(tid[r]), at, at, pa.nulls(len(r), pa.int64()), *key], names=names)
        row, at, first = np.concatenate([*late, np.zeros((3, 0), np.int64)], axis=1)
        if len(row):
            order = np.lexsort((at, row))
            row, at, first = row[order], at[order], first[order]
            new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1) | (first[1:] != first[:-1])])
            none = pa.nulls(len(new), pa.int64())
            cols = [pa.array(doc[row[new]]), pa.array(tid[row[new]]), pa.array(at[new].astype(np.int32)), pa.array(at[np.r_[new[1:] - 1, len(at) - 1]].astype(np.int32)), pa.array(first[new]), none, none]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < ROWS:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            g, part = table.column("g").to_numpy(), table.column("part").to_numpy()
            before = np.flatnonzero((g != g[-1]) | (part != part[-1]))
            cut = int(before[-1]) + 1 if len(before) else 0  # the last bucket may go on
            if cut:
                yield from judge(table.slice(0, cut).combine_chunks())
            held, n = table.slice(cut).to_batches(), n - cut
        if n:
            yield from judge(pa.Table.from_batches(held).combine_chunks())

    parts = int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = suffixes.repartition(parts, "g", "part").sortWithinPartitions("g", "part", "suffix", "doc_id", "tid", "place")
    found = checkpoint(sorted_.mapInArrow(run, "doc_id long, tid long, at int, last int, earlier long, lo long, hi long"))
    ends = found.where("lo is not null")
    whole = checkpoint(ends.groupBy("lo", "hi").agg(F.min("doc_id").alias("earlier"), F.max("doc_id").alias("latest")).where("earlier < latest").select("lo", "hi", "earlier"))
    late = ends.drop("earlier").join(bounded(whole, HELD), ["lo", "hi"]).where("doc_id > earlier")
    columns = ["doc_id", "tid", "at", "last", "earlier"]
    return found.where("lo is null").select(*columns).unionByName(late.select(*columns))


def repeated_passages(docs: DataFrame, window: int = WINDOW, k: int = K, span: int = SPAN) -> DataFrame:
    """(doc_id, start, length, earlier_doc_id): maximal passages made of ``window``-word repeats from documents with smaller ids.

    ``start`` and ``length`` count words; ``earlier_doc_id`` is the least
    document that holds a window of the passage. Documents that repeat nothing
    have no row. Null texts and rows without doc_id take no part. Rows that
    repeat a doc_id do not repeat each other; each of its texts has its own
    passages, and a row repeated as it is counts once.
    """
    ship(docs.sparkSession)
    if window - span + 1 < k:
        raise ValueError("a window must hold the words of every anchor in its span")
    rows = _known(docs)
    suffixes = _written(rows, _shared(rows, k, span, window), k, span, window)
    found = repeated_windows(suffixes, window, span)
    order = W.partitionBy("doc_id", "tid").orderBy("at", "last")
    reach = F.max("last").over(order.rowsBetween(W.unboundedPreceding, -1))
    cut = found.withColumn("new", F.when(F.col("at") <= reach + window, 0).otherwise(1))
    island = cut.withColumn("island", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    spans = island.groupBy("doc_id", "tid", "island").agg(F.min("at").alias("start"), F.max("last").alias("last"), F.min("earlier").alias("earlier_doc_id"))
    return spans.select("doc_id", F.col("start").cast("long").alias("start"), (F.col("last") + window - F.col("start")).cast("long").alias("length"), "earlier_doc_id")

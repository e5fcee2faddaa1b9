"""Repeated-line removal by range-partitioned, document-ordered line hashes (operator 6)."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.core.session import bounded, checkpoint, extended, free_name, ship
from strandweave.llm import textscan

MIN_CHARS, MIN_DOCS = 40, 5
HELD = 200_000  #: most line hashes that are broadcast


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, doc_id, tid, pos) of every line whose key has ``min_chars`` code points; tid tells rows of one doc_id apart."""
    ship(docs.sparkSession)
    names = ["h1", "h2", "doc_id", "tid", "pos"]

    def run(batches):
        for part in textscan.runs(batches, "text"):
            raw, start, end, first = textscan.lines(part.column(2))
            start, end = textscan.stripped(raw, start, end)
            at = np.flatnonzero(textscan.code_points(raw, start, end) >= min_chars)
            if not len(at):
                continue
            h1, h2 = textscan.segment_hash(textscan.LOWER[raw], start[at], end[at])
            text = np.searchsorted(first, at, side="right") - 1
            cols = [h1.view(np.int64), h2.view(np.int64), part.column(0).to_numpy()[text], part.column(1).to_numpy()[text], (at - first[text]).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tid"), "text")
    return rows.mapInArrow(run, "h1 long, h2 long, doc_id long, tid long, pos int")


def _changes(*columns: np.ndarray) -> np.ndarray:
    new = np.ones(len(columns[0]), dtype=bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, tid, pos) of the lines to remove.

    Line hashes (128 bits) are range-partitioned and sorted by hash, then
    document from the largest, then position, so the first occurrences of a
    hash are those to keep. The range bounds include the document, so a line
    that a third of all documents hold spreads over many partitions. A hash
    whose rows lie inside one streamed batch is decided there; the one or two
    at a batch's ends may go on elsewhere and are decided by an aggregate with
    map-side combine.
    """
    spark = docs.sparkSession
    names = ["open", "h1", "h2", "doc_id", "tid", "pos"]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2, doc, tid, pos = (c.to_numpy() for c in batch.columns)
            starts = np.flatnonzero(_changes(h1, h2))
            group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(h1)]))
            docs_in = np.bincount(group, weights=_changes(h1, h2, doc)).astype(np.int64)
            at_end = np.zeros(len(starts), dtype=bool)
            at_end[[0, -1]] = True
            drop = ~at_end[group] & (docs_in[group] >= min_docs) & (doc != doc[starts][group])
            give = np.flatnonzero(drop | at_end[group])
            if len(give):
                yield pa.RecordBatch.from_arrays([pa.array(c[give]) for c in (at_end[group], h1, h2, doc, tid, pos)], names=names)

    keys = checkpoint(line_keys(docs, min_chars))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["h1", "h2", F.col("doc_id").desc()]
    found = checkpoint(
        keys.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order, "tid", "pos")
        .mapInArrow(run, "open boolean, h1 long, h2 long, doc_id long, tid long, pos int")
    )
    ends = found.where("open")
    whole = ends.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.count("one").alias("docs"), F.max("doc_id").alias("last"))
    whole = bounded(checkpoint(whole.where(F.col("docs") >= min_docs)), HELD)  # one or two lines a batch
    late = ends.join(whole, ["h1", "h2"]).where("doc_id <> last")
    return found.where("not open").select("doc_id", "tid", "pos").union(late.select("doc_id", "tid", "pos"))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, tid, keep): for each document that loses lines a deflated bitmap, one bit a line, lines after its end kept."""
    names = ["doc_id", "tid", "keep"]

    def run(batches):
        for batch in batches:
            out = []
            for gone in batch.column(2).to_pylist():
                bits = np.ones((max(gone) // 8 + 1) * 8, dtype=np.uint8)
                bits[gone] = 0
                out.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=names)

    lost = dropped_lines(docs, min_chars, min_docs).groupBy("doc_id", "tid").agg(F.collect_list("pos").alias("pos"))
    return lost.mapInArrow(run, "doc_id long, tid long, keep binary")


def kept_text(text: str | None, keep: bytes | None) -> tuple[str, int, int]:
    """The text of the lines kept, the lines before, and the lines dropped."""
    parts = (text or "").split("\n")
    if keep is None:
        return "\n".join(parts), len(parts), 0
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), bitorder="little").tolist()
    kept = [x for x, b in zip(parts, bits, strict=False) if b] + parts[len(bits) :]
    return "\n".join(kept), len(parts), len(parts) - len(kept)


def without_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The documents after line removal with two more, last columns ``n_lines`` and ``n_dropped``; other columns are kept.

    Input columns of those names keep their values; the new ones then end in an underscore.

    A null or empty text is one empty line. A row without doc_id counts for no
    line and loses none. Rows that repeat a doc_id are one document in counts;
    each is cut by its own bitmap. Lines of a key in fewer than ``min_docs``
    documents stay, as do all lines of it in the largest doc_id.
    """
    ship(docs.sparkSession)
    n_lines, n_dropped = free_name(docs, "n_lines"), free_name(docs, "n_dropped")
    rest = docs.columns
    schema = extended(docs, **{n_lines: "long", n_dropped: "long"})

    def run(batches):
        for batch in batches:
            keep = batch.column(batch.num_columns - 1).to_pylist()
            at = batch.schema.get_field_index("text")
            done = [kept_text(t, k) for t, k in zip(batch.column(at).to_pylist(), keep, strict=True)]
            cols = [batch.column(i) for i in range(len(rest))]
            cols[at] = pa.array([d[0] for d in done], pa.string())
            cols += [pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*rest, n_lines, n_dropped])

    maps = keep_bitmaps(docs, min_chars, min_docs).select(F.col("doc_id").alias("__doc"), F.col("tid").alias("__tid"), "keep")
    on = (docs["doc_id"].cast("long") == maps["__doc"]) & (F.xxhash64(docs["text"]) == maps["__tid"])
    return docs.join(maps, on, "left").select(*[docs[c] for c in rest], maps["keep"].alias("__keep")).mapInArrow(run, schema)


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) after line removal."""
    ship(docs.sparkSession)
    names = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]

    def run(batches):
        for batch in batches:
            done = [kept_text(t, k) for t, k in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            cols = [batch.column(0), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64()), pa.array([hashlib.sha256(d[0].encode()).hexdigest() for d in done], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    maps = keep_bitmaps(docs).select(F.col("doc_id").alias("__doc"), F.col("tid").alias("__tid"), "keep")
    on = (docs["doc_id"] == maps["__doc"]) & (F.xxhash64(docs["text"]) == maps["__tid"])
    return docs.join(maps, on, "left").select("doc_id", "text", "keep").mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")

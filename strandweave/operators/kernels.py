"""Arrow kernels over sequences(seq_id, dna): one pass over the bases of a batch, without exploding rows and without a shuffle.

Bases of many sequences are worked on end to end, in runs of bounded size; a
longer sequence is a run of its own. Null sequences count as empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from strandweave.core.genetic import CODE
from strandweave.core.session import ship

RUN = 1 << 20  #: bases of a run
_CODE = np.full(256, 4, dtype=np.int8)  #: A, C, G, T are 0 to 3, any other letter 4
for _i, _b in enumerate("ACGT"):
    _CODE[ord(_b)] = _i
CODONS = [a + b + c for a in "ACGT" for b in "ACGT" for c in "ACGT"]  #: by their number 16 a + 4 b + c
AMINO = np.array([CODE[c] for c in CODONS])
FIXED = np.isin(AMINO, list("MW*"))


class Run:
    """Bases of several sequences end to end: ``codes`` and ``first``, each one's first base and, last, their number."""

    def __init__(self, column: pa.Array):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = column.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
        self.raw, self.first = raw, offsets - offsets[0]
        self.codes = _CODE[raw]
        self.size = np.diff(self.first)

    def starts(self, k: int, step: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sequence, place in it, base) of every ``step``-th start of k bases."""
        n = np.maximum(0, (self.size - k) // step + 1)
        row = np.repeat(np.arange(len(n)), n)
        place = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * step
        return row, place, self.first[row] + place

    def codons(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sequence, place, number) of the whole codons; the number of one with another letter is -1."""
        row, place, at = self.starts(3, 3)
        c = self.codes.astype(np.int64)
        number = 16 * c[at] + 4 * c[at + 1] + c[at + 2]
        bad = (c[at] > 3) | (c[at + 1] > 3) | (c[at + 2] > 3)
        return row, place // 3, np.where(bad, -1, number)

    def words(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sequence, place, number) of every k-letter word, k at most 27, in base five."""
        row, place, at = self.starts(k)
        number = np.zeros(len(at), dtype=np.int64)
        for i in range(k):
            number = number * 5 + self.codes[at + i]
        return row, place, number

    def window_sums(self, per_base: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(per_base, dtype=np.int64)])
        return total[at + width] - total[at]


def runs(batches: Iterator[pa.RecordBatch], column: str = "dna", limit: int = RUN) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in runs of about ``limit`` letters; a longer one is a run of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def kernel(seqs: DataFrame, work: Callable[[Run], tuple[np.ndarray | None, list]], columns: str, whole: bool = False) -> DataFrame:
    """``work`` on every run of seqs(seq_id, dna).

    ``work(run)``, or ``work(batch)`` of whole rows (seq_id, dna) if ``whole``,
    returns the row of its run that each result belongs to, or None for one
    result a row, and the result columns, named and typed by ``columns``.
    seq_id comes along.
    """
    ship(seqs.sparkSession)
    rows = seqs.select("seq_id", "dna")
    types = T._parse_datatype_string(columns)
    schema = T.StructType([rows.schema["seq_id"], *types.fields])
    names = schema.names

    def run(batches):
        for part in runs(batches):
            row, cols = work(part if whole else Run(part.column(1)))
            ids = part.column(0) if row is None else part.column(0).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([ids, *(c if isinstance(c, pa.Array) else pa.array(c) for c in cols)], names=names)

    return rows.mapInArrow(run, schema)


def tally(seqs: DataFrame, work: Callable[[Run], tuple[list, np.ndarray]], key: str, kind: str = "string") -> DataFrame:
    """(key, n): counts of every run, summed over the runs of a batch and then, with map-side combine, over all."""
    from pyspark.sql import functions as F

    ship(seqs.sparkSession)

    def run(batches):
        for part in runs(batches):
            names, n = work(Run(part.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(n, pa.int64())], names=[key, "n"])

    return seqs.select("dna").mapInArrow(run, f"{key} {kind}, n long").groupBy(key).agg(F.sum("n").alias("n"))

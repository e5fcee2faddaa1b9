"""Sequence packing as a cutting-stock problem solved by column generation (operator 5).

Documents are cut into full pieces and a remainder. A linear program over the
histogram of remainders finds patterns of lengths that fill a sequence; its
columns are priced by a knapsack. Patterns without padding are rounded down
and used as often as that; what is left is laid end to end and cut at the ends
of sequences, so that at most the last one is padded.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.core.session import bounded, checkpoint, ship
from strandweave.llm import textscan
from strandweave.llm.sharding import numbered
from strandweave.llm.tokens import TextEncoder, default_path

LENGTH = 1024
CUT_DOCS = 100_000  #: most documents whose cuts are broadcast
GAP = 5e-3  #: the linear program stops within this share of its lower bound
COLUMNS = 24  #: columns taken from one pricing
STALL = 25  #: pricings without progress after which the linear program stops; its gap is then larger


def padded(fill: np.ndarray | int, length: int = LENGTH):
    """Tokens that a sequence of ``fill`` takes: none are added at a power of two, else it is filled up to ``length``."""
    fill = np.asarray(fill)
    return np.where((fill & (fill - 1)) == 0, fill, length)


class Pricing:
    """Unbounded knapsack over exact fills: the best value of a pattern of each total length."""

    def __init__(self, sizes: np.ndarray, length: int):
        self.sizes, self.length = sizes, length
        self.cost = padded(np.arange(length + 1), length).astype(float)

    def best(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        top = np.full(self.length + 1, -np.inf)
        last = np.full(self.length + 1, -1, dtype=np.int64)
        top[0] = 0.0
        ends = np.searchsorted(self.sizes, np.arange(self.length + 1), side="right")
        for fill in range(1, self.length + 1):
            n = ends[fill]
            if n:
                found = top[fill - self.sizes[:n]] + value[:n]
                at = int(found.argmax())
                top[fill], last[fill] = found[at], at
        return top, last

    def pattern(self, last: np.ndarray, fill: int) -> np.ndarray:
        out = np.zeros(len(self.sizes))
        while fill:
            out[last[fill]] += 1
            fill -= int(self.sizes[last[fill]])
        return out


def fullest(room: int, most: dict[int, int]) -> dict[int, int]:
    """How many of each size (at most ``most``) fill ``room`` best: subset sums as the bits of one integer, larger sizes first."""
    steps, reach, mask = [], 1, (1 << (room + 1)) - 1
    for s in sorted((s for s, n in most.items() if n and s <= room), reverse=True):
        for _ in range(min(most[s], room // s)):
            more = (reach | reach << s) & mask
            if more == reach:
                break
            steps.append((s, reach))
            reach = more
        if reach >> room & 1:
            break
    fill, out = reach.bit_length() - 1, {}
    for s, before in reversed(steps):
        if not before >> fill & 1:
            out[s] = out.get(s, 0) + 1
            fill -= s
    return out


def first_basis(sizes: np.ndarray, demand: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """A triangular feasible basis: from the longest size on, each takes all that is left of it with smaller sizes that can follow it."""
    m = len(sizes)
    basis, x, left = np.zeros((m, m)), np.zeros(m), demand.astype(float)
    place = {int(s): i for i, s in enumerate(sizes)}
    for j in reversed(range(m)):
        size, need = int(sizes[j]), left[j]
        if need <= 1e-9:
            basis[j, j] = length // size
            continue
        most = {int(s): int(n) for s, n in zip(sizes[:j], left[:j] / need + 1e-9, strict=True) if n >= 1}
        added = fullest(length - size, most)
        own = 1 + (length - size - sum(s * n for s, n in added.items())) // size
        basis[j, j], x[j], left[j] = own, need / own, 0.0
        for s, n in added.items():
            basis[place[s], j] = n
            left[place[s]] = max(0.0, left[place[s]] - n * x[j])
    return basis, x


def column_generation(sizes: np.ndarray, demand: np.ndarray, length: int = LENGTH, gap: float = GAP) -> tuple[np.ndarray, np.ndarray, float]:
    """Patterns (one column each), how often each is used in the linear program's solution, and a lower bound of its cost.

    Rows are the distinct piece lengths, at most ``length`` of them whatever
    the corpus. A revised simplex keeps the basis inverse; each step prices
    new patterns by dynamic programming over the duals and ends when the cost
    is within ``gap`` of the bound that the scaled duals prove, or stalls.
    """
    m = len(sizes)
    price = Pricing(sizes, length)
    basis, x = first_basis(sizes, demand, length)
    cost = padded((sizes[:, None] * basis).sum(axis=0).astype(np.int64), length).astype(float)
    inverse = np.zeros((m, m))
    for i in reversed(range(m)):  # the first basis is triangular and sparse
        later = i + 1 + np.flatnonzero(basis[i, i + 1 :])
        inverse[i] = -(basis[i, later, None] * inverse[later]).sum(axis=0) / basis[i, i]
        inverse[i, i] += 1.0 / basis[i, i]
    bound = float((demand * sizes).sum())
    lowest, since = np.inf, 0
    while True:
        dual = np.einsum("i,ij->j", cost, inverse)
        top, last = price.best(dual)
        ratio = top[1:] / price.cost[1:]
        bound = max(bound, float((dual * demand).sum()) / max(1.0, float(ratio.max())))
        total = float((cost * x).sum())
        fill = int(np.argmin(price.cost[1:] - top[1:])) + 1
        lowest, since = (total, 0) if total < lowest * (1 - 1e-5) else (lowest, since + 1)
        if price.cost[fill] - top[fill] > -1e-9 or total <= bound * (1 + gap) or since > STALL:
            return basis, x, bound
        columns = [(fill, price.pattern(last, fill))]
        forced = dual + top[length - sizes]  # the best full pattern with each length in it
        for i in np.argsort(-forced)[:COLUMNS]:
            if forced[i] > length + 1e-9:
                pattern = price.pattern(last, int(length - sizes[i]))
                pattern[i] += 1
                columns.append((length, pattern))
        moved = False
        for fill, column in columns:
            step = np.einsum("ij,j->i", inverse, column)
            if moved and price.cost[fill] - (cost * step).sum() > -1e-9:
                continue
            can = step > 1e-7
            if not can.any():
                continue
            limit = np.where(can, x / np.where(can, step, 1.0), np.inf)
            near = np.flatnonzero(limit <= limit.min() + 1e-9)
            out = int(near[step[near].argmax()])  # the largest pivot among ties
            t = limit[out]
            x = np.maximum(x - t * step, 0.0)
            x[out] = t
            pivot = inverse[out] / step[out]
            inverse -= np.outer(step, pivot)
            inverse[out] = pivot
            basis[:, out] = column
            cost[out] = price.cost[fill]
            moved = True
        if not moved:
            return basis, x, bound


@dataclass
class Plan:
    """Places by length and rank within it.

    Ranges of ranks: the pieces of one length from rank ``start`` on fill
    ``each`` places of consecutive sequences. Ranks from ``tail_start`` of
    their length on are laid end to end from ``tail_base`` bases behind the
    start of sequence ``tail``, and may go on in the next one.
    """

    size: np.ndarray
    start: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    tail_size: np.ndarray
    tail_start: np.ndarray
    tail_base: np.ndarray
    tail: int
    sequences: int
    padding: int
    bound: float
    length: int = LENGTH

    def place(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sequence, offset, here): ``here`` tokens of each piece lie there, the rest at the start of the next sequence."""
        at = np.maximum(np.searchsorted(self.size.astype(np.int64) << 48 | self.start, size.astype(np.int64) << 48 | rank, side="right") - 1, 0)
        if len(self.size):
            past = rank - self.start[at]
            sequence, offset = self.sequence[at] + past // self.each[at], self.offset[at] + past % self.each[at] * size
        else:
            sequence = offset = np.zeros(len(size), dtype=np.int64)
        if len(self.tail_size):
            of = np.minimum(np.searchsorted(self.tail_size, size), len(self.tail_size) - 1)
            behind = (self.tail_size[of] == size) & (rank >= self.tail_start[of])
            spot = self.tail_base[of] + (rank - self.tail_start[of]) * size
            sequence, offset = np.where(behind, self.tail + spot // self.length, sequence), np.where(behind, spot % self.length, offset)
        return sequence, offset, np.minimum(size, self.length - offset)


def plan(histogram: dict[int, int], length: int = LENGTH, gap: float = GAP) -> Plan:
    """Patterns for a histogram of piece lengths; every piece gets exactly one place."""
    whole = histogram.get(length, 0)
    sizes = np.array(sorted(s for s in histogram if s < length), dtype=np.int64)
    demand = np.array([histogram[int(s)] for s in sizes], dtype=np.int64)
    used: list[tuple[np.ndarray, int]] = []
    bound, rest = 0.0, demand.copy()
    if len(sizes):
        basis, x, bound = column_generation(sizes, demand.astype(float), length, gap)
        for j in np.argsort(-x, kind="stable"):
            column = basis[:, j].astype(np.int64)
            some = column > 0
            fill = int((column * sizes).sum())
            if int(padded(fill, length)) != fill:
                continue  # cutting its pieces wastes less
            times = min(int(x[j] + 1e-9), int((rest[some] // column[some]).min()))
            if times:
                used.append((column, times))
                rest -= times * column
    rows, taken, number = [], np.zeros(len(sizes), dtype=np.int64), 0
    for column, times in used:
        offset = 0
        for i in np.flatnonzero(column)[::-1]:
            rows.append((int(sizes[i]), int(taken[i]), int(column[i]), number, offset))
            taken[i] += times * column[i]
            offset += int(column[i] * sizes[i])
        number += times
    if whole:
        rows.append((length, 0, 1, number, 0))
    rows.sort()
    cols = [np.array(c, dtype=np.int64) for c in (zip(*rows, strict=True) if rows else ([],) * 5)]
    left = rest > 0
    spread = rest[left] * sizes[left]
    total = int(spread.sum())
    padding = int(padded(total % length, length) - total % length) if total % length else 0
    return Plan(*cols, sizes[left], taken[left], np.cumsum(spread) - spread, number + whole, number + whole - (-total // length), padding, bound + whole * length, length)


def pieces(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) of the pieces of every document, cut at multiples of ``length``."""
    ship(docs.sparkSession)
    path = path or default_path()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches):
        encoder = TextEncoder(path)
        for part in textscan.runs(batches):
            ids, first = encoder.encode(part.column(1))
            ids = ids.astype("<u4", copy=False)
            ends = np.zeros(1, "<u4").tobytes()
            rows = []
            for doc, a, b in zip(part.column(0).to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                data, n = ids[a:b].tobytes() + ends, b - a + 1
                rows += [(doc, s, min(length, n - s), zlib.crc32(data[4 * s : 4 * (s + length)]), n) for s in range(0, n, length)]
            cols = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ", ".join(f"{n} long" for n in names))


_PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]


def _cut(docs: DataFrame, cuts: DataFrame, path: str) -> DataFrame:
    """(*piece, here, first_crc32, second_crc32): the checksums of both parts of cuts(*piece, here), from their documents' tokens."""
    names = [*_PIECE, "here", "first_crc32", "second_crc32"]

    def run(batches):
        encoder = TextEncoder(path)
        for batch in batches:
            for part in textscan.runs([batch]):
                ids, first = encoder.encode(part.column(part.schema.get_field_index("text")))
                ids = ids.astype("<u4", copy=False)
                rows = []
                for doc, cut, a, b in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                    data = ids[a:b].tobytes() + np.zeros(1, "<u4").tobytes()
                    for c in cut:
                        piece = data[4 * c["start"] : 4 * (c["start"] + c["length"])]
                        if c["doc_tokens"] == b - a + 1 and zlib.crc32(piece) == c["ids_crc32"]:  # else another text of this doc_id
                            rows.append((doc, c["start"], c["length"], c["ids_crc32"], c["doc_tokens"], c["here"], zlib.crc32(piece[: 4 * c["here"]]), zlib.crc32(piece[4 * c["here"] :])))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    by_doc = cuts.groupBy("doc_id").agg(F.collect_list(F.struct(*[c for c in (*_PIECE[1:], "here")])).alias("cuts")).withColumnRenamed("doc_id", "__doc")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    met = rows.join(bounded(by_doc, CUT_DOCS), F.col("doc_id").eqNullSafe(F.col("__doc"))).select("doc_id", "text", "cuts")
    return met.mapInArrow(run, ", ".join(f"{n} long" for n in names)).distinct()


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, gap: float = GAP) -> DataFrame:
    """The pieces of all documents, each with sequence_id and offset in a sequence of at most ``length`` tokens.

    Full pieces are sequences of their own. The histogram of the other lengths
    (under ``length`` rows, however large the corpus) is all that the driver
    sees; the plan it makes has a bounded number of rank ranges, and pieces,
    ranked within their length in slices, look up their places. Pieces that
    the plan cuts in two are tokenised again for the checksums of their
    parts. A null text is empty and has the one end token; repeated rows are
    packed each.
    """
    path = path or default_path()
    made = checkpoint(pieces(docs, path, length))
    histogram = {r["length"]: r["count"] for r in made.groupBy("length").count().collect()}
    where = plan(histogram, length, gap)
    names = [*_PIECE, "sequence_id", "offset", "here"]

    def run(batches):
        for batch in batches:
            placed = where.place(batch.column(2).to_numpy(), batch.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *(pa.array(x) for x in placed)], names=names)

    ranked = numbered(made, ["length"], ["doc_id", "start", "ids_crc32"], ["doc_id", "start", "ids_crc32"], "rank")
    placed = checkpoint(ranked.select(*_PIECE, "rank").mapInArrow(run, ", ".join(f"{n} long" for n in names)))
    out = [*_PIECE, "sequence_id", "offset"]
    uncut, split = placed.where("here = length").select(*out), placed.where("here < length")
    sums = _cut(docs, split.select(*_PIECE, "here").distinct(), path)
    on = [*_PIECE, "here"]
    both = split.alias("s").join(sums.alias("c"), [F.col(f"s.{c}").eqNullSafe(F.col(f"c.{c}")) for c in on]).select("s.*", "first_crc32", "second_crc32")
    part = F.explode(F.array(
        F.struct("start", F.col("here").alias("length"), F.col("first_crc32").alias("ids_crc32"), "sequence_id", "offset"),
        F.struct((F.col("start") + F.col("here")).alias("start"), (F.col("length") - F.col("here")).alias("length"), F.col("second_crc32").alias("ids_crc32"), (F.col("sequence_id") + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")),
    )).alias("p")
    return uncut.unionByName(both.select("doc_id", "doc_tokens", part).select("doc_id", "p.start", "p.length", "p.ids_crc32", "doc_tokens", "p.sequence_id", "p.offset"))

"""Vectorised scanning of Arrow text batches: words, word hashes and n-gram hashes.

Everything here works on one bounded run of rows at a time (``runs``), so a
worker's memory depends on the run size and the longest single text only.
Words are the maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``; null texts
count as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

RUN_BYTES = (1 << 20) - (1 << 12)  #: a little under a power of two, which the tables of powers are rounded up to

_M = (1 << 64) - 1
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_R, _R2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_RI, _R2I = pow(_R, -1, 1 << 64), pow(_R2, -1, 1 << 64)
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        out = np.ones(size, dtype=np.uint64)
        done, step = 1, base
        while done < size:
            out[done : 2 * done] = out[:done] * np.uint64(step)
            done, step = 2 * done, step * step & _M
        have = out
        if size <= 1 << 20:  # a worker keeps no more than a run needs
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser; a new array."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and each text's start (one more entry than texts)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    off = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def release() -> None:
    """Give freed memory back: a worker that waits for its next task shares its executor's memory with others."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # no glibc


def runs(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = RUN_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in runs of about ``limit`` text bytes; a longer text is a run of its own."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, off = text_bytes(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    release()


@dataclass
class Words:
    raw: np.ndarray  #: bytes of the run
    start: np.ndarray  #: first byte of each word
    end: np.ndarray  #: byte after each word
    first: np.ndarray  #: first word of each text, one more entry than texts

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        n = len(self.raw)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[self.raw] * powers(_R, n), out=total[1:])
        h = total[self.end] - total[self.start]
        h *= powers(_RI, n + 1)[self.start]
        return mix(h ^ (self.end - self.start).astype(np.uint64))

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.count)


def words(column: pa.Array, lower: bool = False) -> Words:
    raw, off = text_bytes(column)
    if lower:
        raw = LOWER[raw]
    inside = ~IS_SPACE[raw]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    finish = inside.copy()
    finish[:-1] &= ~inside[1:]
    edges = off[1:-1]
    edges = edges[(edges > 0) & (edges < len(raw))]
    begin[edges] = inside[edges]  # a text's end also ends a word
    finish[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    return Words(raw, start, end, np.searchsorted(start, off))


def grams(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """The hash of each k consecutive entries of h, by first entry; len(h) - k + 1 of them."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64)
    if seed:
        h = mix(h + np.uint64(seed * 0x9E3779B97F4A7C15 & _M))
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(h * powers(_R2, n), out=total[1:])
    g = total[k:] - total[:-k]
    g *= powers(_R2I, n - k + 1)
    return mix(g ^ np.uint64(k))


def inner(first: np.ndarray, k: int, n: int) -> np.ndarray:
    """Whether the k entries from each position lie in one text; for the positions of ``grams``."""
    ok = np.ones(max(0, n - k + 1), dtype=bool)
    for back in range(1, k):
        at = first[1:-1] - back
        at = at[(at >= 0) & (at < len(ok))]
        ok[at] = False
    return ok


def lines(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines cut at \\n: bytes of the run, first and last byte of each line, and each text's first line; an empty text has one line."""
    raw, off = text_bytes(column)
    breaks = np.flatnonzero(raw == 0x0A)
    in_text = np.searchsorted(breaks, off)
    count = np.diff(in_text) + 1
    first = np.concatenate([[0], np.cumsum(count)])
    start = np.empty(first[-1], dtype=np.int64)
    end = np.empty(first[-1], dtype=np.int64)
    at = np.arange(len(breaks)) + np.repeat(np.arange(len(count)), count - 1)  # the line that each break ends
    start[first[:-1]], end[first[1:] - 1] = off[:-1], off[1:]
    end[at] = breaks
    start[at + 1] = breaks + 1
    return raw, start, end, first


def segment_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray, seeds=(0, 1)) -> list[np.ndarray]:
    """Independent 64-bit hashes of byte ranges, one array for each seed."""
    n, out = len(raw), []
    for seed in seeds:
        table = mix(_BYTE + np.uint64(seed * 0x9E3779B97F4A7C15 & _M)) | np.uint64(1)
        base = _R if not seed else _R2
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(table[raw] * powers(base, n), out=total[1:])
        h = (total[end] - total[start]) * powers(_RI if not seed else _R2I, n + 1)[start]
        out.append(mix(h ^ (end - start).astype(np.uint64)))
    return out


def stripped(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges without white space at both ends; empty ones at their start."""
    solid = np.flatnonzero(~IS_SPACE[raw])
    a = np.searchsorted(solid, start)
    b = np.searchsorted(solid, end)
    some = b > a
    if len(solid):
        lo = np.where(some, solid[np.minimum(a, len(solid) - 1)], start)
        hi = np.where(some, solid[np.maximum(b - 1, 0)] + 1, start)
        return lo, hi
    return start, start.copy()


def code_points(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return total[end] - total[start]


def prefix_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray, total: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of byte ranges, and the running sums to pass on for more ranges of the same bytes."""
    n = len(raw)
    if total is None:
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[raw] * powers(_R, n), out=total[1:])
    return mix((total[end] - total[start]) * powers(_RI, n + 1)[start]), total

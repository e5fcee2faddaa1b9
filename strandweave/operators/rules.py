"""Constraint rules as operators that produce violations, each with the incremental veto that solvers use.

Every rule maps sequences(seq_id, dna) to
violations(seq_id, constraint, severity, start, end, detail) with 0-based
half-open spans, and ``ok_suffix(prefix, codon)`` says whether appending a
codon to a clean prefix keeps it clean. The two agree: a sequence built under
``ok_suffix`` has no violations. ``spans`` states a rule plainly; ``found`` gives
the same spans with their details, fast over long sequences.

``validate`` runs any number of rules in one pass over the sequences, without
a shuffle.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandweave.core.genetic import STOPS, iupac_regex, reverse_complement, with_reverse
from strandweave.operators.kernels import Run, kernel

COLUMNS = ("seq_id", "constraint", "severity", "start", "end", "detail")
UNBOUNDED = 1 << 30
_WIDEST = 27  #: letters of a word that one number holds


@dataclass(frozen=True)
class Rule:
    """``name`` and ``context``, the bases before a codon that the veto reads."""

    @property
    def settled(self) -> int:
        """The length of a prefix from which on the veto depends on the context alone."""
        return self.context

    def violations(self, seqs: DataFrame) -> DataFrame:
        return validate(seqs, [self])

    def spans(self, dna: str) -> list[tuple[int, int]]:
        """The violating spans of one sequence."""
        raise NotImplementedError

    def found(self, dna: str) -> list[tuple[int, int, str]]:
        """The same with what each one is."""
        return [(a, b, dna[a:b]) for a, b in self.spans(dna)]

    def ok_suffix(self, prefix: str, codon: str) -> bool:
        tail = prefix if self.context >= UNBOUNDED else prefix[max(0, len(prefix) - self.context) :]
        return all(end <= len(tail) for _, end in self.spans(tail + codon))


def _tail(prefix: str, n: int) -> str:
    return prefix[max(0, len(prefix) - n) :]


def _words(dna: str, k: int) -> np.ndarray | None:
    """Every k-letter word as a number; None where one number cannot hold it or a letter is not a base."""
    run = Run(pa.array([dna]))
    return run.words(k)[2] if k <= _WIDEST and not (run.codes > 3).any() else None


@lru_cache
def _pattern(text: str) -> re.Pattern:
    return re.compile(text)


def _runs_in(dna: str, letter, most: int) -> list[tuple[int, int]]:
    out, at = [], 0
    while at < len(dna):
        to = at + 1
        while to < len(dna) and letter(dna[to]) == letter(dna[at]):
            to += 1
        if letter(dna[at]) and to - at > most:
            out.append((at, to))
        at = to
    return out


@dataclass(frozen=True)
class Homopolymer(Rule):
    """Runs of one base longer than ``most``."""

    most: int = 6
    name = "homopolymer"

    @property
    def context(self) -> int:
        return self.most

    def found(self, dna):
        return [(m.start(), m.end(), f"run of {m.group(1)} x {m.end() - m.start()}") for m in _pattern(rf"(.)\1{{{self.most},}}").finditer(dna)]

    def ok_suffix(self, prefix, codon):
        return not _pattern(rf"(.)\1{{{self.most},}}").search(_tail(prefix, self.most) + codon)

    def spans(self, dna):
        return _runs_in(dna, lambda c: c, self.most)


@dataclass(frozen=True)
class GcRun(Rule):
    """Runs of G or C longer than ``most``."""

    most: int = 8
    name = "gc_run"

    @property
    def context(self) -> int:
        return self.most

    def found(self, dna):
        return [(m.start(), m.end(), f"G/C run of {m.end() - m.start()}") for m in _pattern(f"[GC]{{{self.most + 1},}}").finditer(dna)]

    def ok_suffix(self, prefix, codon):
        return not _pattern(f"[GC]{{{self.most + 1},}}").search(_tail(prefix, self.most) + codon)

    def spans(self, dna):
        return _runs_in(dna, lambda c: c in "GC", self.most)


@dataclass(frozen=True)
class GcWindow(Rule):
    """Full windows whose GC share lies outside [low, high]; bounds are counts, with a tolerance of 1e-9."""

    width: int = 50
    low: float = 0.3
    high: float = 0.7
    name = "gc_window"

    @property
    def context(self) -> int:
        return self.width - 1

    def bounds(self) -> tuple[int, int]:
        return math.ceil(self.low * self.width - 1e-9), math.floor(self.high * self.width + 1e-9)

    def found(self, dna):
        lo, hi = self.bounds()
        run = Run(pa.array([dna]))
        _, place, at = run.starts(self.width)
        n = run.window_sums((run.codes == 1) | (run.codes == 2), at, self.width)
        bad = np.flatnonzero((n < lo) | (n > hi))
        return [(a, a + self.width, f"GC count {c}") for a, c in zip(place[bad].tolist(), n[bad].tolist(), strict=True)]

    def ok_suffix(self, prefix, codon):
        lo, hi = self.bounds()
        text = _tail(prefix, self.width - 1) + codon
        for end in range(max(self.width, len(text) - len(codon) + 1), len(text) + 1):
            part = text[end - self.width : end]
            if not lo <= part.count("G") + part.count("C") <= hi:
                return False
        return True

    def spans(self, dna):
        lo, hi = self.bounds()
        return [(i, i + self.width) for i in range(len(dna) - self.width + 1) if not lo <= sum(c in "GC" for c in dna[i : i + self.width]) <= hi]


@lru_cache
def _by_length(patterns: tuple[str, ...]) -> list[tuple[int, re.Pattern]]:
    """One pattern for all motifs of a length."""
    return [(n, re.compile("|".join(iupac_regex(p) for p in patterns if len(p) == n))) for n in sorted({len(p) for p in patterns})]


@dataclass(frozen=True)
class Motifs(Rule):
    """Occurrences, overlapping ones too, of IUPAC motifs and (if asked) of their reverse complements."""

    motifs: tuple[str, ...]
    both_strands: bool = True
    name: str = "forbidden_motif"

    def patterns(self) -> list[str]:
        return with_reverse(self.motifs) if self.both_strands else sorted({m.upper() for m in self.motifs})

    @property
    def context(self) -> int:
        return max(map(len, self.patterns())) - 1

    def found(self, dna):
        return [(m.start(), m.start() + len(p), f"motif {p}") for p in self.patterns() for m in _pattern(f"(?={iupac_regex(p)})").finditer(dna)]

    def ok_suffix(self, prefix, codon):
        tail = _tail(prefix, self.context)
        text = tail + codon
        return not any(p.search(text, max(0, len(tail) - n + 1)) for n, p in _by_length(tuple(self.patterns())))

    def spans(self, dna):
        return sorted((m.start(), m.start() + len(p)) for p in self.patterns() for m in re.finditer(f"(?={iupac_regex(p)})", dna))


def restriction_sites(sites: dict[str, str], extra: tuple[str, ...] = ()) -> Motifs:
    """Sites of named enzymes and further IUPAC sites, on both strands."""
    return Motifs((*sites.values(), *extra), True, "restriction_site")


def splice_sites() -> Motifs:
    """Strong donor and acceptor consensus on the sense strand."""
    return Motifs(("GTRAGT", "YYYYYYNYAGG"), False, "splice_site")


@dataclass(frozen=True)
class TandemRepeat(Rule):
    """A unit of ``unit`` bases ``copies`` times over."""

    unit: int = 3
    copies: int = 3
    name = "tandem_repeat"

    @property
    def context(self) -> int:
        return self.unit * self.copies - 1

    def found(self, dna):
        u, n = self.unit, self.unit * self.copies
        raw = np.frombuffer(dna.encode("utf-32-le"), np.uint32)
        if len(raw) < n:
            return []
        same = np.concatenate([[0], np.cumsum(raw[u:] == raw[:-u])])
        at = np.flatnonzero(same[n - u :] - same[: len(same) - (n - u)] == n - u)
        return [(a, a + n, f"tandem repeat {dna[a : a + n]}") for a in at.tolist()]

    def spans(self, dna):
        n = self.unit * self.copies
        return [(i, i + n) for i in range(len(dna) - n + 1) if dna[i : i + n] == dna[i : i + self.unit] * self.copies]


@dataclass(frozen=True)
class InvertedRepeat(Rule):
    """A stem of ``stem`` bases, a loop of at most ``loop``, and the stem's reverse complement; one for each start and loop."""

    stem: int = 6
    loop: int = 8
    name = "inverted_repeat"

    @property
    def context(self) -> int:
        return 2 * self.stem + self.loop - 1

    def found(self, dna):
        s, own = self.stem, _words(dna, self.stem)
        if own is None:
            return [(a, b, f"stem {s} loop {b - a - 2 * s}") for a, b in self.spans(dna)]
        other = _words(reverse_complement(dna), s)[::-1]  # the reverse complement of the word at each place
        out = []
        for g in range(self.loop + 1):
            n = len(own) - s - g
            if n > 0:
                out += [(a, a + 2 * s + g, f"stem {s} loop {g}") for a in np.flatnonzero(other[:n] == own[s + g :]).tolist()]
        return out

    def spans(self, dna):
        s = self.stem
        return [(i, i + 2 * s + g) for i in range(len(dna) - 2 * s + 1) for g in range(self.loop + 1) if i + 2 * s + g <= len(dna) and dna[i + s + g : i + 2 * s + g] == reverse_complement(dna[i : i + s])]


@dataclass(frozen=True)
class InternalStart(Rule):
    """ATG at ``least`` or later with a purine at -3 and G at +4; may be relaxed."""

    least: int = 3
    purine: bool = True
    g_after: bool = True
    name = "internal_start"
    relaxable = True
    context = 6

    @property
    def settled(self) -> int:
        return max(self.context, self.least + 3)

    def hits(self, dna: str, before: int = 0) -> list[int]:
        at = (m.start() for m in _pattern("(?=ATG)").finditer(dna))
        return [i for i in at if i + before >= self.least and (not self.purine or (i >= 3 and dna[i - 3] in "AG")) and (not self.g_after or dna[i + 3 : i + 4] == "G")]

    def found(self, dna):
        return [(i, i + 3, f"internal ATG in {('...' + dna + '.')[i : i + 7]}") for i in self.hits(dna)]

    def spans(self, dna):
        return [(i, i + 3) for i in self.hits(dna)]

    def ok_suffix(self, prefix, codon):
        tail = prefix[-self.context :] if prefix else ""
        reach = 4 if self.g_after else 3
        return all(i + reach <= len(tail) for i in self.hits(tail + codon, len(prefix) - len(tail)))


@dataclass(frozen=True)
class PolyaSignal(Rule):
    """A hexamer followed, 10 to 40 bases on, by a slice that is rich in T or in G and T; the first such slice counts."""

    hexamers: tuple[str, ...] = ("AATAAA", "ATTAAA")
    first: int = 10
    last: int = 40
    slice: int = 10
    t: int = 6
    gt: int = 8
    gt_t: int = 3
    name = "polya_signal"

    @property
    def context(self) -> int:
        return max(map(len, self.hexamers)) + self.last - 1

    def found(self, dna):
        return [(a, b, f"functional {h}") for h in self.hexamers for a, b in self._spans(dna, h)]

    def spans(self, dna):
        return [x for h in self.hexamers for x in self._spans(dna, h)]

    def _spans(self, dna: str, hexamer: str) -> list[tuple[int, int]]:
        out = []
        for m in _pattern(f"(?={hexamer})").finditer(dna):
            lo = m.start() + len(hexamer) + self.first
            hi = min(m.start() + len(hexamer) + self.last, len(dna))
            for s in range(lo, hi - self.slice + 1):
                w = dna[s : s + self.slice]
                t, gt = w.count("T"), w.count("T") + w.count("G")
                if t >= self.t or (t >= self.gt_t and gt >= self.gt):
                    out.append((m.start(), s + self.slice))
                    break
        return out


@dataclass(frozen=True)
class Uorf(Rule):
    """An ATG out of the main frame, up to ``region`` bases after the start, and the first stop in its frame."""

    least: int = 3
    region: int | None = 100
    offset: int = 0
    name = "uorf"
    context = UNBOUNDED

    def starts(self, dna: str, before: int = 0) -> list[int]:
        """The places of the ATGs that count, in a sequence that ``before`` bases precede."""
        upto = len(dna) if self.region is None else max(0, self.offset + self.region - before + 2)
        at = (m.start() + before for m in _pattern("(?=ATG)").finditer(dna, 0, min(len(dna), upto)))
        return [a for a in at if (a - self.offset) % 3 and not self.offset <= a < self.offset + self.least]

    def found(self, dna):
        """The first stop of each frame after an ATG, by search among the stops of the frame."""
        stops: list[list[int]] = [[], [], []]
        for m in _pattern("(?=" + "|".join(STOPS) + ")").finditer(dna):
            stops[m.start() % 3].append(m.start())
        out = []
        for a in self.starts(dna):
            s = stops[a % 3]
            i = bisect_left(s, a + 3)
            if i < len(s):
                out.append((a, s[i] + 3, f"uORF in frame {a % 3}"))
        return out

    def spans(self, dna):
        out = []
        for a in range(len(dna) - 2):
            if self.region is not None and a >= self.offset + self.region:
                break
            if dna[a : a + 3] != "ATG" or (a - self.offset) % 3 == 0 or self.offset <= a < self.offset + self.least:
                continue
            stop = next((s for s in range(a + 3, len(dna) - 2, 3) if dna[s : s + 3] in STOPS), None)
            if stop is not None:
                out.append((a, stop + 3))
        return out


@dataclass(frozen=True)
class MaxRepeat(Rule):
    """Words of ``most`` + 1 bases that occur again, equal their reverse complement, or whose reverse complement occurs."""

    most: int = 12
    name = "max_repeat"
    context = UNBOUNDED

    def found(self, dna):
        k = self.most + 1
        own = _words(dna, k)
        if own is None:
            at: dict[str, int] = {}
            for i in range(len(dna) - k + 1):
                at[dna[i : i + k]] = at.get(dna[i : i + k], 0) + 1
            kind = lambda w: "direct" if at[w] > 1 else "palindrome" if w == reverse_complement(w) else "inverted"
            return [(a, b, f"{kind(dna[a:b])}{' repeat' * (kind(dna[a:b]) != 'palindrome')} {dna[a:b]}") for a, b in self.spans(dna)]
        other = _words(reverse_complement(dna), k)[::-1]
        values, back, n = np.unique(own, return_inverse=True, return_counts=True)
        direct, self_ = n[back] > 1, own == other
        inverted = np.isin(other, values)
        hit = np.flatnonzero(direct | inverted)
        name = lambda i: "direct repeat" if direct[i] else "palindrome" if self_[i] else "inverted repeat"
        return [(i, i + k, f"{name(i)} {dna[i : i + k]}") for i in hit.tolist()]

    def spans(self, dna):
        k = self.most + 1
        at: dict[str, int] = {}
        for i in range(len(dna) - k + 1):
            at[dna[i : i + k]] = at.get(dna[i : i + k], 0) + 1
        return [(i, i + k) for i in range(len(dna) - k + 1) if at[dna[i : i + k]] > 1 or reverse_complement(dna[i : i + k]) in at]

    def ok_suffix(self, prefix, codon):
        return len(self.spans(prefix + codon)) == len(self.spans(prefix))


def _longest_repeat(dna: str) -> int:
    """For one sequence with any letters: words twice as wide are pairs of ranks of words, so no word is spelled out.

    Words of half the length of a repeated one repeat too: widths are doubled
    while one repeats, and halved in on from there.
    """
    n = len(dna)
    letters = np.frombuffer((dna + reverse_complement(dna)).encode("utf-32-le"), np.uint32)
    rank = np.unique(letters, return_inverse=True)[1].reshape(2, n)  # of the words of one strand and the other

    def words(k):
        return rank[:, : n - k + 1] * (2 * n) + rank[:, k - width : n - width + 1]

    def again(own, other):
        values = np.unique(own)
        return len(values) < len(own) or bool(np.isin(other, values).any())

    width = 1
    if not n or not again(*rank):
        return 0
    while 2 * width <= n and again(*(twice := words(2 * width))):
        rank = np.unique(twice, return_inverse=True)[1].reshape(twice.shape)
        width *= 2
    lo, hi = width, min(2 * width - 1, n)
    while lo < hi:
        k = (lo + hi + 1) // 2
        lo, hi = (k, hi) if again(*words(k)) else (lo, k - 1)
    return lo


def _bits(letters: np.ndarray) -> np.ndarray:
    """(base, sequence): a number whose i-th bit says that the i-th letter is that base."""
    return np.stack([np.packbits(letters == b, axis=1, bitorder="little").view(f"<u{letters.shape[1] // 8}")[:, 0] for b in range(4)])


def _longest_repeats(r: Run) -> np.ndarray:
    """For sequences of at most 64 bases, all at once: at each shift of a strand against itself or the other, the bases that agree are bits, and a repeat is a run of bits."""
    most = int(r.size.max(initial=0))
    place = np.arange(32 if most <= 32 else 64)
    inside = place < r.size[:, None]
    letters = np.full(inside.shape, 9, dtype=np.int8)
    letters[inside] = r.codes
    turned = np.take_along_axis(letters, np.where(inside, r.size[:, None] - 1 - place, place), axis=1)
    own, other = _bits(letters), _bits(3 - turned)
    same = [np.bitwise_or.reduce(own & (own >> d)) for d in range(1, most)]
    same += [np.bitwise_or.reduce(own & (other >> d)) for d in range(most)] + [np.bitwise_or.reduce(other & (own >> d)) for d in range(1, most)]
    out = np.zeros(len(r.size), dtype=np.int64)
    left = np.array(same, dtype=own.dtype).reshape(len(same), len(out))
    at = np.arange(len(out))
    while len(at):
        some = np.flatnonzero(np.bitwise_or.reduce(left, axis=0))
        if len(some) < len(at):
            at, left = at[some], left[:, some]
        out[at] += 1
        left = left & (left >> 1)
    return out


def longest_repeat(seqs: DataFrame) -> DataFrame:
    """(seq_id, longest): the longest word that occurs twice, also if once as its reverse complement, which may be itself."""

    def run(batch):
        column = batch.column(1).fill_null("")
        whole = Run(column)
        other = np.add.reduceat(np.append(whole.codes > 3, False), whole.first[:-1], dtype=np.int64)
        short = (whole.size <= 64) & ((other == 0) | (whole.size == 0))
        out = np.zeros(len(column), dtype=np.int64)
        out[short] = _longest_repeats(Run(column.filter(pa.array(short))))
        rest = np.flatnonzero(~short)
        out[rest] = [_longest_repeat(dna) for dna in column.take(pa.array(rest)).to_pylist()]
        return None, [pa.array(out, pa.int64())]

    return kernel(seqs, run, "longest long", whole=True)


def tandem_span(seqs: DataFrame, periods: range = range(1, 7)) -> DataFrame:
    """(seq_id, span): the longest stretch that repeats itself at one of the periods, twice the period at least; none has no row."""

    def run(r: Run):
        row = np.repeat(np.arange(len(r.size)), r.size)
        best = np.zeros(len(r.size), dtype=np.int64)
        for p in periods:
            same = np.zeros(len(row) + 1, dtype=bool)
            if len(row) > p:
                same[1 : len(row) - p + 1] = (r.raw[p:] == r.raw[:-p]) & (row[p:] == row[:-p])
            edge = np.flatnonzero(np.diff(np.append(same, False)))  # runs of places that equal the one a period on
            begin, end = edge[::2], edge[1::2]
            long = end - begin >= p
            np.maximum.at(best, row[begin[long]], end[long] - begin[long] + p)
        some = np.flatnonzero(best)
        return some, [best[some]]

    return kernel(seqs, run, "span long")


def seeded(rule: Rule, seqs: DataFrame) -> DataFrame:
    """Violations of a rule on ``dna`` after ``upstream``, as much of it as the rule reads; spans are of the insert, wholly upstream ones go."""
    tail = F.coalesce("upstream", F.lit(""))
    if rule.context < UNBOUNDED:
        tail = F.right(tail, F.lit(rule.context))
    rows = seqs.select(F.struct("seq_id", F.length(tail).alias("lead")).alias("seq_id"), F.concat(tail, "dna").alias("dna"))
    found = rule.violations(rows).select("seq_id.*", "constraint", "severity", "start", "end", "detail").where(F.col("end") > F.col("lead"))
    shifted = F.when(F.col("start") < F.col("lead"), F.concat("detail", F.lit(" (across the junction)"))).otherwise(F.col("detail"))
    return found.select("seq_id", "constraint", "severity", F.greatest(F.lit(0), F.col("start") - F.col("lead")).alias("start"), (F.col("end") - F.col("lead")).alias("end"), shifted.alias("detail"))


def soften(violations: DataFrame, names: list[str]) -> DataFrame:
    return violations.withColumn("severity", F.when(F.col("constraint").isin(names), "SOFT").otherwise(F.col("severity")))


def validate(seqs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The violations of all rules, from one pass over the sequences."""
    rules = list(rules)
    names = [r.name for r in rules]

    def run(batch):
        row, which, start, end, detail = [], [], [], [], []
        for i, dna in enumerate(batch.column(1).to_pylist()):
            for j, rule in enumerate(rules if dna else ()):
                for a, b, d in rule.found(dna):
                    row.append(i)
                    which.append(j)
                    start.append(a)
                    end.append(b)
                    detail.append(d)
        name = pa.array(names, pa.string()).take(pa.array(which, pa.int64()))
        return np.array(row, dtype=np.int64), [name, pa.array(["HARD"] * len(row), pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(detail, pa.string())]

    return kernel(seqs, run, "constraint string, severity string, start int, end int, detail string", whole=True)


def residual_audit(seqs: DataFrame, violations: DataFrame, names: list[str]) -> DataFrame:
    """(seq_id, constraint, n, status) for every sequence and each constraint named: clean, or partial where violations are left."""
    n = violations.groupBy("seq_id", "constraint").agg(F.count(F.lit(1)).alias("n"))
    every = seqs.select("seq_id", F.explode(F.array(*[F.lit(x) for x in names])).alias("constraint"))
    out = every.join(n, ["seq_id", "constraint"], "left").select("seq_id", "constraint", F.coalesce("n", F.lit(0)).alias("n"))
    return out.withColumn("status", F.when(F.col("n") == 0, "clean").otherwise("partial"))


def counts(seqs: DataFrame, violations: DataFrame) -> DataFrame:
    """(seq_id, hard, soft) with zeros for clean sequences."""
    n = violations.groupBy("seq_id").agg(F.count_if(F.col("severity") == "HARD").alias("hard"), F.count_if(F.col("severity") == "SOFT").alias("soft"))
    return seqs.select("seq_id").join(n, "seq_id", "left").na.fill(0, ["hard", "soft"])


def unmasked(violations: DataFrame, masks: DataFrame) -> DataFrame:
    """Violations not wholly inside a mask(seq_id, mask_start, mask_end)."""
    inside = (violations["seq_id"] == masks["seq_id"]) & (violations["start"] >= masks["mask_start"]) & (violations["end"] <= masks["mask_end"])
    return violations.join(masks, inside, "left_anti")


def merged(violations: DataFrame) -> DataFrame:
    """Overlapping or touching spans of one constraint and severity as one, with their number and the first one's detail."""
    order = W.partitionBy("seq_id", "constraint", "severity").orderBy("start", "end", "detail")
    before = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = violations.withColumn("new", F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0))
    rows = rows.withColumn("island", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    keys = ["seq_id", "constraint", "severity", "island"]
    return rows.groupBy(*keys).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n"), F.min_by("detail", F.struct("start", "end", "detail")).alias("detail")).drop("island")

"""Objective terms: anything with a name, a context and a value for each codon can be weighed against the others.

A term says what a codon adds after the bases before it. It is used by the
solvers through ``Objective``, and scores whole sequences by summing up the
same values, so what is reported is what was optimised.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Protocol, runtime_checkable

from strandweave.core.genetic import CODE

_FREE = {c: a not in "MW*" for c, a in CODE.items()}


@runtime_checkable
class Term(Protocol):
    """``context``: the bases before a codon that ``delta`` reads; ``positional``: whether it reads the codon's place."""

    name: str
    context: int
    positional: bool

    def delta(self, codon: str, before: str, place: int) -> float: ...


@dataclass(frozen=True)
class CodonWeight:
    """A value for each codon, such as a log weight; fixed amino acids add nothing unless ``every``."""

    name: str
    value: dict[str, float] = field(hash=False)
    every: bool = False
    context = 0
    positional = False

    def delta(self, codon, before, place):
        return self.value.get(codon, 0.0) if self.every or _FREE[codon] else 0.0


def cai_logw(log_w: dict[str, float]) -> CodonWeight:
    return CodonWeight("cai_logw", log_w)


def tai_logw(w: dict[str, float]) -> CodonWeight:
    """Log weights of the codons that tAI scores; others add nothing."""
    return CodonWeight("tai_logw", {c: math.log(v) for c, v in w.items()}, True)


def minmax(over: dict[str, float]) -> CodonWeight:
    """What a codon's share is over its family's mean; negated, it asks for rare codons."""
    return CodonWeight("minmax", over)


@dataclass(frozen=True)
class GcProximity:
    target: float = 0.5
    name = "gc_proximity"
    context = 0
    positional = False

    def delta(self, codon, before, place):
        return -((sum(c in "GC" for c in codon) / 3 - self.target) ** 2)


@dataclass(frozen=True)
class Pair:
    """Occurrences of a dinucleotide, across codon borders too, counted at their second base; -1 for each, or +1."""

    pair: str = "CG"
    sign: int = -1
    context = 1
    positional = False

    @property
    def name(self) -> str:
        return f"dinucleotide_{self.pair}"

    def delta(self, codon, before, place):
        text = before[-1:] + codon
        return float(self.sign * sum(text[i : i + 2] == self.pair for i in range(len(text) - 1)))


@dataclass(frozen=True)
class CodonPair:
    """Scores of adjacent codons; unknown pairs add nothing."""

    score: dict[tuple[str, str], float] = field(hash=False)
    name = "codon_pair"
    context = 3
    positional = False

    def delta(self, codon, before, place):
        return self.score.get((before[-3:], codon), 0.0) if len(before) >= 3 else 0.0


@dataclass(frozen=True)
class Ramp:
    """Slow codons at the start: minus the weight, less and less over the first ``length`` codons."""

    w: dict[str, float] = field(hash=False)
    length: int = 35
    name = "ramp"
    context = 0
    positional = True

    def delta(self, codon, before, place):
        return -self.w[codon] * max(0.0, 1 - place / self.length) if _FREE[codon] else 0.0


def term_score(term: Term, dna: str) -> float:
    """The sum of a term over a whole sequence."""
    return math.fsum(term.delta(dna[i : i + 3], dna[max(0, i - term.context) : i], i // 3) for i in range(0, len(dna) - 2, 3))


@dataclass(frozen=True)
class Objective:
    """Weighted terms in integer micro-units, so that ties are the same everywhere."""

    terms: tuple[tuple[Term, float], ...]

    @property
    def context(self) -> int:
        return max((t.context for t, w in self.terms if w), default=0)

    @property
    def positional(self) -> bool:
        return any(t.positional for t, w in self.terms if w)

    def micro(self, codon: str, before: str = "", place: int = 0) -> int:
        return round(sum(w * t.delta(codon, before, place) for t, w in self.terms if w) * 1_000_000)

    def total(self, dna: str) -> int:
        return sum(self.micro(dna[i : i + 3], dna[:i][-self.context :] if self.context else "", i // 3) for i in range(0, len(dna) - 2, 3))

    def vector(self, dna: str) -> dict[str, float]:
        """Each term of a sequence by name; larger is better."""
        return {t.name: term_score(t, dna) for t, _ in self.terms}


def weights(log_w: dict[str, float], cai: float = 1.0, gc: float = 0.0, gc_target: float = 0.5, cpg: float = 0.0) -> Objective:
    """Codon adaptation, GC proximity and CpG avoidance."""
    return Objective(((cai_logw(log_w), cai), (GcProximity(gc_target), gc), (Pair("CG"), cpg)))

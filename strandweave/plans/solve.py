"""Constrained back-translation: per-protein kernels run as partitioned batches.

A kernel solves one protein in plain Python and NumPy; ``mapInPandas`` runs it
over proteins(seq_id, protein) in small Arrow batches, so memory follows one
protein, proteins spread over tasks, and an infeasible one gives a status, not
an error. Reported figures are recomputed from the delivered sequence.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.core.genetic import CODE, SYNONYMS
from strandweave.core.session import ship
from strandweave.operators.rules import UNBOUNDED, Rule
from strandweave.plans.objectives import Objective, weights as Weights

MOST_POINTS = 60
MOST_CONTEXTS = 100_000  #: contexts of a layer beyond which the graph is not held
_NONE = -(1 << 62)


@dataclass
class Solution:
    dna: str = ""
    score: int = 0
    status: str = "infeasible"
    culprits: list[str] = field(default_factory=list)
    relaxed: list[str] = field(default_factory=list)
    refined: list[str] = field(default_factory=list)  #: rules left to annealing


def _better(score: int, dna: str, old: tuple[int, str] | None) -> bool:
    return old is None or score > old[0] or (score == old[0] and dna < old[1])


class TooWide(Exception):
    """A layer has more contexts than the graph may hold."""


class Structure:
    """What a protein's codons can follow under rules: a graph of contexts, layer by layer, that any objective is solved on.

    A context is the last bases that a rule or the objective reads. Vetoes are
    asked once for each context and codon, however many objectives follow.
    """

    def __init__(self, protein: str, rules: Iterable[Rule] = (), context: int = 0, most: int = MOST_CONTEXTS):
        rules = list(rules)
        self.context = k = max([context, *(r.context for r in rules)])
        if k >= UNBOUNDED:
            raise ValueError("a rule without bounded context cannot be solved exactly")
        settled = max([k, *(r.settled for r in rules)])
        self.culprits: list[str] = []
        self.layers: list[tuple[list[str], np.ndarray, np.ndarray, list[str]]] = []  # contexts, edges' sources and targets, their codons
        known: dict[tuple[str, str], bool] = {}
        contexts = [""]
        for place, aa in enumerate(protein + "*"):
            codons, sure = SYNONYMS.get(aa, []), 3 * place >= settled
            pad = "N" * (3 * place - len(contexts[0])) if contexts and not sure else "N" * settled
            source, target, used, index = [], [], [], {}
            for i, ctx in enumerate(contexts):
                for codon in codons:
                    ok = known.get((ctx, codon)) if sure else None
                    if ok is None:
                        prefix = pad + ctx if sure or len(ctx) < 3 * place else ctx
                        ok = all(r.ok_suffix(prefix, codon) for r in rules)
                        if sure:
                            known[ctx, codon] = ok
                    if ok:
                        new = (ctx + codon)[-k:] if k else ""
                        source.append(i)
                        target.append(index.setdefault(new, len(index)))
                        used.append(codon)
            if not index:
                prefixes = [pad + ctx if sure or len(ctx) < 3 * place else ctx for ctx in contexts]
                self.culprits = sorted({r.name for p in prefixes for c in codons for r in rules if not r.ok_suffix(p, c)})
                self.layers = []
                return
            if len(index) > most:
                raise TooWide
            self.layers.append((contexts, np.array(source), np.array(target), used))
            contexts = list(index)

    def solve(self, objective: Objective) -> Solution:
        """The best sequence for an objective that reads no more context than the graph has; ties go to the smaller DNA."""
        if not self.layers:
            return Solution(culprits=self.culprits)
        values: dict[tuple, int] = {}
        reads, place_matters = objective.context, objective.positional
        ahead, chosen = None, []
        for place in reversed(range(len(self.layers))):
            contexts, source, target, codons = self.layers[place]
            value = np.empty(len(codons), dtype=np.int64)
            for e, (i, codon) in enumerate(zip(source.tolist(), codons, strict=True)):
                before = contexts[i][-reads:] if reads else ""
                key = (before, codon, place) if place_matters else (before, codon)
                if key not in values:
                    values[key] = objective.micro(codon, before, place)
                value[e] = values[key]
            if ahead is not None:
                value = np.where(ahead[target] > _NONE, value + ahead[target], _NONE)
            best = np.full(len(contexts), _NONE, dtype=np.int64)
            np.maximum.at(best, source, value)
            first = np.full(len(contexts), -1, dtype=np.int64)
            hits = np.flatnonzero((value == best[source]) & (value > _NONE))[::-1]
            first[source[hits]] = hits  # the least codon of each context comes last here
            ahead = best
            chosen.append(first)
        if ahead[0] <= _NONE:
            return Solution(culprits=self.culprits)
        at, dna = 0, []
        for (_, _, target, codons), first in zip(self.layers, reversed(chosen), strict=True):
            e = int(first[at])
            dna.append(codons[e])
            at = int(target[e])
        return Solution("".join(dna), int(ahead[0]), "proven_optimal")


def trellis(protein: str, weights: Objective, rules: Iterable[Rule] = (), beam: int | None = None) -> Solution:
    """The best sequence by dynamic programming over the last bases that any rule reads; ties go to the smaller DNA.

    Proven optimal unless a beam cut a layer. Rules without bounded context
    do not belong here; ``optimize`` sends those to ``refine``.
    """
    rules = list(rules)
    if beam is None:
        try:
            return Structure(protein, rules, weights.context).solve(weights)
        except TooWide:
            pass  # layer by layer, without holding the graph
    return layered(protein, weights, rules, beam)


def layered(protein: str, weights: Objective, rules: Iterable[Rule] = (), beam: int | None = None) -> Solution:
    """``trellis`` with one layer in memory, cut to the ``beam`` best states if asked."""
    rules = list(rules)
    k = max([weights.context, *(r.context for r in rules)])
    if k >= UNBOUNDED:
        raise ValueError("a rule without bounded context cannot be solved exactly")
    states: dict[str, tuple[int, str]] = {"": (0, "")}
    cut = False
    for place, aa in enumerate(protein + "*"):
        layer: dict[str, tuple[int, str]] = {}
        vetoes: set[str] = set()
        for score, dna in states.values():
            for codon in SYNONYMS.get(aa, []):
                broken = [r.name for r in rules if not r.ok_suffix(dna, codon)]
                if broken:
                    vetoes.update(broken)
                    continue
                new = (score + weights.micro(codon, dna, place), dna + codon)
                key = new[1][-k:] if k else ""
                if _better(*new, layer.get(key)):
                    layer[key] = new
        if not layer:
            return Solution(culprits=sorted(vetoes))
        if beam is not None and len(layer) > beam:
            cut = True
            layer = dict(sorted(layer.items(), key=lambda kv: (-kv[1][0], kv[1][1]))[:beam])
        states = layer
    score, dna = min(states.values(), key=lambda s: (-s[0], s[1]))
    return Solution(dna, score, "beam_truncated" if cut else "proven_optimal")


def budgeted(protein: str, weights: Objective, low: int, high: int, amount: Callable[[str, str], int], context: int, rules: Iterable[Rule] = (), beam: int | None = None) -> Solution:
    """As ``trellis`` with a global amount (GC bases, dinucleotides) held within [low, high]; states that cannot reach the range are cut."""
    rules = list(rules)
    k = max([weights.context, context, *(r.context for r in rules)])
    residues = protein + "*"
    least, most = [0] * (len(residues) + 1), [0] * (len(residues) + 1)
    edge = ["", *"ACGT"] if context else [""]
    for i in reversed(range(len(residues))):
        found = [amount(e, c) for c in SYNONYMS.get(residues[i], []) for e in edge] or [0]
        least[i], most[i] = least[i + 1] + min(found), most[i + 1] + max(found)
    states: dict[tuple[str, int], tuple[int, str]] = {("", 0): (0, "")}
    cut = False
    for i, aa in enumerate(residues):
        layer: dict[tuple[str, int], tuple[int, str]] = {}
        for (_, used), (score, dna) in states.items():
            for codon in SYNONYMS.get(aa, []):
                now = used + amount(dna[-context:] if context else "", codon)
                if now + least[i + 1] > high or now + most[i + 1] < low or not all(r.ok_suffix(dna, codon) for r in rules):
                    continue
                new = (score + weights.micro(codon, dna, i), dna + codon)
                key = (new[1][-k:] if k else "", now)
                if _better(*new, layer.get(key)):
                    layer[key] = new
        if not layer:
            return Solution(status="infeasible", culprits=["budget", *(r.name for r in rules)])
        if beam is not None and len(layer) > beam:
            cut = True
            layer = dict(sorted(layer.items(), key=lambda kv: (-kv[1][0], kv[1][1]))[:beam])
        states = layer
    score, dna = min(states.values(), key=lambda s: (-s[0], s[1]))
    return Solution(dna, score, "beam_truncated" if cut else "proven_optimal")


def gc_amount(before: str, codon: str) -> int:
    return sum(c in "GC" for c in codon)


def pair_amount(pair: str) -> Callable[[str, str], int]:
    return lambda before, codon: sum((before[-1:] + codon)[i : i + 2] == pair for i in range(len(before[-1:] + codon) - 1))


def relaxing(protein: str, weights: Objective, rules: Iterable[Rule], beam: int | None = None) -> Solution:
    """``trellis``; if no sequence exists, once more without the culprits that may be relaxed, saying so."""
    rules = list(rules)
    first = trellis(protein, weights, rules, beam)
    soft = [r for r in rules if r.name in first.culprits and getattr(r, "relaxable", False)]
    if first.status != "infeasible" or not soft:
        return first
    out = trellis(protein, weights, [r for r in rules if r not in soft], beam)
    if out.status != "infeasible":
        out.status, out.relaxed = "relaxed", sorted(r.name for r in soft)
    return out


def sample(protein: str, usage: dict[str, float], rules: Iterable[Rule], n: int, seed: int, temperature: float = 1.0, restarts: int = 128) -> list[str]:
    """``n`` feasible sequences, each codon drawn by usage ** (1 / temperature) among those that the rules allow."""
    rules, out = list(rules), []
    for member in range(n):
        rng = random.Random(seed * 1_000_003 + member)
        for _ in range(restarts):
            dna = ""
            for aa in protein + "*":
                ok = [c for c in SYNONYMS.get(aa, []) if all(r.ok_suffix(dna, c) for r in rules)]
                if not ok:
                    break
                top = max(usage.get(c, 0.0) for c in ok)
                share = [(usage.get(c, 0.0) / top) ** (1 / temperature) if top > 0 else 1.0 for c in ok]
                dna += rng.choices(ok, share)[0]
            else:
                out.append(dna)
                break
    return out


def _codons(dna: str) -> list[str]:
    return [dna[i : i + 3] for i in range(0, len(dna), 3)]


class _Chain:
    """One annealing chain: codons, their score, and the violations of rules that read the whole sequence."""

    def __init__(self, dna: str, weights: Objective, local: list[Rule], whole: list[Rule], extra):
        self.codons, self.weights, self.local, self.whole, self.extra = _codons(dna), weights, local, whole, extra
        self.reach = math.ceil(max([0, *(r.context for r in local)]) / 3)
        self.echo = math.ceil(weights.context / 3)
        self.own, self.count = weights.total(dna), self.violations(dna)
        self.score = self.own + (extra(dna) if extra else 0)

    def violations(self, dna: str) -> int:
        return sum(len(r.found(dna)) for r in self.whole)

    def allowed(self, codons: list[str], places: list[int]) -> bool:
        """Whether the codons whose context reaches a changed place break no local rule."""
        if not self.local:
            return True
        near = sorted({q for p in places for q in range(p, min(len(codons), p + self.reach + 1))})
        for q in near:
            before = "".join(codons[max(0, q - self.reach) : q])
            before = "N" * (3 * max(0, q - self.reach)) + before if q > self.reach else before
            if not all(r.ok_suffix(before, codons[q]) for r in self.local):
                return False
        return True

    def worth(self, codons: list[str], places: Iterable[int]) -> int:
        w, e = self.weights, self.echo
        near = sorted({q for p in places for q in range(p, min(len(codons), p + e + 1))})
        return sum(w.micro(codons[q], "".join(codons[max(0, q - e) : q]), q) for q in near)

    def step(self, free: list[int], heat: float, rng: random.Random, block: int, block_share: float) -> bool:
        """One proposal of a swap, or of several at once; whether it was taken."""
        many = 1
        if block > 1 and len(free) > 1 and block_share > 0 and rng.random() < block_share:
            many = rng.randint(2, min(block, len(free)))
        places = sorted(rng.sample(free, many))
        trial = list(self.codons)
        for p in places:
            trial[p] = rng.choice([c for c in SYNONYMS[CODE[trial[p]]] if c != trial[p]])
        if not self.allowed(trial, places):
            return False
        dna = "".join(trial) if self.whole or self.extra else ""
        count = self.violations(dna) if self.whole else 0
        if count > self.count:
            return False
        own = self.own + self.worth(trial, places) - self.worth(self.codons, places)
        score = own + (self.extra(dna) if self.extra else 0)
        gain = score - self.score
        if count == self.count and gain < 0 and (heat <= 0 or rng.random() >= math.exp(max(-700.0, gain / 1e6 / heat))):
            return False
        self.codons, self.own, self.score, self.count = trial, own, score, count
        return True

    def swap(self, other: _Chain) -> None:
        for name in ("codons", "own", "score", "count"):
            mine = getattr(self, name)
            setattr(self, name, getattr(other, name))
            setattr(other, name, mine)


def refine(dna: str, weights: Objective, local: Iterable[Rule], whole: Iterable[Rule], seed: int = 0, steps: int = 2000, start: float = 1.0, cooling: float = 0.995, block: int = 1, block_share: float = 0.0, heats: Sequence[float] | None = None, swap_every: int = 0, extra: Callable[[str], int] | None = None) -> Solution:
    """Seeded annealing by synonymous swaps: the number of violations of ``whole`` never rises and ``local`` rules stay clean; status heuristic.

    Only codons whose context reaches a swap are judged again. A share
    ``block_share`` of the steps swaps 2 to ``block`` codons at once. With
    ``heats`` there are as many chains, each from its own heat, and every
    ``swap_every`` steps neighbours may trade places (parallel tempering).
    ``extra`` adds a term of the whole sequence, in micro-units. A start that
    breaks a local rule is refused with a ValueError.
    """
    local, whole, rng = list(local), list(whole), random.Random(seed)
    if any(r.found(dna) for r in local):
        raise ValueError("the start breaks a local rule")
    heats = [start] if heats is None else list(heats)
    chains = [_Chain(dna, weights, local, whole, extra) for _ in heats]
    best = (chains[0].count, -chains[0].score, dna)
    free = [i for i, c in enumerate(chains[0].codons) if len(SYNONYMS[CODE[c]]) > 1]
    for turn in range(steps if free else 0):
        for i, chain in enumerate(chains):
            if chain.step(free, heats[i], rng, block, block_share) and (chain.count, -chain.score) < best[:2]:
                best = (chain.count, -chain.score, "".join(chain.codons))
            heats[i] *= cooling
        if swap_every and (turn + 1) % swap_every == 0:
            for a, b, x, y in zip(chains, chains[1:], heats, heats[1:], strict=False):
                if x > 0 and y > 0:
                    edge = (1 / x - 1 / y) * (b.score - a.score) / 1e6
                    if edge >= 0 or rng.random() < math.exp(max(-700.0, edge)):
                        a.swap(b)
    return Solution(best[2], -best[1], "heuristic")


def optimize(protein: str, weights: Objective, rules: Iterable[Rule], beam: int | None = None, widest_window: int = 12, widest: int = 40, seed: int = 0, steps: int = 2000, always: bool = False) -> Solution:
    """Rules of bounded context exactly; the others by refinement where the exact answer breaks them.

    Rules that read ``widest`` bases or more, and GC windows that read
    ``widest_window`` or more, count as unbounded, as their graphs grow with
    the number of contexts. ``refined`` of the result names the rules that
    were left to annealing; without any the answer is proven. ``always`` anneals
    even a clean answer.
    """
    rules = list(rules)
    exact = [r for r in rules if r.context < (widest_window if r.name == "gc_window" else widest)]
    other = [r for r in rules if r not in exact]
    out = relaxing(protein, weights, exact, beam)
    if out.status == "infeasible" or not (always or any(r.found(out.dna) for r in other)):
        return out
    better = refine(out.dna, weights, [r for r in exact if r.name not in out.relaxed], other, seed, steps)
    better.relaxed, better.refined = out.relaxed, sorted(r.name for r in other)
    return better


def simplex(axes: int, steps: int, most: int = MOST_POINTS) -> list[tuple[float, ...]]:
    """Weight vectors at the compositions of steps - 1, coarser until there are at most ``most``."""
    if axes < 1:
        return []
    if steps <= 1:
        return [(1.0 / axes,) * axes]
    while steps > 2 and math.comb(steps + axes - 2, axes - 1) > most:
        steps -= 1

    def parts(total: int, n: int):
        if n == 1:
            yield (total,)
            return
        for head in range(total + 1):
            yield from ((head, *rest) for rest in parts(total - head, n - 1))

    return [tuple(c / (steps - 1) for c in p) for p in parts(steps - 1, axes)]


#: Weights of the base pairs of the folding proxy.
PAIR_WEIGHT = {"GC": 3.0, "CG": 3.0, "AT": 2.0, "TA": 2.0, "GT": 1.0, "TG": 1.0}


def fold_proxy(dna: str, window: int | None = 48, loop: int = 3) -> float:
    """Minus the greatest weight of nested base pairs of the first ``window`` bases, with at least ``loop`` bases in a hairpin."""
    s = dna[:window] if window else dna
    n = len(s)
    best = [[0.0] * (n + 1) for _ in range(n + 2)]
    for i in range(n - 1, -1, -1):
        for j in range(i + loop + 1, n):
            top = best[i + 1][j]
            for k in range(i + loop + 1, j + 1):
                w = PAIR_WEIGHT.get(s[i] + s[k])
                if w:
                    top = max(top, w + best[i + 1][k - 1] + best[k + 1][j])
            best[i][j] = top
    return -best[0][n - 1] if n and best[0][n - 1] else 0.0


def fold_proxies(dna: list[str], window: int | None = 48, loop: int = 3) -> np.ndarray:
    """``fold_proxy`` of many sequences, in blocks of similar length whose tables have 4 million cells (a longer sequence is its own block).

    Bases behind a shorter sequence's end pair with none, so they change
    nothing. The weights are whole numbers, held in the narrowest type; no pair
    counts 0, which never beats leaving the base out.
    """
    rows = [s[:window] if window else s for s in dna]
    size = np.array([len(s) for s in rows], dtype=np.int64)
    order, out, at = np.argsort(size, kind="stable"), np.zeros(len(rows)), 0
    while at < len(order):
        most = size[order[at:]]
        fits = np.arange(1, len(most) + 1) * (most + 2) ** 2 <= _FOLD_CELLS
        some = order[at : at + max(1, int(fits.cumprod().sum()))]
        out[some] = _folded_block([rows[i] for i in some], int(size[some[-1]]), loop)
        at += len(some)
    return out


_FOLD_CELLS = 1 << 22
_PAIRS = np.zeros((128, 128), dtype=np.uint8)
for _pair, _weight in PAIR_WEIGHT.items():
    _PAIRS[ord(_pair[0]), ord(_pair[1])] = _weight


def _folded_block(rows: list[str], n: int, loop: int) -> np.ndarray:
    """Energies of sequences of up to ``n`` bases: ``best[i, j]`` is of bases i to j - 1, for all sequences at once."""
    if not n:
        return np.zeros(len(rows))
    s = np.frombuffer("".join(x.ljust(n, "\0") for x in rows).encode("ascii", "replace"), np.uint8).reshape(len(rows), n).T
    kind = np.uint8 if 3 * n < 512 else np.uint16 if 3 * n < 1 << 17 else np.uint32
    best = np.zeros((n + 1, n + 1, len(rows)), dtype=kind)
    is_base = [np.where(s == ord(b), np.uint8(255), np.uint8(0)) for b in "ACGT"]
    with_base = [_PAIRS[ord(b)][s] for b in "ACGT"]
    other = np.empty_like(best[0])
    for i in range(n - 1, -1, -1):
        best[i] = best[i + 1]
        after = slice(i + loop + 1, n)
        weights = np.bitwise_or.reduce([here[after] & pair[i] for here, pair in zip(is_base, with_base, strict=True)])
        pairs = (weights + best[i + 1, after]) * (weights > 0)
        for k, pair in enumerate(pairs, i + loop + 1):
            np.add(best[k + 1, k + 1 :], pair, out=other[k + 1 :])
            np.maximum(best[i, k + 1 :], other[k + 1 :], out=best[i, k + 1 :])
    return 0.0 - best[0, n]


_RESULT = "seq_id long, point int, dna string, score long, status string, culprits array<string>, relaxed array<string>, refined array<string>"


def solve_batch(proteins: DataFrame, solve: Callable[[str], list[Solution]]) -> DataFrame:
    """``solve`` for every protein; one row for each solution, numbered from 0. Null and invalid proteins get status invalid."""
    ship(proteins.sparkSession)
    valid = set("ACDEFGHIKLMNPQRSTVWY")

    def run(batches):
        for pdf in batches:
            rows = []
            for seq_id, protein in zip(pdf["seq_id"], pdf["protein"], strict=True):
                good = isinstance(protein, str) and protein and set(protein) <= valid
                for i, s in enumerate(solve(protein) if good else [Solution(status="invalid")]):
                    rows.append((seq_id, i, s.dna or None, s.score, s.status, s.culprits, s.relaxed, s.refined))
            yield pd.DataFrame(rows, columns=["seq_id", "point", "dna", "score", "status", "culprits", "relaxed", "refined"])

    parts = int(proteins.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return proteins.select("seq_id", "protein").repartition(parts, "seq_id").mapInPandas(run, _RESULT)


def optimize_local(proteins: DataFrame, log_w: dict[str, float]) -> DataFrame:
    """Without rules every residue is on its own: the best codon is a lookup, so the whole plan is one expression."""
    best = {aa: min(cs, key=lambda c: (-round(log_w[c] * 1e6) if aa not in "MW*" else 0, c)) for aa, cs in SYNONYMS.items()}
    table = F.create_map(*[F.lit(x) for pair in sorted(best.items()) for x in pair])
    letters = F.split(F.concat("protein", F.lit("*")), "")
    return proteins.select("seq_id", F.array_join(F.transform(letters, lambda a: F.try_element_at(table, a)), "").alias("dna"))


def frontier(proteins: DataFrame, log_w: dict[str, float], rules: Iterable[Rule] = (), steps: int = 5, gc_target: float = 0.5) -> DataFrame:
    """Every weighting of CAI and GC of a protein on one graph of contexts; equal designs once, then the non-dominated ones and the chosen one."""
    rules = list(rules)
    grid = simplex(2, steps)

    def solve(protein):
        try:
            graph = Structure(protein, rules)
        except TooWide:
            return [layered(protein, Weights(log_w, a, b, gc_target), rules) for a, b in grid]
        return [graph.solve(Weights(log_w, a, b, gc_target)) for a, b in grid]

    pure = {c: (log_w[c] if CODE[c] not in "MW*" else 0.0) for c in CODE}
    points = solve_batch(proteins, solve).where("dna is not null").groupBy("seq_id", "dna").agg(F.min("point").alias("point"))
    table = F.create_map(*[F.lit(x) for pair in sorted(pure.items()) for x in pair])
    cod = F.transform(F.sequence(F.lit(0), (F.length("dna") / 3 - 1).cast("int")), lambda i: F.substring("dna", i * 3 + 1, F.lit(3)))
    total = lambda f: F.aggregate(cod, F.lit(0.0), lambda a, c: a + f(c))
    gc = lambda c: (F.length(c) - F.length(F.translate(c, "GC", ""))) / F.lit(3.0)
    points = points.withColumn("cai_logw", F.round(total(lambda c: F.try_element_at(table, c)), 9)).withColumn("gc_proximity", F.round(total(lambda c: -(gc(c) - gc_target) * (gc(c) - gc_target)), 9))
    return pareto(points, ["seq_id"], ["cai_logw", "gc_proximity"])


def pareto(points: DataFrame, by: list[str], axes: list[str]) -> DataFrame:
    """``points`` with is_front (nothing is as good on all axes and better on one) and is_chosen (the best first axis of the front)."""
    from pyspark.sql import Window as W

    q = points.select(*by, *[F.col(a).alias(f"q_{a}") for a in axes]).distinct()
    p = points
    better = None
    for a in axes:
        strict = F.col(f"q_{a}") > F.col(a)
        better = strict if better is None else better | strict
    cond = better
    for a in axes:
        cond = cond & (F.col(f"q_{a}") >= F.col(a))
    for b in by:
        cond = cond & (p[b] == q[b])
    front = p.join(q, cond, "left_anti").withColumn("is_front", F.lit(True))
    rest = p.join(q, cond, "left_semi").withColumn("is_front", F.lit(False))
    order = W.partitionBy(*by).orderBy(F.col("is_front").desc(), F.col(axes[0]).desc(), "dna")
    return front.unionByName(rest).withColumn("is_chosen", F.row_number().over(order) == 1)


def mean_hamming(library: DataFrame) -> DataFrame:
    """(seq_id, members, distinct_members, mean_hamming): from base counts at each position, without forming pairs."""
    from strandweave.operators.positions import kmers

    base = kmers(library.select("seq_id", "dna"), 1).groupBy("seq_id", "pos", "kmer").count().groupBy("seq_id", "pos").agg((F.pow(F.sum("count"), F.lit(2)) - F.sum(F.col("count") * F.col("count"))).alias("d"), F.sum("count").alias("n"))
    per = base.groupBy("seq_id").agg((F.sum(F.col("d") / 2) / (F.count(F.lit(1)) * F.max(F.when(F.col("n") > 1, F.col("n") * (F.col("n") - 1) / 2).otherwise(1)))).alias("mean_hamming"))
    n = library.groupBy("seq_id").agg(F.count(F.lit(1)).alias("members"), F.count_distinct("dna").alias("distinct_members"))
    return n.join(per, "seq_id")

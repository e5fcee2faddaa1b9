"""Rules over sequences that arrive in pieces.

State of a sequence is its offset, the last bases that the rule reads, and
what is still open: the run it ends in, or the starts that wait for a stop. It
is bounded by the rule, not by the sequence. What comes out equals the batch
violations of the joined pieces; a run is told when it ends, or with the piece
marked last. Rules that compare the whole sequence with itself are refused.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandweave.core.genetic import STOPS
from strandweave.core.session import ship
from strandweave.operators.rules import UNBOUNDED, GcRun, Homopolymer, Rule, Uorf

_OUT = "seq_id long, constraint string, severity string, start long, end long"
_EVENT = re.compile("(?=ATG|" + "|".join(STOPS) + ")")


def _windows(rule: Rule, offset: int, tail: str, held: str, dna: str, last: bool):
    text, base = tail + dna, offset - len(tail)
    found = [(base + a, base + b) for a, b in rule.spans(text) if b > len(tail)]
    return found, text[max(0, len(text) - rule.context) :], ""


def _runs(rule: Homopolymer | GcRun, offset: int, tail: str, held: str, dna: str, last: bool):
    """``tail`` is the letter of the open run (S for G or C) and ``held`` its length."""
    found, size = [], int(held or 0)

    def close(at: int) -> None:
        if tail and size > rule.most:
            found.append((at - size, at))

    for m in re.finditer(r"(.)\1*" if isinstance(rule, Homopolymer) else "[GC]+|[^GC]+", dna):
        letter = m.group(1) if isinstance(rule, Homopolymer) else "S" if m.group()[0] in "GC" else "-"
        if letter == tail:
            size += m.end() - m.start()
            continue
        if tail != "-":
            close(offset + m.start())
        tail, size = letter, m.end() - m.start()
    if last:
        if tail != "-":
            close(offset + len(dna))
        tail, size = "", 0
    return found, tail, str(size)


def _starts(rule: Uorf, offset: int, tail: str, held: str, dna: str, last: bool):
    """``held`` lists the starts that wait for a stop; the rule's region bounds them."""
    text, base, found = tail + dna, offset - len(tail), []
    open_ = [int(x) for x in held.split(",") if x]
    for m in _EVENT.finditer(text):
        at = base + m.start()
        if text.startswith("ATG", m.start()):
            if rule.starts(text[m.start() : m.start() + 3], at) and (rule.region is None or at < rule.offset + rule.region):
                open_.append(at)
            continue
        done = [a for a in open_ if a % 3 == at % 3]
        found += [(a, at + 3) for a in done]
        open_ = [a for a in open_ if a % 3 != at % 3]
    return found, text[-2:], ",".join(map(str, open_))


def monitor(pieces: DataFrame, rule: Rule) -> DataFrame:
    """Violations as pieces(seq_id, part, dna) arrive; within a trigger pieces are taken in the order of ``part``.

    A boolean column ``last`` marks the final piece of a sequence; without it
    a run at the very end is not told.
    """
    if isinstance(rule, (Homopolymer, GcRun)):
        step_of = _runs
    elif isinstance(rule, Uorf) and rule.region is not None:
        step_of = _starts
    elif rule.context < UNBOUNDED:
        step_of = _windows
    else:
        raise ValueError(f"{rule.name} has no bounded state and cannot be monitored")
    ship(pieces.sparkSession)
    rows = pieces.select("seq_id", "part", "dna", F.col("last") if "last" in pieces.columns else F.lit(False).alias("last"))

    def step(key, batches, state: GroupState):
        offset, tail, held = state.get if state.exists else (0, "", "")
        out = []
        for dna, last in pd.concat(list(batches)).sort_values("part")[["dna", "last"]].itertuples(index=False):
            dna = dna.upper() if isinstance(dna, str) else ""
            if dna or last:
                found, tail, held = step_of(rule, offset, tail, held, dna, bool(last))
                out += [(key[0], rule.name, "HARD", a, b) for a, b in found]
                offset += len(dna)
        state.update((offset, tail, held))
        yield pd.DataFrame(out, columns=["seq_id", "constraint", "severity", "start", "end"])

    return rows.groupBy("seq_id").applyInPandasWithState(step, _OUT, "offset long, tail string, held string", "append", GroupStateTimeout.NoTimeout)

"""Scoring models behind small protocols, run in Arrow batches, and what is done with their scores.

A model sees sequences and returns numbers; whether those are calibrated is
the model's own claim, bound to what it was measured on by an attestation. An
uncalibrated score never decides which design is delivered.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol, runtime_checkable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandweave.core.session import ship
from strandweave.operators import profiles, studies
from strandweave.operators.kernels import Run, kernel


@runtime_checkable
class SplicePredictor(Protocol):
    """Donor and acceptor scores of every position; a backend with one track for both leaves the acceptors zero and says so."""

    name: str
    calibrated: bool
    combined: bool

    def score_sequence(self, dna: str) -> tuple[np.ndarray, np.ndarray]: ...


@runtime_checkable
class ExpressionPredictor(Protocol):
    name: str
    calibrated: bool
    units: str

    def score_many(self, dna: Sequence[str]) -> Sequence[float]: ...


@runtime_checkable
class FoldingModel(Protocol):
    name: str

    def energy(self, dna: str) -> float: ...


@dataclass(frozen=True)
class ConsensusSites:
    """The consensus matrices; positions without full context score 0."""

    name: str = "pwm"
    calibrated: bool = False
    combined: bool = False

    def score_sequence(self, dna):
        run = Run(pa.array([dna]))
        out = []
        for kind in ("donor", "acceptor"):
            odds, anchor = profiles._odds(kind)
            _, place, score = profiles._site_track(run, odds)
            track = np.zeros(len(dna))
            track[place + anchor] = score
            out.append(track)
        return out[0], out[1]


@dataclass(frozen=True)
class NoExpression:
    """Scores nothing: 0 for every sequence."""

    name: str = "null"
    calibrated: bool = False
    units: str = "none"

    def score_many(self, dna):
        return [0.0] * len(dna)


@dataclass(frozen=True)
class PairingFold:
    """The nested-pairing proxy of the first ``window`` bases."""

    window: int = 48
    name: str = "pairing_proxy"

    def energy(self, dna):
        from strandweave.plans.solve import fold_proxy

        return fold_proxy(dna, self.window)

    def energies(self, dna):
        from strandweave.plans.solve import fold_proxies

        return fold_proxies(dna, self.window)


def folded(seqs: DataFrame, model: FoldingModel | None = None) -> DataFrame:
    """(seq_id, energy); a model with ``energies`` is given all sequences of a batch at once."""
    model = model or PairingFold()

    def run(batch):
        column = batch.column(1)
        some = column.drop_null().to_pylist()
        energy = model.energies(some) if hasattr(model, "energies") else [model.energy(s) for s in some]
        out = np.zeros(len(column))
        none = column.is_null().to_numpy(zero_copy_only=False)
        out[~none] = energy
        return None, [pa.array(out, pa.float64(), mask=none)]

    return kernel(seqs, run, "energy double", whole=True)


def junction_windows(seqs: DataFrame, before: int = 45, after: int = 48) -> DataFrame:
    """seqs(seq_id, dna, upstream) with ``dna`` cut to the start of the coding sequence and what stands before it."""
    return seqs.select("seq_id", F.concat(F.right(F.coalesce("upstream", F.lit("")), F.lit(before)), F.left("dna", F.lit(after))).alias("dna"))


def expressed(seqs: DataFrame, model: ExpressionPredictor) -> DataFrame:
    """(seq_id, expression_score, expression_model, expression_calibrated, expression_units), scored a batch at a time."""
    rows = kernel(seqs, lambda batch: (None, [pa.array([float(x) for x in model.score_many(batch.column(1).to_pylist())], pa.float64())]), "expression_score double", whole=True)
    return rows.select("*", F.lit(model.name).alias("expression_model"), F.lit(bool(model.calibrated)).alias("expression_calibrated"), F.lit(model.units).alias("expression_units"))


def tracks(seqs: DataFrame, model: SplicePredictor, context: bool = False) -> DataFrame:
    """(seq_id, pos, kind, score) of a backend, one kind "splice" if it has one track only; with ``context`` scored in upstream and downstream."""
    flank = lambda c: F.coalesce(F.col(c), F.lit("")) if context else F.lit("")
    rows = seqs.select(F.struct("seq_id", F.length(flank("upstream")).alias("lead"), F.length("dna").alias("size")).alias("seq_id"), F.concat(flank("upstream"), "dna", flank("downstream")).alias("dna"))

    def run(batch):
        row, pos, kind, score = [], [], [], []
        for i, dna in enumerate(batch.column(1).to_pylist()):
            pair = model.score_sequence(dna or "")
            for name, track in zip(("splice",) if model.combined else ("donor", "acceptor"), pair, strict=False):
                n = len(track)
                row.append(np.full(n, i))
                pos.append(np.arange(n, dtype=np.int32))
                kind += [name] * n
                score.append(np.asarray(track, dtype=float))
        cat = lambda x, t: np.concatenate([*x, np.zeros(0, t)])
        return cat(row, np.int64).astype(np.int64), [cat(pos, np.int32).astype(np.int32), pa.array(kind, pa.string()), cat(score, float)]

    found = kernel(rows, run, "pos int, kind string, score double", whole=True).select("seq_id.*", "pos", "kind", "score")
    inside = (F.col("pos") >= F.col("lead")) & (F.col("pos") < F.col("lead") + F.col("size"))
    return found.where(inside).select("seq_id", (F.col("pos") - F.col("lead")).alias("pos"), "kind", "score")


def crosscheck(seqs: DataFrame, model: SplicePredictor, threshold: float = 0.5, top_k: int = 3) -> DataFrame:
    """(seq_id, backend, available, reason, calibrated, pooled_risk, risk_floored, max_site_score, sites) of one backend on each sequence.

    Sites are the peaks of runs over ``threshold``, and the risk is pooled
    against the same point. A sequence that the backend fails on is a row
    with the reason, not an error; a wrong ``top_k`` is the caller's error.
    """
    if top_k <= 0:
        raise ValueError(f"top_k must be positive, got {top_k}")
    ship(seqs.sparkSession)
    base = math.log(threshold / (1 - threshold))
    names = ["seq_id", "available", "reason", "pooled_risk", "risk_floored", "max_site_score", "sites"]

    def peaks(track, kind):
        high = np.flatnonzero(np.asarray(track) > threshold)
        for run in np.split(high, np.flatnonzero(np.diff(high) > 1) + 1) if len(high) else []:
            best = run[int(np.argmax(track[run]))]
            yield {"position": int(best), "kind": kind, "score": float(track[best])}

    def run(batches):
        for pdf in batches:
            rows = []
            for seq_id, dna in zip(pdf["seq_id"], pdf["dna"], strict=True):
                try:
                    pair = [np.asarray(t, dtype=float) for t in model.score_sequence(dna)]
                    used = pair[:1] if model.combined else pair
                    every = np.concatenate(used)
                    p = np.clip(every, 1e-6, 1 - 1e-6)
                    logit = np.sort(np.log(p / (1 - p)))[::-1][:top_k]
                    sites = [s for t, k in zip(used, ("splice",) if model.combined else ("donor", "acceptor"), strict=False) for s in peaks(t, k)]
                    rows.append((seq_id, True, None, float(np.maximum(0, logit - base).sum()), bool(len(every)) and not (every > threshold).any(), float(every.max(initial=0.0)), sorted(sites, key=lambda s: (s["position"], s["kind"]))))
                except Exception as e:  # noqa: BLE001  any fault of a backend is its result
                    rows.append((seq_id, False, f"{type(e).__name__}: {e}", 0.0, False, 0.0, []))
            yield pd.DataFrame(rows, columns=names)

    kind = seqs.schema["seq_id"].dataType.simpleString()
    out = seqs.select("seq_id", "dna").mapInPandas(run, f"seq_id {kind}, available boolean, reason string, pooled_risk double, risk_floored boolean, max_site_score double, sites array<struct<position:int,kind:string,score:double>>")
    return out.select("seq_id", F.lit(model.name).alias("backend"), "available", "reason", F.lit(bool(model.calibrated)).alias("calibrated"), "pooled_risk", "risk_floored", "max_site_score", "sites")


def rerank(points: DataFrame, scores: DataFrame) -> DataFrame:
    """Frontier points(seq_id, point, is_chosen, ...) with their expression scores; the chosen one moves to the highest score only if the model is calibrated.

    ``scores`` has (seq_id, point) and the columns of ``expressed``. Ties go to
    the earlier point.
    """
    rows = points.join(scores, ["seq_id", "point"], "left")
    best = F.row_number().over(W.partitionBy("seq_id").orderBy(F.col("expression_score").desc_nulls_last(), "point")) == 1
    steer = F.max(F.coalesce("expression_calibrated", F.lit(False))).over(W.partitionBy("seq_id"))
    return rows.withColumn("__best", best).withColumn("__steer", steer).withColumn("is_chosen", F.when(F.col("__steer"), F.col("__best")).otherwise(F.col("is_chosen"))).drop("__best", "__steer")


def designed_probe(members: DataFrame, risks: DataFrame, eps: float = 1e-9) -> tuple[DataFrame, DataFrame]:
    """What backends make of synonymous designs, without labels: (spread, agreement).

    members(group, member_id, role) and risks(backend, group, member_id, risk,
    response, below_background). Spread: by group and backend the range of
    native minus design for the pooled risk and for the response that has no
    floor, and how many designs are floored. Agreement: by group and pair of
    backends the rank correlation and the agreement in sign of the changes.
    """
    rows = risks.join(members, ["group", "member_id"])
    native = rows.where("role = 'native'").select("backend", "group", F.col("risk").alias("r0"), F.col("response").alias("s0"))
    moved = rows.where("role <> 'native'").join(native, ["backend", "group"]).select("backend", "group", "member_id", (F.col("r0") - F.col("risk")).alias("delta"), (F.col("s0") - F.col("response")).alias("shift"), "below_background")
    span = lambda c: (F.max(c) - F.min(c))
    spread = moved.groupBy("group", "backend").agg(F.count(F.lit(1)).alias("n_designs"), span("delta").alias("delta_spread"), F.min("delta").alias("delta_low"), F.max("delta").alias("delta_high"), span("shift").alias("response_spread"), F.count_if("below_background").alias("n_below_background"))
    agreement = studies.delta_agreement(moved.select("backend", F.struct("group", "member_id").alias("case"), "delta", "group"), eps, ["group"])
    return spread, agreement


@dataclass(frozen=True)
class Attestation:
    """What a model was measured on and whether it passed: it holds for exactly these digests."""

    model: str
    weights_sha256: str
    panel_sha256: str
    regime: str
    passed: bool

    def check(self, model: str, weights_sha256: str, panel_sha256: str, regime: str) -> None:
        """Raises unless everything is what was attested; a flanked input is another regime than a bare one."""
        have = {"model": model, "weights_sha256": weights_sha256, "panel_sha256": panel_sha256, "regime": regime}
        off = [f"{k}: attested {getattr(self, k)!r}, found {v!r}" for k, v in have.items() if getattr(self, k) != v]
        if off or not self.passed:
            raise ValueError("; ".join(off) or "the attested gate did not pass")

"""Sliding profiles and consensus site scores."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandweave.core.genetic import ACCEPTOR, ACCEPTOR_ANCHOR, DONOR, DONOR_ANCHOR, pwm_log_odds
from strandweave.operators.kernels import Run, kernel
from strandweave.operators.usage import by_number


def gc_profile(seqs: DataFrame, width: int = 50) -> DataFrame:
    """(seq_id, pos, value): GC share of every full window, from running sums within the row."""

    def profile(run: Run):
        row, place, at = run.starts(width)
        strong = (run.codes == 1) | (run.codes == 2)
        return row, [place.astype(np.int32), run.window_sums(strong, at, width) / width]

    return kernel(seqs, profile, "pos int, value double")


def dinucleotide_profile(seqs: DataFrame, pair: str = "CG", width: int = 50) -> DataFrame:
    """(seq_id, pos, n, density): overlapping occurrences of a pair in every full window; a window of one base has density 0."""
    x, y = ("ACGT".index(c) for c in pair)

    def profile(run: Run):
        row, place, at = run.starts(width)
        hit = np.zeros(len(run.codes), dtype=bool)
        hit[:-1] = (run.codes[:-1] == x) & (run.codes[1:] == y)
        n = run.window_sums(hit, at, width - 1)
        return row, [place.astype(np.int32), n, n / (width - 1) if width > 1 else np.zeros(len(n))]

    return kernel(seqs, profile, "pos int, n long, density double")


def minmax_profile(seqs: DataFrame, table: DataFrame, width: int = 18) -> DataFrame:
    """(seq_id, cpos, value): the %MinMax value of every full window of codons, all of them in A, C, G and T."""
    family = W.partitionBy("aa")
    t = table.select("codon", F.col("frequency").alias("actual"), F.avg("frequency").over(family).alias("mean"), F.max("frequency").over(family).alias("most"), F.min("frequency").over(family).alias("least"))
    parts = [by_number(t, c) for c in ("actual", "mean", "most", "least")]

    def profile(run: Run):
        row, place, number = run.codons()
        if len(row) < width:
            return np.zeros(0, np.int64), [np.zeros(0, np.int32), np.zeros(0)]
        view = lambda x: np.lib.stride_tricks.sliding_window_view(x, width)
        at = np.flatnonzero((row[width - 1 :] == row[: len(row) - width + 1]) & (view(number).min(axis=1) >= 0))
        a, v, x, m = (view(p[number])[at].sum(axis=1) for p in parts)
        with np.errstate(divide="ignore", invalid="ignore"):
            up, down = np.where(x != v, 100 * (a - v) / (x - v), 0.0), np.where(v != m, -100 * (v - a) / (v - m), 0.0)
        return row[at], [place[at].astype(np.int32), np.where(a > v, up, down)]

    return kernel(seqs, profile, "cpos int, value double")


def _site_track(run: Run, odds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, place, score) of every window of a matrix of log odds; other letters count as T.

    Windows whose letters are those of another in another order score alike up
    to the last bits, so the order of calls hangs on these. The exponential is
    the C library's on every processor, as in DuckDB; numpy has its own where
    there is AVX-512.
    """
    row, place, at = run.starts(len(odds))
    codes = np.minimum(run.codes, 3)
    total = np.zeros(len(at))
    for i, column in enumerate(odds):
        total += column[codes[at + i]]
    return row, place, 1 / (1 + pa.compute.exp(pa.array(-total)).to_numpy(zero_copy_only=False))


def _odds(kind: str) -> tuple[np.ndarray, int]:
    table, anchor = (DONOR, DONOR_ANCHOR) if kind == "donor" else (ACCEPTOR, ACCEPTOR_ANCHOR)
    return np.array([[c[b] for b in "ACGT"] for c in pwm_log_odds(table)]), anchor


def site_scores(seqs: DataFrame, kind: str) -> DataFrame:
    """(seq_id, pos, score) of donors or acceptors, by the position of their anchor; positions without full context have no row (score 0)."""
    odds, anchor = _odds(kind)

    def track(run: Run):
        row, place, score = _site_track(run, odds)
        return row, [(place + anchor).astype(np.int32), score]

    return kernel(seqs, track, "pos int, score double")


def both_sites(seqs: DataFrame) -> DataFrame:
    return site_scores(seqs, "donor").withColumn("kind", F.lit("donor")).unionByName(site_scores(seqs, "acceptor").withColumn("kind", F.lit("acceptor")))


def called_sites(seqs: DataFrame, top_k: int = 3) -> DataFrame:
    """The rows of ``both_sites`` at positions that are among the ``top_k`` highest of either kind in their sequence, the first of equal scores.

    They are found within the row: no other position leaves the kernel.
    """
    tracks = {k: _odds(k) for k in ("donor", "acceptor")}

    def pick(run: Run):
        called, found = np.zeros(len(run.codes), dtype=bool), []
        for kind, (odds, anchor) in tracks.items():
            row, place, score = _site_track(run, odds)
            place = place + anchor
            at = run.first[row] + place
            order = np.lexsort((-score, row))
            _, head, n = np.unique(row, return_index=True, return_counts=True)
            called[at[order[np.arange(len(row)) - np.repeat(head, n) < top_k]]] = True
            found.append((kind, row, place, score, at))
        kept = [(row[m], place[m], score[m], [kind] * int(m.sum())) for kind, row, place, score, at in found for m in [called[at]]]
        row, place, score, kind = (np.concatenate([k[i] for k in kept]) for i in range(4))
        return row, [place.astype(np.int32), score, pa.array(kind.tolist(), pa.string())]

    return kernel(seqs, pick, "pos int, score double, kind string")


def peaks(scores: DataFrame, threshold: float) -> DataFrame:
    """One row for each run of consecutive positions over the threshold: its first highest position."""
    high = scores.where(F.col("score") > threshold)
    order = W.partitionBy("seq_id", "kind").orderBy("pos")
    runs = high.withColumn("run", F.col("pos") - F.row_number().over(order))
    best = W.partitionBy("seq_id", "kind", "run").orderBy(F.col("score").desc(), "pos")
    return runs.withColumn("__r", F.row_number().over(best)).where("__r = 1").select("seq_id", "kind", "pos", "score")


def supported(peaks: DataFrame, width: int = 3) -> DataFrame:
    """Peaks(seq_id, backend, kind, pos, score) with the backends that have one within ``width`` bases; each meets only its own and the neighbouring buckets."""
    bucket = lambda c: F.floor(F.col(c) / (width + 1))
    near = peaks.select("seq_id", F.col("backend").alias("other"), F.col("pos").alias("at"), F.explode(F.sequence(bucket("pos") - 1, bucket("pos") + 1)).alias("bucket"))
    met = peaks.withColumn("bucket", bucket("pos")).join(near, ["seq_id", "bucket"]).where(F.abs(F.col("pos") - F.col("at")) <= width)
    return met.groupBy("seq_id", "backend", "kind", "pos", "score").agg(F.array_sort(F.collect_set("other")).alias("backends"))


def pooled_risk(scores: DataFrame, background: float = 0.01, top_k: int = 3, floor: float = 1e-6) -> DataFrame:
    """(seq_id, risk, response, n_above, top, n_scored, below_background): log odds over the background, summed over the k highest sites.

    ``below_background`` says that nothing scored over the background, so that
    the risk is 0 by construction. Tops of blocks of positions are taken
    first, so a long sequence is not sorted in one place.
    """
    clamp = lambda p: F.greatest(F.lit(floor), F.least(F.lit(1 - floor), p))
    base = math.log(background / (1 - background))
    rows = scores.withColumn("l", F.log(clamp(F.col("score")) / (1 - clamp(F.col("score")))))
    best = [F.col("l").desc(), "pos", "kind"]
    part = W.partitionBy("seq_id", "block").orderBy(*best)
    some = rows.withColumn("block", F.floor(F.col("pos") / 65536)).withColumn("__r", F.row_number().over(part)).where(F.col("__r") <= top_k)
    top = some.withColumn("__r", F.row_number().over(W.partitionBy("seq_id").orderBy(*best))).where(F.col("__r") <= top_k)
    above = rows.groupBy("seq_id").agg(F.count_if(F.col("l") > base).alias("n_above"), F.max("score").alias("top"), F.count(F.lit(1)).alias("n_scored"))
    out = top.groupBy("seq_id").agg(F.sum(F.greatest(F.lit(0.0), F.col("l") - base)).alias("risk"), F.sum("l").alias("response")).join(above, "seq_id")
    return out.withColumn("below_background", F.col("n_above") == 0)


def sequence_risk(seqs: DataFrame, background: float = 0.01, top_k: int = 3, floor: float = 1e-6) -> DataFrame:
    """``pooled_risk`` of both consensus tracks, within the row: no position leaves the kernel. Sequences too short for a site have no row."""
    tracks = [_odds(k)[0] for k in ("donor", "acceptor")]
    base = math.log(background / (1 - background))

    def pool(run: Run):
        found = [_site_track(run, odds) for odds in tracks]
        row, score = (np.concatenate([f[i] for f in found]) for i in (0, 2))
        p = np.clip(score, floor, 1 - floor)
        logit = np.log(p / (1 - p))
        order = np.lexsort((-logit, row))
        row, score, logit = row[order], score[order], logit[order]
        some, head, n = np.unique(row, return_index=True, return_counts=True)
        place = np.arange(len(row)) - np.repeat(head, n)
        kept, at = place < top_k, np.repeat(np.arange(len(some)), n)
        add = lambda x, m: np.bincount(at[m], weights=x[m], minlength=len(some))
        above = np.bincount(at[logit > base], minlength=len(some))
        return some, [add(np.maximum(0.0, logit - base), kept), add(logit, kept), above, np.maximum.reduceat(score, head) if len(head) else score, n, above == 0]

    return kernel(seqs, pool, "risk double, response double, n_above long, top double, n_scored long, below_background boolean")


def risk_in_context(seqs: DataFrame, **options) -> DataFrame:
    """``pooled_risk`` of the sites within ``dna``, scored with what stands before and after it: seqs(seq_id, dna, upstream, downstream).

    The real flanks take the place of missing context; positions stay those of ``dna``.
    """
    return pooled_risk(scores_in_context(seqs), **options)


def scores_in_context(seqs: DataFrame) -> DataFrame:
    """(seq_id, pos, score, kind) within ``dna``, scored in its flanks; never calibrated, whatever the backend is without flanks."""
    flank = lambda c: F.coalesce(F.upper(F.col(c)), F.lit(""))
    rows = seqs.select(F.struct("seq_id", F.length(flank("upstream")).alias("lead"), F.length("dna").alias("size")).alias("seq_id"), F.concat(flank("upstream"), "dna", flank("downstream")).alias("dna"))
    found = both_sites(rows).select("seq_id.*", "pos", "score", "kind")
    inside = (F.col("pos") >= F.col("lead")) & (F.col("pos") < F.col("lead") + F.col("size"))
    return found.where(inside).select("seq_id", (F.col("pos") - F.col("lead")).alias("pos"), "score", "kind")

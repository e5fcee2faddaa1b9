"""Codon usage and adaptation scores."""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandweave.core.genetic import CODE, WOBBLE, code_table, reverse_complement
from strandweave.operators.kernels import AMINO, CODONS, FIXED, Run, kernel, tally

_FIXED = ("M", "W", "*")


def count_codons(seqs: DataFrame) -> DataFrame:
    """(codon, n) of the codons in A, C, G and T, counted within the rows before anything is shuffled."""

    def count(run: Run):
        number = run.codons()[2]
        n = np.bincount(number[number >= 0], minlength=64)
        return [CODONS[i] for i in np.flatnonzero(n)], n[n > 0]

    return tally(seqs, count, "codon")


def count_words(seqs: DataFrame, k: int) -> DataFrame:
    """(kmer, n) of every k-letter word in A, C, G and T, overlapping ones too; k at most 8."""
    letters = ["".join(w) for w in product("ACGT", repeat=k)]

    def count(run: Run):
        _, _, at = run.starts(k)
        number, bad = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=bool)
        for i in range(k):
            number = 4 * number + run.codes[at + i]
            bad |= run.codes[at + i] > 3
        n = np.bincount(number[~bad], minlength=len(letters))
        return [letters[i] for i in np.flatnonzero(n)], n[n > 0]

    return tally(seqs, count, "kmer")


def translated(seqs: DataFrame) -> DataFrame:
    """(seq_id, protein) of the whole codons, * for a stop; a codon with another letter than A, C, G and T gives nothing."""
    amino = np.array([ord(a) for a in AMINO], dtype=np.uint8)

    def translate(run: Run):
        row, _, number = run.codons()
        known = number >= 0
        size = np.bincount(row[known], minlength=len(run.size))
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        return None, [pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(amino[number[known]].tobytes()))]

    return kernel(seqs, translate, "protein string")


def codon_numbers(seqs: DataFrame) -> DataFrame:
    """(seq_id, n_codons, n_scored): whole codons, and those of amino acids with a choice."""

    def count(run: Run):
        row, _, number = run.codons()
        scored = (number >= 0) & ~FIXED[number]
        return None, [np.bincount(row, minlength=len(run.size)), np.bincount(row[scored], minlength=len(run.size))]

    return kernel(seqs, count, "n_codons long, n_scored long")


def by_number(table: DataFrame, column: str, missing: float = math.nan) -> np.ndarray:
    """A column of a codon table (64 rows) by codon number."""
    got = {r["codon"]: r[column] for r in table.select("codon", column).collect()}
    return np.array([got.get(c, missing) for c in CODONS], dtype=float)


def build_table(seqs: DataFrame, pseudocount: float = 1.0) -> DataFrame:
    """(codon, aa, frequency, w) for all 64 codons; w is the frequency over the best of its amino acid."""
    table = code_table(seqs.sparkSession).join(F.broadcast(count_codons(seqs)), "codon", "left").withColumn("frequency", F.coalesce("n", F.lit(0)) + F.lit(pseudocount))
    return table.select("codon", "aa", "frequency", (F.col("frequency") / F.max("frequency").over(W.partitionBy("aa"))).alias("w"))


def table_issues(table: DataFrame) -> DataFrame:
    """One row: amino acids covered, stops covered, and frequencies that are not finite and positive."""
    return table.agg(
        F.count_distinct(F.when(F.col("aa") != "*", F.col("aa"))).alias("amino_acids"), F.max(F.when(F.col("aa") == "*", 1).otherwise(0)).alias("has_stop"),
        F.count_if(~(F.col("frequency") > 0) | F.isnan("frequency") | (F.col("frequency") == float("inf"))).alias("bad"),
    )


def adaptation_index(seqs: DataFrame, weights: DataFrame, skip: tuple[str, ...] = _FIXED) -> DataFrame:
    """(seq_id, index, n_scored): geometric mean of w over the scored codons; 1.0 without any. Codons without a weight are not scored."""
    log_w = np.log(by_number(weights, "w"))
    log_w[np.isin(AMINO, skip)] = math.nan

    def score(run: Run):
        row, _, number = run.codons()
        used = np.flatnonzero((number >= 0) & ~np.isnan(log_w)[number])
        n = np.bincount(row[used], minlength=len(run.size))
        total = np.bincount(row[used], weights=log_w[number[used]], minlength=len(run.size))
        return None, [np.where(n > 0, np.exp(total / np.maximum(n, 1)), 1.0), n]

    return kernel(seqs, score, "index double, n_scored long")


def tai_weights(trna: DataFrame, prokaryote: bool = False) -> DataFrame:
    """(codon, w) of the 60 codons that tAI scores, from trna(anticodon, count).

    The table has at most 64 anticodons, so it comes to the driver.
    """
    got = {r["anticodon"]: float(r["count"]) for r in trna.groupBy("anticodon").agg(F.sum("count").alias("count")).collect()}
    copies = {c: got.get(reverse_complement(c), 0.0) for c in CODE}
    share = [1.0 - s for s in WOBBLE]
    reads = {"T": ((0, "T"), (4, "C")), "C": ((1, "C"), (5, "T")), "A": ((2, "A"), (6, "T")), "G": ((3, "G"), (7, "A"))}
    raw = {c: sum(share[i] * copies[c[:2] + b] for i, b in reads[c[2]]) for c in CODE}
    if prokaryote:
        raw["ATA"] = share[8]
    kept = {c: v for c, v in raw.items() if CODE[c] != "*" and c != "ATG"}
    top = max(kept.values())
    if top <= 0:
        raise ValueError("no tRNA reads any codon")
    some = [v / top for v in kept.values() if v > 0]
    mean = math.exp(math.fsum(map(math.log, some)) / len(some))
    return trna.sparkSession.createDataFrame([(c, v / top if v > 0 else mean) for c, v in sorted(kept.items())], "codon string, w double")


def _pair_numbers(run: Run) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, number) of adjacent codons: 64 times the first one's number and the second one's."""
    row, _, number = run.codons()
    ok = (row[1:] == row[:-1]) & (number[1:] >= 0) & (number[:-1] >= 0)
    return row[1:][ok], (64 * number[:-1] + number[1:])[ok]


def codon_pairs(seqs: DataFrame) -> DataFrame:
    """(codon_a, codon_b, n) of adjacent codons, at most 4096 rows."""

    def count(run: Run):
        n = np.bincount(_pair_numbers(run)[1], minlength=4096)
        return np.flatnonzero(n), n[n > 0]

    code = F.array(*[F.lit(c) for c in CODONS])
    rows = tally(seqs, count, "pair", "long")
    return rows.select(F.get(code, (F.col("pair") / 64).cast("int")).alias("codon_a"), F.get(code, (F.col("pair") % 64).cast("int")).alias("codon_b"), "n")


def codon_pair_scores(seqs: DataFrame, pseudocount: float = 1.0) -> DataFrame:
    """(codon_a, codon_b, cps) of the observed pairs of sense codons; counts of at most 4096 pairs meet in one small table."""
    p = F.lit(pseudocount)
    sense = count_codons(seqs).join(F.broadcast(code_table(seqs.sparkSession)), "codon").where("aa <> '*'")
    one = F.broadcast(sense.withColumn("n_aa", F.sum("n").over(W.partitionBy("aa"))))
    pair = codon_pairs(seqs).withColumnRenamed("n", "n_ab")
    a = one.select(F.col("codon").alias("codon_a"), F.col("aa").alias("x"), F.col("n").alias("n_a"), F.col("n_aa").alias("n_x"))
    b = one.select(F.col("codon").alias("codon_b"), F.col("aa").alias("y"), F.col("n").alias("n_b"), F.col("n_aa").alias("n_y"))
    rows = pair.join(a, "codon_a").join(b, "codon_b").withColumn("n_xy", F.sum("n_ab").over(W.partitionBy("x", "y")))
    expected = (F.col("n_a") + p) * (F.col("n_b") + p) / ((F.col("n_x") + p) * (F.col("n_y") + p)) * (F.col("n_xy") + p)
    return rows.select("codon_a", "codon_b", F.log((F.col("n_ab") + p) / expected).alias("cps"))


def codon_pair_total(seqs: DataFrame, scores: DataFrame) -> DataFrame:
    """(seq_id, total): the sum over adjacent pairs; unknown pairs add nothing. ``scores`` has at most 4096 rows."""
    place, score = {c: i for i, c in enumerate(CODONS)}, np.zeros(4096)
    for r in scores.select("codon_a", "codon_b", "cps").collect():
        score[64 * place[r[0]] + place[r[1]]] = r[2]

    def total(run: Run):
        row, pair = _pair_numbers(run)
        return None, [np.bincount(row, weights=score[pair], minlength=len(run.size))]

    return kernel(seqs, total, "total double")


def family_excess(table: DataFrame) -> DataFrame:
    """(codon, w, over): a codon's share of its amino acid, less the family's mean."""
    family = W.partitionBy("aa")
    t = table.withColumn("share", F.col("frequency") / F.sum("frequency").over(family))
    return t.select("codon", "w", (F.col("share") - F.avg("share").over(family)).alias("over"))


def additive_terms(seqs: DataFrame, table: DataFrame, target_gc: float = 0.5, ramp: int = 35) -> DataFrame:
    """(seq_id, cai_logw, gc_proximity, minmax, ramp): the terms that are sums over codons, in one pass; sequences without a codon have no row."""
    t = family_excess(table)
    w, over = by_number(t, "w"), by_number(t, "over")
    gc = np.array([sum(b in "GC" for b in c) / 3 for c in CODONS])
    log_w, over, slow = (np.where(FIXED, 0.0, x) for x in (np.log(w), over, w))
    far = -((gc - target_gc) ** 2)

    def terms(run: Run):
        row, place, number = run.codons()
        known = number >= 0
        row, place, number = row[known], place[known], number[known]
        some, at = np.unique(row, return_inverse=True)
        add = lambda x: np.bincount(at, weights=x, minlength=len(some))
        return some, [add(log_w[number]), add(far[number]), add(over[number]), add(-slow[number] * np.maximum(0.0, 1 - place / ramp))]

    return kernel(seqs, terms, "cai_logw double, gc_proximity double, minmax double, ramp double")

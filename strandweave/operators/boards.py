"""Boards: designs of several makers, tables or budgets side by side, every figure recomputed from the sequence."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.core.genetic import SYNONYMS
from strandweave.core.session import ship
from strandweave.functions.dna import gc_fraction
from strandweave.operators import metrics, profiles, rules, usage
from strandweave.operators.kernels import Run, kernel
from strandweave.plans import objectives, solve


def recomputed(seqs: DataFrame, table: DataFrame, tai: DataFrame | None = None) -> DataFrame:
    """(seq_id, length_nt, gc, cpg, max_homopolymer, max_tandem, cai, minmax_mean, tai) of seqs(seq_id, dna)."""
    base = seqs.select("seq_id", F.length("dna").alias("length_nt"), gc_fraction(F.col("dna")).alias("gc"), ((F.length("dna") - F.length(F.replace("dna", F.lit("CG"), F.lit("")))) / 2).cast("long").alias("cpg"))
    longest = kernel(seqs, _longest_run, "max_homopolymer long")
    mean = profiles.minmax_profile(seqs, table).groupBy("seq_id").agg(F.avg("value").alias("minmax_mean"))
    out = base.join(longest, "seq_id").join(usage.adaptation_index(seqs, table).select("seq_id", F.col("index").alias("cai")), "seq_id").join(rules.tandem_span(seqs).withColumnRenamed("span", "max_tandem"), "seq_id", "left").join(mean, "seq_id", "left")
    if tai is not None:
        out = out.join(usage.adaptation_index(seqs, tai, ("M", "*")).select("seq_id", F.col("index").alias("tai")), "seq_id")
    return out.withColumn("max_tandem", F.coalesce("max_tandem", F.lit(0)))


def _longest_run(run: Run):
    row = np.repeat(np.arange(len(run.size)), run.size)
    out = np.zeros(len(run.size), dtype=np.int64)
    if len(row):
        head = np.flatnonzero(np.r_[True, (run.raw[1:] != run.raw[:-1]) | (row[1:] != row[:-1])])
        np.maximum.at(out, row[head], np.diff(np.append(head, len(row))))
    return None, [out]


def naive(proteins: DataFrame) -> DataFrame:
    """(seq_id, dna): the first codon of each residue and the first stop."""
    return solve.optimize_local(proteins, dict.fromkeys([c for cs in SYNONYMS.values() for c in cs], 0.0))


def against_naive(proteins: DataFrame, designs: DataFrame, table: DataFrame) -> DataFrame:
    """Each protein's naive sequence beside its design: figures of both, named naive_ and design_."""
    side = lambda df, name: recomputed(df.select("seq_id", "dna"), table).select("seq_id", *[F.col(c).alias(f"{name}_{c}") for c in ("length_nt", "gc", "cpg", "max_homopolymer", "max_tandem", "minmax_mean", "cai")])
    return side(naive(proteins), "naive").join(side(designs, "design"), "seq_id")


def tool_board(panel: DataFrame, table: DataFrame, native: str = "Native", tai: DataFrame | None = None) -> DataFrame:
    """panel(group, name, dna) with its figures, and whether each encodes the protein of its group's native; a group without one takes its least name."""
    rows = panel.withColumn("seq_id", F.struct("group", "name"))
    protein = usage.translated(rows.select("seq_id", "dna"))
    first = protein.groupBy(F.col("seq_id.group").alias("group")).agg(F.min_by("protein", F.struct(F.col("seq_id.name") != native, F.col("seq_id.name"))).alias("reference"))
    out = recomputed(rows.select("seq_id", "dna"), table, tai).join(protein, "seq_id").select("seq_id.group", "seq_id.name", "*").drop("seq_id").join(first, "group")
    same = F.col("protein") == F.col("reference")
    note = F.when(same, "").when(F.length("protein") != F.length("reference"), F.format_string("length mismatch: %d aa vs %d aa", F.length("protein"), F.length("reference"))).otherwise("residue mismatch")
    return out.withColumn("aa", F.length("protein")).withColumn("matches_native", same).withColumn("note", note).drop("protein", "reference")


def spread(board: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """(*by, metric, n, low, high, span, mean, sd) of the board's columns; nulls are left out."""
    long = board.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in columns])).alias("m")).select(*by, "m.metric", "m.v")
    v = F.col("v")
    return long.groupBy(*by, "metric").agg(F.count("v").alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), (F.max(v) - F.min(v)).alias("span"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"))


def budget_board(proteins: DataFrame, weights: objectives.Objective, rule_list, beams: list[int]) -> DataFrame:
    """(seq_id, budget, dna, score, status): the exact design and one for each beam, of every protein in one kernel."""
    rule_list, budgets = list(rule_list), [None, *beams]
    found = solve.solve_batch(proteins, lambda p: [solve.trellis(p, weights, rule_list, b) for b in budgets])
    name = F.element_at(F.array(*[F.lit("exact" if b is None else f"beam={b}") for b in budgets]), F.col("point") + 1)
    return found.select("seq_id", name.alias("budget"), "dna", "score", "status")


def organism_board(proteins: DataFrame, tables: DataFrame, rule_list=()) -> DataFrame:
    """(seq_id, organism, dna, score, status): every protein designed for each of tables(organism, codon, w), a few of 64 rows."""
    log_w: dict[str, dict[str, float]] = {}
    for r in tables.select("organism", "codon", "w").collect():
        log_w.setdefault(r["organism"], {})[r["codon"]] = math.log(r["w"])
    names, rule_list = sorted(log_w), list(rule_list)

    def run(protein):
        graph = solve.Structure(protein, rule_list)
        return [graph.solve(solve.Weights(log_w[n])) for n in names]

    found = solve.solve_batch(proteins, run)
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("point") + 1)
    return found.select("seq_id", name.alias("organism"), "dna", "score", "status")


def direction_pairs(proteins: DataFrame, log_w: dict[str, float]) -> DataFrame:
    """(seq_id, side, dna): the designs of most and of least codon adaptation."""
    flipped = {c: -v for c, v in log_w.items()}
    side = lambda w, n: solve.optimize_local(proteins, w).select("seq_id", F.lit(n).alias("side"), "dna")
    return side(log_w, "max").unionByName(side(flipped, "min"))


def direction_check(pairs: DataFrame, noise: float = 1e-9) -> DataFrame:
    """One row (pairs, ties, trials, successes, p_value): how often scores prefer the adapted design; pairs(seq_id, side, score). Ties are no trials."""
    gap = F.max(F.when(F.col("side") == "max", F.col("score"))) - F.max(F.when(F.col("side") == "min", F.col("score")))
    rows = pairs.groupBy("seq_id").agg(gap.alias("gap"))
    n = rows.agg(F.count(F.lit(1)), F.count_if(F.abs("gap") <= noise), F.count_if(F.col("gap") > noise)).first()
    trials = n[0] - n[1]
    return pairs.sparkSession.createDataFrame([(n[0], n[1], trials, n[2], metrics.sign_test(n[2], trials - n[2]))], "pairs long, ties long, trials long, successes long, p_value double")


def dose_response(rungs: DataFrame) -> DataFrame:
    """(seq_id, n_rungs, spearman, score_span) along each protein's designs rungs(seq_id, dna, dose, score), equal designs once."""
    one = rungs.dropDuplicates(["seq_id", "dna"])
    r = metrics.spearman(one, ["seq_id"], "dose", "score").select("seq_id", F.col("n").alias("n_rungs"), "spearman")
    return r.join(one.groupBy("seq_id").agg((F.max("score") - F.min("score")).alias("score_span")), "seq_id")


def rank_fit(df: DataFrame, group: str, score: str, features: list[str]) -> DataFrame:
    """(group, n, adjusted_r2, residual_sd): least squares of the ranked score on ranked features and their squares, centred, by group.

    Ranks are taken with ties averaged over the whole group, and the fit needs
    only sums of products, so a group of any size is a few numbers. Features
    without spread within a group are left out of its fit; without any, or
    without degrees of freedom, the fit explains nothing.
    """
    rows = df.select(F.col(group).alias("group"), F.col(score).alias("y"), *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)])
    names = ["y", *[f"x{i}" for i in range(len(features))]]
    for c in names:
        rows = metrics.with_rank(rows, ["group"], c, f"r_{c}")
    middle = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(middle, "group").select("group", "n", *[(F.col(f"r_{c}") - (F.col("n") + 1) / 2).alias(c) for c in names])
    squares = rows.groupBy("group").agg(*[F.avg(F.col(c) * F.col(c)).alias(f"s_{c}") for c in names[1:]])
    rows = rows.join(squares, "group").select("group", "n", "y", *names[1:], *[(F.col(c) * F.col(c) - F.col(f"s_{c}")).alias(f"q_{c}") for c in names[1:]])
    cols = [n for c in names[1:] for n in (c, f"q_{c}")]
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    products = [F.sum(F.col(a) * F.col(b)) for a, b in pairs]
    sums = rows.groupBy("group", "n").agg(F.array(*products).alias("xx"), F.array(*[F.sum(F.col(c) * F.col("y")) for c in cols]).alias("xy"), F.sum(F.col("y") * F.col("y")).alias("yy"))
    ship(df.sparkSession)

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                full = np.zeros((len(cols), len(cols)))
                for (a, b), v in zip(pairs, r.xx, strict=True):
                    i, j = cols.index(a), cols.index(b)
                    full[i, j] = full[j, i] = v
                keep = [i for i in range(len(cols)) if full[i - i % 2, i - i % 2] > 1e-9]
                xx, xy, dof = full[np.ix_(keep, keep)], np.asarray(r.xy, dtype=float)[keep], r.n - len(keep) - 1
                explained = float(xy @ np.linalg.lstsq(xx, xy, rcond=None)[0]) if keep else 0.0
                rest = max(0.0, r.yy - explained)
                fit = 1 - (rest / r.yy) * (r.n - 1) / dof if keep and r.yy > 0 and dof > 0 else 0.0
                out.append((r.group, int(r.n), fit, math.sqrt(rest / r.n) if r.n else 0.0))
            yield pd.DataFrame(out, columns=["group", "n", "adjusted_r2", "residual_sd"])

    kind = df.schema[group].dataType.simpleString()
    return sums.select("group", "n", "xx", "xy", "yy").mapInPandas(run, f"group {kind}, n long, adjusted_r2 double, residual_sd double")

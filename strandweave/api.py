"""The verbs of the sequence engine, over tables of sequences."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.functions.dna import gc_count
from strandweave.operators import profiles, rules, usage
from strandweave.operators.kernels import kernel
from strandweave.operators.models import NoExpression, expressed
from strandweave.operators.models import tracks as tracks_of
from strandweave.plans import objectives, solve
from strandweave.plans.config import Config

#: Packaging limits in bases.
PACKAGING = {"aav": 4700, "lvv": 9000}


def log_weights(table: DataFrame) -> dict[str, float]:
    """ln w of the codons of a usage table (64 rows)."""
    return {r["codon"]: math.log(r["w"]) for r in table.collect()}


def optimize(proteins: DataFrame, table: DataFrame, rule_list=(), gc_weight: float = 0.0, gc_target: float = 0.5, beam: int | None = None) -> DataFrame:
    """One design for each protein with its status, culprits and relaxed rules."""
    w = solve.Weights(log_weights(table), 1.0, gc_weight, gc_target)
    rs = list(rule_list)
    return solve.solve_batch(proteins, lambda p: [solve.optimize(p, w, rs, beam)]).drop("point")


def objective(config: Config, log_w: dict[str, float], tai_w: dict[str, float] | None = None, over: dict[str, float] | None = None, pair_scores: dict | None = None) -> objectives.Objective:
    """The terms that a configuration weighs; one whose table is missing raises."""
    parts = [(objectives.cai_logw(log_w), config.cai_weight), (objectives.GcProximity(config.gc_target), config.gc_weight), (objectives.Pair("CG", -1 if config.cpg_mode == "deplete" else 1), config.cpg_weight), (objectives.Ramp({c: math.exp(v) for c, v in log_w.items()}, config.ramp_codons), config.ramp_weight)]
    for name, table, weight, term in (("tai", tai_w, config.tai_weight, objectives.tai_logw), ("minmax", over, config.minmax_weight, objectives.minmax), ("codon_pair", pair_scores, config.codon_pair_weight, objectives.CodonPair)):
        if weight:
            if table is None:
                raise ValueError(f"{name} is weighted but its table is not given")
            parts.append((term(table), weight))
    return objectives.Objective(tuple((t, w) for t, w in parts if w))


def optimize_config(proteins: DataFrame, table: DataFrame, config: Config, **tables) -> DataFrame:
    """One design for each protein under a configuration, its budgets and refinement included; parts that do not go together raise before anything runs."""
    faults = config.faults()
    if faults:
        raise ValueError("; ".join(faults))
    goal, rs = objective(config, log_weights(table), **tables), config.rules()

    def run(protein):
        n = 3 * (len(protein) + 1)
        if config.gc_budget:
            low, high = math.ceil(config.gc_budget[0] * n - 1e-9), math.floor(config.gc_budget[1] * n + 1e-9)
            return [solve.budgeted(protein, goal, low, high, solve.gc_amount, 0, rs, config.beam)]
        if config.dinucleotide_budget:
            pair, low, high = config.dinucleotide_budget
            return [solve.budgeted(protein, goal, low, high, solve.pair_amount(pair), 1, rs, config.beam)]
        return [solve.optimize(protein, goal, rs, config.beam, seed=config.seed, steps=config.refine_steps, always=config.refine)]

    return solve.solve_batch(proteins, run).drop("point")


def frontier(proteins: DataFrame, table: DataFrame, rule_list=(), steps: int = 11) -> DataFrame:
    return solve.frontier(proteins, log_weights(table), rule_list, steps)


def validate(seqs: DataFrame, rule_list) -> tuple[DataFrame, DataFrame]:
    """(violations, counts a sequence)."""
    found = rules.validate(seqs, list(rule_list))
    return found, rules.counts(seqs, found)


def tracks(seqs: DataFrame, table: DataFrame | None = None, width: int = 50, sites: bool = False) -> DataFrame:
    """(seq_id, track, unit, pos, value): GC and CpG always; %MinMax with a usage table, for sequences of whole codons; site scores if asked."""
    pick = lambda df, name, unit, pos, value: df.select("seq_id", F.lit(name).alias("track"), F.lit(unit).alias("unit"), F.col(pos).cast("long").alias("pos"), F.col(value).alias("value"))
    out = pick(profiles.gc_profile(seqs, width), "gc", "nt", "pos", "value").union(pick(profiles.dinucleotide_profile(seqs, "CG", width), "cpg", "nt", "pos", "density"))
    if table is not None:
        out = out.union(pick(profiles.minmax_profile(seqs.where(F.length("dna") % 3 == 0), table), "minmax", "codon", "cpos", "value"))
    if sites:
        for kind in ("donor", "acceptor"):
            out = out.union(pick(profiles.site_scores(seqs, kind), kind, "nt", "pos", "score"))
    return out


def library(proteins: DataFrame, table: DataFrame, n: int, seed: int, rule_list=(), temperature: float = 1.0) -> DataFrame:
    use, rs = {c: math.exp(v) for c, v in log_weights(table).items()}, list(rule_list)
    return solve.solve_batch(proteins, lambda p: [solve.Solution(x, 0, "sampled") for x in solve.sample(p, use, rs, n, seed, temperature)])


def candidates(proteins: DataFrame, table: DataFrame, rule_list=(), n: int = 5, steps: int = 5, refine_steps: int = 0, model=None) -> DataFrame:
    """At most ``n`` designs of each protein from the frontier and, with ``refine_steps``, refined from its points; equal designs once, the first of them.

    Every design is scored before the cut. They are ordered by a calibrated
    expression model's scores, highest first; an uncalibrated one, or none,
    leaves them in the order of discovery. ``source`` says where each is from.
    """
    from pyspark.sql import Window as W

    rows = frontier(proteins, table, rule_list, steps).where("is_front").select("seq_id", "point", "dna", F.lit("frontier").alias("source"))
    if refine_steps:
        w, rs = solve.Weights(log_weights(table)), list(rule_list)
        local = [r for r in rs if r.context < solve.UNBOUNDED]
        whole = [r for r in rs if r not in local]
        seeds = rows.select(F.struct("seq_id", "point").alias("seq_id"), "dna")
        made = kernel(seeds, lambda b: (None, [pa.array([solve.refine(x, w, local, whole, i, refine_steps).dna for i, x in enumerate(b.column(1).to_pylist())], pa.string())]), "refined string", whole=True)
        rows = rows.unionByName(made.select("seq_id.seq_id", (F.col("seq_id.point") + solve.MOST_POINTS).alias("point"), F.col("refined").alias("dna"), F.lit("refined").alias("source")))
    first = W.partitionBy("seq_id", "dna").orderBy("point")
    rows = rows.withColumn("__r", F.row_number().over(first)).where("__r = 1").drop("__r")
    keyed = rows.select(F.struct("seq_id", "point").alias("seq_id"), "dna")
    risk = profiles.sequence_risk(keyed).select("seq_id.*", F.col("risk").alias("splice_risk"))
    rows = rows.join(risk, ["seq_id", "point"], "left").join(expressed(keyed, model or NoExpression()).select("seq_id.*", "expression_score", "expression_model", "expression_calibrated", "expression_units"), ["seq_id", "point"])
    order = W.partitionBy("seq_id").orderBy(F.when(F.col("expression_calibrated"), -F.col("expression_score")).otherwise(0.0), "point")
    basis = F.when(F.col("expression_calibrated"), F.col("expression_model")).otherwise("discovery")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).withColumn("order_basis", basis)


def splice_audit(designs: DataFrame, reference: DataFrame, threshold: float = 0.01, backends=(), width: int = 3) -> tuple[DataFrame, DataFrame]:
    """(sites of the designs with the backends that support each, risk added over the reference).

    A site is supported by a backend with a site of its own within ``width``
    bases; the consensus matrices are always one of them.
    """
    peaks = profiles.peaks(profiles.both_sites(designs), threshold).withColumn("backend", F.lit("pwm"))
    for model in backends:
        peaks = peaks.unionByName(profiles.peaks(tracks_of(designs, model), threshold).withColumn("backend", F.lit(model.name)))
    own, base = profiles.sequence_risk(designs), profiles.sequence_risk(reference)
    added = own.select("seq_id", F.col("risk").alias("r")).join(base.select("seq_id", F.col("risk").alias("b")), "seq_id").select("seq_id", (F.col("r") - F.col("b")).alias("added_risk"), (F.col("b") - F.col("r")).alias("delta_splicing"))
    return profiles.supported(peaks, width), added


def packaging(constructs: DataFrame, limit: str = "aav") -> DataFrame:
    """(seq_id, length_nt, limit_nt, fits) of upstream + dna + downstream."""
    n = F.length(F.concat(F.coalesce("upstream", F.lit("")), "dna", F.coalesce("downstream", F.lit(""))))
    return constructs.select("seq_id", n.alias("length_nt"), F.lit(PACKAGING[limit]).alias("limit_nt"), (n <= PACKAGING[limit]).alias("fits"))


def summary(seqs: DataFrame, table: DataFrame) -> DataFrame:
    """CAI, GC and the additive terms of each sequence, recomputed from the sequence itself."""
    terms = usage.additive_terms(seqs, table).join(usage.adaptation_index(seqs, table).withColumnRenamed("index", "cai"), "seq_id")
    return terms.join(seqs.select("seq_id", gc_count(F.col("dna")).alias("gc_count"), F.length("dna").alias("length_nt")), "seq_id")

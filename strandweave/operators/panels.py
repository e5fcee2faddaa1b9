"""Panels of annotated sequences: cases for the gates, baselines, summaries, and panels drawn or made up with a seed."""

from __future__ import annotations

import itertools
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandweave.core.genetic import CODE
from strandweave.functions.dna import gc_fraction
from strandweave.operators import metrics, studies
from strandweave.operators.etl import content_hash

#: Chromosome names a panel may use, without prefix.
CHROMOSOMES = (*map(str, range(1, 23)), "X", "Y", "M", "MT")


def normal_chromosome(name: Column) -> Column:
    """The name without a chr prefix if it is a known chromosome, else null."""
    bare = F.upper(F.regexp_replace(F.trim(name), "(?i)^chr", ""))
    return F.when(bare.isin(*CHROMOSOMES), bare)


def describe(panel: DataFrame, group: str, contexts: list[str]) -> DataFrame:
    """One row: rows, groups, groups of two members or more, the least and greatest size, distinct contexts, and a digest of the rows."""
    sizes = panel.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    out = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("n") >= 2).alias("n_rankable"), F.min("n").alias("smallest"), F.max("n").alias("largest"))
    distinct = panel.select(F.struct(*contexts).alias("c")).distinct().agg(F.count(F.lit(1)).alias("n_contexts"))
    return out.crossJoin(F.broadcast(distinct)).crossJoin(F.broadcast(content_hash(panel, panel.columns).select("digest")))


def overlap(panel: DataFrame, training: DataFrame, group: str) -> DataFrame:
    """(group, overlap) for the panel's groups: in the training set, or not in it; a null group is unclassified."""
    known = training.select(F.col(group).alias("__g")).distinct()
    rows = panel.select(group).distinct().join(known, F.col(group) == F.col("__g"), "left")
    return rows.select(F.col(group).alias("group"), F.when(F.col(group).isNull(), "unclassified").when(F.col("__g").isNotNull(), "training").otherwise("held_out").alias("overlap"))


def site_cases(windows: DataFrame, scores: DataFrame, offsets: dict[str, int] | None = None, combined: bool = False) -> DataFrame:
    """(window_id, group, kind, pos, predicted, label): a case for every position and kind of windows(window_id, group, sequence, donors, acceptors).

    Sites are expected where ``offsets`` says the backend scores their kind; one
    that falls outside is moved to the edge, so that a miss still counts. With
    ``combined`` both tracks are one, of kind "splice", the higher score of the
    two. ``scores`` has (window_id, kind, pos, score); none is 0.
    """
    shift = offsets or {}
    last = F.length("sequence") - 1
    moved = lambda k: F.transform(F.col(f"{k}s"), lambda p: F.greatest(F.lit(0), F.least(last, p + shift.get(k, 0))))
    places = {"splice": F.concat(moved("donor"), moved("acceptor"))} if combined else {k: moved(k) for k in ("donor", "acceptor")}
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.cast("array<int>").alias("at")) for k, v in places.items()])).alias("k")
    rows = windows.select("window_id", "group", last.alias("last"), kinds).select("window_id", "group", "k.kind", "k.at", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("pos"))
    rows = rows.select("window_id", "group", "kind", "pos", F.array_contains("at", F.col("pos")).cast("int").alias("label"))
    one = scores.groupBy("window_id", F.lit("splice").alias("kind"), "pos").agg(F.max("score").alias("score")) if combined else scores.select("window_id", "kind", "pos", "score")
    return rows.join(one, ["window_id", "kind", "pos"], "left").select("window_id", "group", "kind", "pos", F.coalesce("score", F.lit(0.0)).alias("predicted"), "label")


def motif_at(sequence: Column, pos: Column, kind: Column) -> Column:
    """Whether the canonical dinucleotide stands at a 0-based anchor: GT from a donor on, AG up to an acceptor."""
    donor = sequence.substr(pos + 1, F.lit(2)) == "GT"
    acceptor = (pos >= 1) & (sequence.substr(pos, F.lit(2)) == "AG")
    return F.when(kind == "donor", donor).when(kind == "acceptor", acceptor).otherwise(donor | acceptor)


def site_baseline(name: str, cases: DataFrame, windows: DataFrame, seed: int = 0) -> DataFrame:
    """The cases with the predictions of a baseline: gt_ag, constant (each kind's rate) or permutation within kinds."""
    rest = [c for c in cases.columns if c != "predicted"]
    if name == "gt_ag":
        rows = cases.join(windows.select("window_id", "sequence"), "window_id")
        return rows.withColumn("predicted", motif_at(F.col("sequence"), F.col("pos"), F.col("kind")).cast("double")).select(*cases.columns)
    if name == "constant":
        rate = cases.groupBy("kind").agg(F.avg("label").alias("predicted"))
        return cases.select(*rest).join(F.broadcast(rate), "kind").select(*cases.columns)
    if name == "permutation":
        return studies.permuted(cases, "predicted", ["kind"], seed)
    raise ValueError(f"unknown baseline {name!r}")


def expression_baselines(panel: DataFrame, cai: DataFrame) -> DataFrame:
    """(seq_id, cai, gc3, length, constant) for panel(seq_id, cds): what a model must beat; cai(seq_id, index)."""
    third = F.regexp_replace("cds", "..(.)", "$1")
    return panel.join(cai.select("seq_id", F.col("index").alias("cai")), "seq_id").select("seq_id", "cai", gc_fraction(third).alias("gc3"), F.length("cds").cast("double").alias("length"), F.lit(0.0).alias("constant"))


def best_baseline(panel: DataFrame, features: DataFrame, group: str, names: list[str]) -> DataFrame:
    """(baseline, spearman): rank correlation of each baseline with the measured values, both within groups centred; panel(seq_id, group, measured)."""
    rows = panel.join(features, "seq_id")
    long = rows.select(group, "measured", F.explode(F.array(*[F.struct(F.lit(n).alias("baseline"), F.col(n).alias("v")) for n in names])).alias("f")).select(group, "measured", "f.baseline", "f.v")
    means = long.groupBy(group, "baseline").agg(F.avg("measured").alias("__m"), F.avg("v").alias("__v"))
    centred = long.join(means, [group, "baseline"]).select("baseline", F.round(F.col("measured") - F.col("__m"), 9).alias("y"), F.round(F.col("v") - F.col("__v"), 9).alias("x"))
    return metrics.spearman(centred, ["baseline"], "x", "y").select("baseline", "spearman")


def draw(candidates: DataFrame, n: int, seed: int, least: int, most: int, excluded: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(drawn, tally) of candidates(symbol, length, ...): ``n`` symbols in an order fixed by a seeded hash.

    Excluded symbols, those without a name, outside the lengths, and further
    rows of a symbol are left out, and tallied by reason.
    """
    name = F.trim(F.coalesce("symbol", F.lit("")))
    reason = F.when(name == "", "unnamed").when(name.isin(*excluded), "excluded").when(~F.col("length").between(least, most), "length_window")
    rows = candidates.withColumn("__reason", reason).withColumn("__order", F.xxhash64(F.lit(seed), "symbol"))
    first = W.partitionBy("symbol", F.col("__reason").isNull()).orderBy("length", F.xxhash64(*candidates.columns))
    rows = rows.withColumn("__reason", F.when(F.col("__reason").isNull() & (F.row_number().over(first) > 1), "duplicate_symbol").otherwise(F.col("__reason")))
    drawn = rows.where("__reason is null").orderBy("__order", "symbol").limit(n).select(*candidates.columns)
    return drawn, rows.groupBy(F.coalesce("__reason", F.lit("eligible")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


#: Consensus motifs that probes carry.
DONOR_PROBE, ACCEPTOR_PROBE = "CAGGTAAGT", "TTTTTTTTTTTCAGG"


def random_dna(seed: int, length: int, gc: float = 0.5) -> str:
    rng = random.Random(seed)
    return "".join(rng.choice("GC") if rng.random() < gc else rng.choice("AT") for _ in range(length))


def probe_panel(spark: SparkSession, seed: int = 0, probes: int = 3, flank: int = 300) -> DataFrame:
    """(id, kind, dna): consensus motifs in the middle of random flanks, a short sequence, and GC-rich and GC-poor ones; the same for a seed.

    A panel has a few dozen members, so it is made on the driver.
    """
    rows = []
    for i in range(probes):
        for kind, motif, base in (("donor", DONOR_PROBE, 100), ("acceptor", ACCEPTOR_PROBE, 200)):
            rows.append((f"{kind}_probe_{i}", kind, random_dna(seed + base + 2 * i, flank) + motif + random_dna(seed + base + 2 * i + 1, flank)))
    rows += [("edge_short", "edge", random_dna(seed + 300, 99)), ("edge_gc_high", "edge", random_dna(seed + 301, 600, 0.85)), ("edge_gc_low", "edge", random_dna(seed + 302, 600, 0.15))]
    return spark.createDataFrame(rows, "id string, kind string, dna string")


def _stops(text: str) -> bool:
    return any(CODE[text[i : i + 3]] == "*" for i in range(0, len(text) - 2, 3))


def scrambled(motif: str, junction: int = 3) -> str:
    """A permutation without a stop in frame and without GT at the junction: the middle one of all in sorted order."""
    ok = sorted({p for p in map("".join, itertools.permutations(motif)) if p != motif and not _stops(p) and p[junction : junction + 2] != "GT"})
    if not ok:
        raise ValueError(f"no usable scramble of {motif!r}")
    return ok[len(ok) // 2]


def planted(hosts: DataFrame, motifs: dict[str, str | None], positions: list[int]) -> DataFrame:
    """(seq_id, rung, at, dna, skipped): each host with each motif written over it at each place, a multiple of three; None leaves it as it is.

    A motif that brings a stop into the frame is marked skipped; places
    without room have no row.
    """
    off = [p for p in positions if p % 3]
    if off:
        raise ValueError(f"places out of frame: {off}")
    grid = F.explode(F.array(*[F.struct(F.lit(n).alias("rung"), F.lit(m).cast("string").alias("motif"), F.lit(p).alias("at"), F.lit(bool(m) and _stops(m)).alias("skipped")) for n, m in motifs.items() for p in positions])).alias("g")
    rows = hosts.select("seq_id", "dna", grid).select("seq_id", "g.*", "dna").where(F.col("at") + F.coalesce(F.length("motif"), F.lit(0)) <= F.length("dna"))
    return rows.select("seq_id", "rung", "at", F.when(F.col("motif").isNull(), F.col("dna")).otherwise(F.expr("overlay(dna placing motif from at + 1)")).alias("dna"), "skipped")


def detection(probes: DataFrame, scores: DataFrame, junction: int = 3, window: int = 6) -> DataFrame:
    """(seq_id, rung, at, peak, offset, ratio): the highest score near each planted junction and how far off it is; ratio is over the untouched host's.

    ``scores`` has (probe, pos, score) with probe = struct(seq_id, rung, at);
    the untouched rung is called "host". Skipped probes keep their row without
    a peak.
    """
    want = F.col("at") + (junction - 1)
    rows = probes.select("seq_id", "rung", "at", "skipped", F.struct("seq_id", "rung", "at").alias("probe"))
    near = rows.where("not skipped").join(scores, "probe").where(F.abs(F.col("pos") - want) <= window)
    best = near.groupBy("probe").agg(F.max(F.struct("score", (-F.col("pos")).alias("p"))).alias("b"))
    out = rows.join(best, "probe", "left").select("seq_id", "rung", "at", F.col("b.score").alias("peak"), (-F.col("b.p") - want).alias("offset"))
    base = out.where("rung = 'host'").select("seq_id", "at", F.col("peak").alias("base"))
    return out.join(base, ["seq_id", "at"], "left").select("seq_id", "rung", "at", "peak", "offset", F.when(F.col("base") > 0, F.col("peak") / F.when(F.col("base") > 0, F.col("base"))).alias("ratio"))

"""Studies built on the operators: consistency of sites, agreement of models, spread and confounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandweave.operators.metrics import spearman
from strandweave.operators.positions import kmers


def motif_consistency(sites: DataFrame, seqs: DataFrame, motif: str = "GT", reach: int = 3) -> DataFrame:
    """(offset, share, n): how many sites(seq_id, pos) have the motif at each offset; outside the sequence counts as not."""
    at = kmers(seqs, len(motif)).where(F.col("kmer") == motif).select("seq_id", F.col("pos").alias("at"), F.lit(1).alias("hit"))
    wide = sites.select("seq_id", "pos", F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("offset")).withColumn("at", F.col("pos") + F.col("offset"))
    return wide.join(at, ["seq_id", "at"], "left").groupBy("offset").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1))).alias("share"), F.count(F.lit(1)).alias("n"))


def alignment_probe(sites: DataFrame, scores: DataFrame, reach: int = 5) -> DataFrame:
    """(kind, offset, mean): the offset at which scores(seq_id, kind, pos, score) of the sites(seq_id, kind, pos) are highest on average.

    Ties go to the smaller distance, then to the smaller offset.
    """
    wide = sites.select("seq_id", "kind", "pos", F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("offset")).withColumn("at", F.col("pos") + F.col("offset"))
    found = wide.join(scores.select("seq_id", "kind", F.col("pos").alias("at"), "score"), ["seq_id", "kind", "at"], "left")
    mean = found.groupBy("kind", "offset").agg(F.round(F.avg(F.coalesce("score", F.lit(0.0))), 9).alias("mean"))
    best = mean.groupBy("kind").agg(F.max(F.struct("mean", (-F.abs("offset")).alias("near"), (-F.col("offset")).alias("low"))).alias("b"))
    return best.select("kind", (-F.col("b.low")).alias("offset"), F.col("b.mean").alias("mean"))


def _pairs(long: DataFrame, name: str, case: list[str], value: str) -> DataFrame:
    a = long.select(*case, F.col(name).alias("a"), F.col(value).alias("x"))
    b = long.select(*case, F.col(name).alias("b"), F.col(value).alias("y"))
    return a.join(b, case).where("a < b")


def delta_agreement(deltas: DataFrame, eps: float = 1e-9, by: list[str] | None = None) -> DataFrame:
    """(*by, a, b, n, spearman, sign_agreement) for each pair of backends over deltas(*by, backend, case, delta)."""
    by = by or []
    p = _pairs(deltas, "backend", [*by, "case"], "delta")
    sign = lambda c: F.when(F.abs(c) <= eps, 0).otherwise(F.signum(c))
    signs = p.groupBy(*by, "a", "b").agg(F.avg(F.when(sign(F.col("x")) == sign(F.col("y")), 1.0).otherwise(0.0)).alias("sign_agreement"))
    return spearman(p, [*by, "a", "b"], "x", "y").join(signs, [*by, "a", "b"])


def context_stability(scores: DataFrame) -> DataFrame:
    """(group, stability): median Spearman correlation over all pairs of contexts; scores(group, context, member, score)."""
    p = _pairs(scores, "context", ["group", "member"], "score")
    return spearman(p, ["group", "a", "b"], "x", "y").groupBy("group").agg(F.percentile("spearman", F.lit(0.5)).alias("stability"))


def corrected_stability(stability: DataFrame, fits: DataFrame) -> DataFrame:
    """(group, stability, residual_fraction, corrected): stability times the share of the score that features do not explain, 0 at least; fits(group, adjusted_r2)."""
    share = F.greatest(F.lit(0.0), 1 - F.greatest(F.lit(0.0), F.col("adjusted_r2")))
    return stability.join(fits, "group").select("group", "stability", share.alias("residual_fraction"), (F.col("stability") * share).alias("corrected"))


def context_swap(scores: DataFrame, first: str, second: str, floor: float) -> DataFrame:
    """(member, change, moved): the absolute score change between two contexts, and whether it is over the noise floor."""
    a = scores.where(F.col("context") == first).select("group", "member", F.col("score").alias("x"))
    b = scores.where(F.col("context") == second).select("group", "member", F.col("score").alias("y"))
    return a.join(b, ["group", "member"]).select("group", "member", F.abs(F.col("x") - F.col("y")).alias("change")).withColumn("moved", F.col("change") > floor)


def confounds(df: DataFrame, group: str, score: str, features: list[str]) -> DataFrame:
    """(group, feature, spearman, n) of a score against each feature."""
    long = df.select(group, F.col(score).alias("s"), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])).alias("f")).select(group, "s", "f.feature", "f.v")
    return spearman(long, [group, "feature"], "v", "s")


def spread_ratio(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row: the median standard deviation within groups over that of the group means."""
    g = df.groupBy(group).agg(F.stddev_samp(value).alias("sd"), F.avg(value).alias("m"))
    out = g.agg(F.percentile("sd", F.lit(0.5)).alias("within"), F.stddev_samp("m").alias("between"))
    return out.withColumn("ratio", F.when(F.col("between") > 0, F.col("within") / F.when(F.col("between") > 0, F.col("between"))))


def fold_means(df: DataFrame, key: list[str], prefix: str) -> DataFrame:
    """(*key, value): the mean of the columns named by a prefix in each row, then over the rows of a key; no such column, or a missing value, raises."""
    cols = [c for c in df.columns if c.startswith(prefix)]
    if not cols:
        raise ValueError(f"no column starts with {prefix!r}")
    gap = F.concat_ws(", ", *[F.when(F.col(c).isNull(), F.lit(c)) for c in cols])
    df = df.withColumn(cols[0], F.when(gap != "", F.raise_error(F.concat(F.lit("no value in "), gap)).cast("double")).otherwise(F.col(cols[0]).cast("double")))
    row = sum((F.col(c).cast("double") for c in cols[1:]), F.col(cols[0]).cast("double")) / len(cols)
    return df.select(*key, row.alias("v")).groupBy(*key).agg(F.avg("v").alias("value"))


def fidelity(a: DataFrame, b: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """(deviation, n, faithful): the greatest difference between two arrays a window(window, values), position by position."""
    x = a.select("window", F.posexplode("values").alias("pos", "x"))
    y = b.select("window", F.posexplode("values").alias("pos", "y"))
    out = x.join(y, ["window", "pos"], "full_outer").agg(F.max(F.abs(F.col("x") - F.col("y"))).alias("deviation"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("x").isNull() | F.col("y").isNull()).alias("gaps"))
    return out.select("deviation", "n", (F.coalesce(F.col("deviation") <= tolerance, F.lit(False)) & (F.col("gaps") == 0)).alias("faithful"))


def retention(df: DataFrame, value: str, stratum: str, bins: int = 5) -> DataFrame:
    """One row: the pooled standard deviation within quantile bins of ``stratum`` over the whole one."""
    edges = df.agg(F.percentile(stratum, F.array(*[F.lit(i / bins) for i in range(1, bins)])).alias("e"))
    rows = df.crossJoin(F.broadcast(edges)).withColumn("bin", F.size(F.filter("e", lambda x: x < F.col(stratum))))
    g = rows.groupBy("bin").agg(F.var_pop(value).alias("v"), F.count(F.lit(1)).alias("n"))
    return g.agg(F.sqrt(F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("within")).crossJoin(df.agg(F.stddev_pop(value).alias("whole"))).withColumn("retention", F.when(F.col("whole") > 0, F.col("within") / F.when(F.col("whole") > 0, F.col("whole"))).otherwise(0.0))


def synonymous(members: DataFrame) -> DataFrame:
    """(group, proteins, natives, consistent) of members(group, role, protein): one protein and one native a group."""
    g = members.groupBy("group").agg(F.count_distinct("protein").alias("proteins"), F.count_if(F.col("role") == "native").alias("natives"))
    return g.withColumn("consistent", (F.col("proteins") == 1) & (F.col("natives") == 1))


def permuted(cases: DataFrame, column: str, by: list[str], seed: int = 0) -> DataFrame:
    """The cases with ``column`` dealt anew within groups, in an order fixed by a seeded hash: the baseline without information."""
    rows = cases.withColumn("__h", F.xxhash64(F.lit(seed), *cases.columns))
    a = W.partitionBy(*by).orderBy("__h", *cases.columns)
    b = W.partitionBy(*by).orderBy(F.xxhash64(F.lit(seed + 1), F.col("__h")), *cases.columns)
    left = rows.withColumn("__i", F.row_number().over(a)).drop(column)
    right = rows.select(*by, column, F.row_number().over(b).alias("__i"))
    return left.join(right, [*by, "__i"]).select(*cases.columns)

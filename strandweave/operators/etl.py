"""Reference-data pipelines: pick, resolve, rank and fingerprint records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def cds_reason(dna) -> Column:
    """The first reason why a sequence is no complete coding sequence; null if it is one."""
    inner = F.expr("regexp_replace(substring(dna, 4, greatest(length(dna) - 6, 0)), '(...)', '$1 ')")
    return (
        F.when(~dna.rlike("^[ACGT]+$"), "non_acgt").when(F.length(dna) % 3 != 0, "not_multiple_of_three").when(F.left(dna, F.lit(3)) != "ATG", "no_start")
        .when(~F.right(dna, F.lit(3)).isin("TAA", "TAG", "TGA"), "no_stop").when(inner.rlike("(^| )(TAA|TAG|TGA) "), "internal_stop")
    )


def reason_tally(seqs: DataFrame) -> DataFrame:
    return seqs.select(F.coalesce(cds_reason(F.col("dna")), F.lit("valid")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def representatives(records: DataFrame, gene: str, transcript: str, length: str) -> DataFrame:
    """The longest record of each gene, the lesser transcript on ties."""
    order = W.partitionBy(gene).orderBy(F.col(length).desc(), transcript)
    return records.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def top_by_abundance(records: DataFrame, gene: str, abundance: str, n: int) -> DataFrame:
    """The ``n`` genes of greatest abundance, by gene on ties."""
    return records.groupBy(gene).agg(F.max(abundance).alias(abundance)).orderBy(F.col(abundance).desc(), gene).limit(n)


def resolve_ids(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """(id, resolved, outcome): ambiguous ids first, then exact matches, then matches without the version suffix.

    ``known`` has (id, gene); an id with several genes is ambiguous.
    """
    base = F.regexp_replace("id", r"\.[0-9]+$", "")
    one = known.groupBy("id").agg(F.count_distinct("gene").alias("genes"), F.min("gene").alias("gene"))
    bare = known.withColumn("bare", base).groupBy("bare").agg(F.count_distinct("gene").alias("bare_genes"), F.min("gene").alias("bare_gene"))
    rows = wanted.withColumn("bare", base).join(one, "id", "left").join(bare, "bare", "left")
    outcome = F.when(F.col("genes") > 1, "ambiguous").when(F.col("genes") == 1, "exact").when(F.col("bare_genes") == 1, "unversioned").when(F.col("bare_genes") > 1, "ambiguous").otherwise("missing")
    return rows.withColumn("outcome", outcome).select("id", F.when(F.col("outcome") == "exact", F.col("gene")).when(F.col("outcome") == "unversioned", F.col("bare_gene")).alias("resolved"), "outcome")


def introns(exons: DataFrame) -> DataFrame:
    """(transcript, start, end) between consecutive exons(transcript, start, end)."""
    nxt = F.lead("start").over(W.partitionBy("transcript").orderBy("start", "end"))
    return exons.withColumn("next", nxt).where(F.col("next") > F.col("end")).select("transcript", F.col("end").alias("intron_start"), F.col("next").alias("intron_end"))


def content_hash(df: DataFrame, columns: list[str]) -> DataFrame:
    """One digest of a table's rows in any order: the sum of row digests in 128 bits' worth of decimal halves, then hashed.

    A sorted concatenation would gather the table in one place; sums of row
    hashes combine on the map side.
    """
    row = F.sha2(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns]), 256)
    part = lambda i: F.sum(F.conv(F.substring(row, i, 12), 16, 10).cast("decimal(30,0)"))
    sums = df.agg(F.count(F.lit(1)).alias("n_rows"), part(1).alias("a"), part(13).alias("b"))
    return sums.select("n_rows", F.sha2(F.concat_ws(":", F.col("n_rows").cast("string"), F.coalesce("a", F.lit(0)).cast("string"), F.coalesce("b", F.lit(0)).cast("string")), 256).alias("digest"))


def best_codon_changes(a: DataFrame, b: DataFrame) -> DataFrame:
    """(aa, codon_a, codon_b) of the amino acids whose most frequent codon differs between two usage tables."""
    top = lambda t, n: t.groupBy("aa").agg(F.max_by("codon", F.struct("frequency", F.translate("codon", "ACGT", "TGCA"))).alias(n))
    return top(a, "codon_a").join(top(b, "codon_b"), "aa").where("codon_a <> codon_b")

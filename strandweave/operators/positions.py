"""Sequences as tables of positions, k-mers, codons and runs.

The central relation is sequences(seq_id, dna). A sequence is first cut into
blocks that overlap by k - 1 and the blocks into k-mers, so a long sequence is
read once, not once for each position, and its blocks spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandweave.core.genetic import amino_acid

BLOCK = 240  #: positions a block, a multiple of three so that blocks keep the frame


def kmers(seqs: DataFrame, k: int, step: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """(seq_id, pos, kmer, *keep) for every ``step``-th start; shorter sequences give no row."""
    rows = seqs.where(F.length("dna") >= k)
    starts = F.length("dna") - k + 1
    blocks = rows.select("seq_id", *keep, "dna", F.explode(F.sequence(F.lit(0), F.floor((starts - 1) / BLOCK))).alias("b")).select(
        "seq_id", *keep, (F.col("b") * BLOCK).cast("int").alias("at"), F.expr(f"substring(dna, cast(b * {BLOCK} as int) + 1, {BLOCK + k - 1})").alias("part")
    )
    inside = blocks.select("seq_id", *keep, "at", "part", F.explode(F.sequence(F.lit(0), F.length("part") - k, F.lit(step))).alias("i"))
    return inside.select("seq_id", *keep, (F.col("at") + F.col("i")).alias("pos"), F.expr(f"substring(part, i + 1, {k})").alias("kmer"))


def codons(seqs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(seq_id, cpos, codon, aa, *keep) of the whole codons; the amino acid is looked up, not joined."""
    rows = kmers(seqs, 3, 3, keep)
    return rows.select("seq_id", *keep, (F.col("pos") / 3).cast("int").alias("cpos"), F.col("kmer").alias("codon")).withColumn("aa", amino_acid(F.col("codon")))


def runs(marked: DataFrame, key: str = "key", by: tuple[str, ...] = ("seq_id",), pos: str = "pos") -> DataFrame:
    """Maximal runs of equal ``key`` at consecutive positions: (*by, key, start, end), end excluded."""
    order = W.partitionBy(*by, key).orderBy(pos)
    island = marked.withColumn("__island", F.col(pos) - F.row_number().over(order))
    return island.groupBy(*by, key, "__island").agg(F.min(pos).alias("start"), (F.max(pos) + 1).alias("end")).drop("__island")


def windows(per_pos: DataFrame, width: int, sums: dict[str, str], pos: str = "pos") -> DataFrame:
    """Sums over every full window of ``width`` consecutive rows of a sequence, by first position."""
    order = W.partitionBy("seq_id").orderBy(pos)
    span = order.rowsBetween(0, width - 1)
    cols = [F.sum(c).over(span).alias(name) for name, c in sums.items()]
    return per_pos.select("seq_id", pos, *cols, F.count(F.lit(1)).over(span).alias("__n")).where(F.col("__n") == width).drop("__n")

"""Sequence tables derived from the general test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.core.session import read, spread
from strandweave.functions.dna import coding, dna_letters, protein_letters


def dna_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sequences(seq_id, dna) from the letters of the documents, in the splits that the files have."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), dna_letters(F.col("text")).alias("dna"))
    return docs.where(F.length("dna") > 0)


def dna_doc_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, over all cores: for operators that make a row for each position."""
    return spread(dna_doc(spark, sf_dir))


def cds_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dna_doc(spark, sf_dir).withColumn("dna", coding(F.col("dna"))).where(F.length("dna") > 0)


def cds_doc_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dna_doc_spread(spark, sf_dir).withColumn("dna", coding(F.col("dna"))).where(F.length("dna") > 0)


def _dna_event(events: DataFrame) -> DataFrame:
    return events.select(F.col("event_id").alias("seq_id"), F.translate(F.md5(F.col("event_id").cast("string")), "0123456789abcdef", "ACGTACGTACGTACGT").alias("dna"), "event_type")


def dna_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """32-base sequences from the events."""
    return _dna_event(read(spark, sf_dir, "events"))


def dna_event_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, over all cores: for operators that work long on each sequence; only numbers and types are dealt."""
    return _dna_event(spread(read(spark, sf_dir, "events").select("event_id", "event_type")))


def protein_bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    """proteins(seq_id, protein) from the whole benchmark items."""
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("seq_id"), protein_letters(F.col("text")).alias("protein")).where(F.length("protein") > 0)

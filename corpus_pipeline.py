"""The corpus pipeline: toxic documents go, repeated lines go, one document of each near-duplicate group stays,
documents that hold benchmark items go, and the rest is packed into training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of the documents. Rows without a
doc_id pass the stages that compare documents; null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.core.session import checkpoint, read
from strandweave.llm import decontaminate, linededup, neardup, packing, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under 0.5, from a model of the labelled documents outside the held-out fold."""
    return toxicity.without_toxic(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that five or more share, but for one copy; n_chars follows the text where lines went."""
    out = linededup.without_repeated_lines(docs)
    dropped = F.col(out.columns[-1])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(dropped > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and of near copies (five-word shingles, similarity 0.8 or more): the least doc_id.

    A doc_id that comes with several texts is several documents.
    """
    return neardup.without_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_leaks(docs, read(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of at most 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

ORACLE_SQL = None  # SQL expresses neither the classifier nor the plan of the packing; tests/llm holds each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""Sharding by jump consistent hashing (operator 10)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandweave.core.session import checkpoint, ship


def jump_hash(key: np.ndarray, shards: int) -> np.ndarray:
    """The shard (from 0) of each 64-bit key; adding a shard moves keys only into the new one."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    key = key.astype(np.uint64, copy=True)
    shard = np.zeros(len(key), dtype=np.int64)
    jump = np.zeros(len(key), dtype=np.int64)
    at = np.arange(len(key))
    while len(at):
        shard[at] = jump[at]
        key[at] = key[at] * np.uint64(2862933555777941757) + np.uint64(1)
        jump[at] = ((shard[at] + 1) * (float(1 << 31) / ((key[at] >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        at = at[jump[at] < shards]
    return shard


def numbered(rows: DataFrame, group: list[str], order: list, spread: list[str], name: str) -> DataFrame:
    """``rows`` with a gapless number from 0 within ``group``.

    A group of any size is numbered in slices (by a hash of ``spread``) whose
    counts are summed up first, so no task sorts a whole group. ``rows`` is
    read twice.
    """
    slices = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("__slice", F.pmod(F.xxhash64(*spread), F.lit(slices)).cast("int"))
    before = W.partitionBy(*group).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    base = rows.groupBy(*group, "__slice").count().select(*group, "__slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__base"))
    within = rows.withColumn("__at", F.row_number().over(W.partitionBy(*group, "__slice").orderBy(*order)))
    return within.join(base, [*group, "__slice"]).withColumn(name, (F.col("__base") + F.col("__at") - 1).cast("long")).drop("__slice", "__base", "__at")


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) under the law ``key``.

    The shard is the jump hash of doc_id alone; grown_shard is that with one
    shard more, so it is either the same or the new one. Slots number the rows
    of a shard from 0 without gaps. Only ids, sizes and checksums are shuffled.
    A null text has size 1 and the checksum of no bytes; rows without doc_id
    share one key, repeated rows get slots of their own.
    """
    ship(docs.sparkSession)
    names = ["doc_id", "size", "text_crc32", "shard", "grown_shard"]

    def run(batches):
        for batch in batches:
            key = batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64)
            cols = [batch.column(i) for i in range(3)] + [pa.array(jump_hash(key, n).astype(np.int32)) for n in (shards, shards + 1)]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64("doc_id").alias("key")
    )
    rows = checkpoint(rows.mapInArrow(run, "doc_id long, size long, text_crc32 long, shard int, grown_shard int"))
    out = numbered(rows, ["shard"], ["doc_id", "text_crc32", "size"], ["doc_id", "text_crc32"], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")

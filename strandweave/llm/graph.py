"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.core.session import checkpoint, ship


def _signature(edges: DataFrame) -> tuple:
    """The number of edges and two order-free digests; equal for equal edge sets."""
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", F.lit(7), "a"))).first()
    return tuple(row)


HELD = 500_000  #: most edges whose least neighbours are broadcast
ONE_TASK = 200_000  #: most edges that one task joins by itself


def _to_least(pairs: DataFrame, include_self: bool, few: bool) -> DataFrame:
    """For each (u, v): v with the least of u's neighbours (and of u itself).

    The least neighbour is an aggregate with map-side combine joined back. If
    there are few edges it is broadcast, so the pairs of a vertex with very
    many neighbours stay where they are; else skew-join handling splits them.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    if include_self:
        least = least.select("u", F.least("u", "m").alias("m"))
    return pairs.join(F.broadcast(least) if few else least, "u")


def local_roots(n: int, pairs) -> np.ndarray:
    """The least index connected to each of 0..n-1 by the pairs."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = root[i], root[j]
            off = a != b
            if not off.any():
                break
            i, j, a, b = i[off], j[off], a[off], b[off]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]
    return root


def _joined(edges: DataFrame) -> DataFrame:
    """``components`` of a bounded number of edges in one task."""
    ship(edges.sparkSession)

    def run(batches):
        rows = pa.Table.from_batches(batches, pa.schema([("a", pa.int64()), ("b", pa.int64())]))
        ids, at = np.unique(np.concatenate([rows.column(c).to_numpy() for c in ("a", "b")]), return_inverse=True)
        n = rows.num_rows
        if n:
            root = local_roots(len(ids), [(at[:n].copy(), at[n:].copy())])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root])], names=["id", "component"])

    return edges.select("a", "b").repartition(1).mapInArrow(run, "id long, component long")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in ``edges`` (a long, b long); component is the least id reachable.

    Up to ONE_TASK edges are joined in one task. Beyond, each round is two
    aggregations and two joins on the edges; rounds grow with the logarithm of
    the longest path. Null ids and loops are ignored. Edges
    never reach the driver, which sees one digest row a round.
    """
    edges = checkpoint(
        edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    seen = _signature(edges)
    if seen[0] <= ONE_TASK:
        return _joined(edges)
    while seen[0]:
        few = seen[0] <= HELD
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _to_least(both, True, few).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        near = _to_least(large, False, few)
        small = near.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(near.select(F.col("u").alias("a"), F.col("m").alias("b")))
        edges = checkpoint(small.distinct())
        now = _signature(edges)
        if now == seen:
            break
        seen = now
    tops = edges.groupBy("a").agg(F.min("b").alias("component"))
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return tops.select(F.col("a").alias("id"), "component").union(roots)

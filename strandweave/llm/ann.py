"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables (operator 1).

A table gives a vector a cell: its nearest signed axis after a pseudo-random
rotation, or a pair of them from two rotations where there are over PLAIN
vectors, so that cells stay small as tables grow. A query probes cells in the
order of its own nearness to their axes, as many as the k-th score of a short
first round calls for: how often a vector at some cosine lies among the first
cells follows from the rotation alone, and is tabulated by simulation. Close
neighbours so need few probes, and data without any need many.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandweave.core.session import bounded, checkpoint, ship

PLAIN = 1 << 20  #: distinct vectors beyond which cells are pairs of axes
FIRST = 8  #: cells that the first round probes
TARGET = 0.93  #: chance of finding a vector as near as the k-th of the first round
TILE = 4096  #: distinct vectors, and queries, of one bucket that one task multiplies
GRID = 1_000_000  #: most rows of bucket sizes that are broadcast
_FULL = 63  #: the table whose one cell holds every vector


def rotate(x: np.ndarray, table: int, rounds: int = 3) -> np.ndarray:
    """Pseudo-random rotation: signs flipped, then a fast Hadamard transform, three times over; padded to a power of two."""
    n = 1 << max(1, (x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), n))
    y[:, : x.shape[1]] = x
    rng = np.random.default_rng([table, n])
    for _ in range(rounds):
        y *= rng.choice([-1.0, 1.0], n)
        step = 1
        while step < n:
            z = y.reshape(len(y), n // (2 * step), 2, step)
            y = np.stack([z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]], axis=2).reshape(len(y), n)
            step *= 2
        y /= np.sqrt(n)
    return y


def _sides(x: np.ndarray, table: int, hashes: int) -> list[np.ndarray]:
    """For each of a table's rotations the nearness of every row to the signed axes: the positive sides, then the negative ones."""
    turned = [rotate(x, table * hashes + i) for i in range(hashes)]
    return [np.concatenate([y, -y], axis=1) for y in turned]


def cells(x: np.ndarray, table: int, hashes: int, count: int) -> np.ndarray:
    """The ``count`` nearest cells of each row, nearest first: by the sum of its nearness to their axes."""
    out = []
    for a in range(0, len(x), 64):
        total = None
        for y in _sides(x[a : a + 64], table, hashes):
            total = y if total is None else (total[:, :, None] + y[:, None, :]).reshape(len(y), -1)
        n = min(count, total.shape[1])
        near = np.argpartition(-total, n - 1, axis=1)[:, :n]
        out.append(np.take_along_axis(near, np.argsort(-np.take_along_axis(total, near, axis=1), axis=1, kind="stable"), axis=1))
    return np.concatenate(out) if out else np.zeros((0, 0), np.int64)


@lru_cache
def probing(dim: int, hashes: int, tables: int, target: float, samples: int = 1500) -> tuple[np.ndarray, np.ndarray]:
    """(cosines, plans): for vectors at a cosine from a query the cheapest (tables, cells of each) that find one with the chance ``target``.

    A vector's cell has some rank in the order of the query's; its spread over
    pairs at a cosine is simulated with a fixed seed. Zero cells mean that
    all vectors must be compared.
    """
    rng = np.random.default_rng([dim, hashes])
    cosines = np.round(np.arange(0.0, 1.0, 0.04), 2)
    every = (2 << max(1, (dim - 1).bit_length())) ** hashes
    plans = []
    for c in cosines:
        q, u = (rng.normal(size=(samples, dim)) for _ in range(2))
        q /= np.sqrt((q * q).sum(axis=1, keepdims=True))
        u -= (u * q).sum(axis=1, keepdims=True) * q
        u /= np.maximum(np.sqrt((u * u).sum(axis=1, keepdims=True)), 1e-300)
        sides, other = _sides(q, 0, hashes), _sides(c * q + np.sqrt(1 - c * c) * u, 0, hashes)
        value = sum(np.take_along_axis(y, z.argmax(axis=1)[:, None], axis=1)[:, 0] for y, z in zip(sides, other, strict=True))
        if hashes == 1:
            rank = (sides[0] > value[:, None]).sum(axis=1)
        else:
            ordered = np.sort(sides[1], axis=1)
            rank = np.array([(y.shape[0] - np.searchsorted(o, v - y, side="right")).sum() for y, o, v in zip(sides[0], ordered, value, strict=True)])
        rank.sort()
        best = (every, 1, 0)
        for n in range(1, tables + 1):
            need = 1 + int(rank[min(samples - 1, int(np.ceil(samples * (1 - (1 - target) ** (1 / n)))) - 1)])
            best = min(best, (n * need, n, need))
        plans.append(best[1:])
    return cosines, np.array(plans)


def _valid(c: str):
    x = F.col(c)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return x.isNotNull() & fine & F.exists(x, lambda v: v != 0)


def _clean(vectors: DataFrame) -> DataFrame:
    """(id, v, f4): usable vectors as doubles, or as they are if they are floats."""
    real = dict(vectors.dtypes)["embedding"] == "array<float>"
    v = F.col("embedding") if real else F.col("embedding").cast("array<double>")
    return vectors.where(F.col("vec_id").isNotNull() & _valid("embedding")).select(F.col("vec_id").cast("long").alias("id"), v.alias("v"), F.lit(real).alias("f4"))


def _matrices(batch: pa.RecordBatch):
    """(rows, their vectors as doubles) for each dimension in a batch with a column v."""
    v = batch.column(batch.schema.get_field_index("v"))
    size = pa.compute.list_value_length(v).to_numpy()
    for dim in np.unique(size):
        rows = np.flatnonzero(size == dim)
        yield rows, v.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), int(dim))


def _key(dim: int, table: int, cell=0):
    return (dim * 64 + table << 32) + cell


def _blob(x: np.ndarray, f4: bool) -> list[bytes]:
    return [r.tobytes() for r in x.astype("<f4" if f4 else "<f8")]


def _unblob(column: pa.Array, f4: np.ndarray) -> np.ndarray:
    """The vectors of one bucket, all of one dimension; the two sides may come as floats or as doubles."""
    rows = column.to_pylist()
    return np.stack([np.frombuffer(r, "<f4" if f else "<f8").astype(np.float64) for r, f in zip(rows, f4.tolist(), strict=True)])


_SENT = "key long, band int, id long, floor double, f4 boolean, x binary"
_SENT_NAMES = [c.split()[0] for c in _SENT.split(", ")]


def _index(entries: DataFrame, hashes: int, tables: list[int], data: bool = True) -> DataFrame:
    """Each entry (rep, band, v, f4) in its cell of each table; without ``data`` vectors are left out."""

    def run(batches):
        for batch in batches:
            for rows, x in _matrices(batch):
                part, f4 = batch.take(pa.array(rows)), bool(batch.column(3)[0].as_py())
                unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
                sent = pa.array(_blob(x, f4) if data else [b""] * len(x), pa.binary())
                for t in tables:
                    key = _key(x.shape[1], t) + (0 if t == _FULL else cells(unit, t, hashes, 1)[:, 0])
                    yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(key, len(x))), part.column(1), part.column(0), pa.array(np.zeros(len(x))), part.column(3), sent], names=_SENT_NAMES)

    return entries.select("rep", "band", "v", "f4").mapInArrow(run, _SENT)


def _asks(asked: DataFrame, bands: list[tuple[int, float]], hashes: int, tables: int, first: bool, target: float, data: bool = True) -> DataFrame:
    """Queries (id, v, f4, floor) in the cells that they probe in each norm band, the first round's or all others.

    A band whose longest vector cannot reach the floor is passed over.
    """

    def run(batches):
        for batch in batches:
            for rows, x in _matrices(batch):
                part, f4 = batch.take(pa.array(rows)), bool(batch.column(2)[0].as_py())
                floor = part.column(3).to_numpy(zero_copy_only=False)
                norm = np.sqrt((x * x).sum(axis=1))
                unit = x / norm[:, None]
                sent = pa.array(_blob(x, f4) if data else [b""] * len(x), pa.binary())
                row, key, band = [], [], []
                cosines, plans = probing(x.shape[1], hashes, tables, target)
                ask = []
                for b, longest in bands:
                    if first:
                        ask.append(np.tile([1, FIRST], (len(x), 1)))
                        continue
                    need = floor / (norm * longest)
                    plan = np.where((need >= 0)[:, None], plans[np.clip(np.searchsorted(cosines, need, side="right") - 1, 0, len(cosines) - 1)], [1, 0])
                    plan[need > 1 + 1e-6] = -1
                    ask.append(plan)
                    whole = np.flatnonzero(plan[:, 1] == 0)
                    row, key, band = [*row, whole], [*key, np.full(len(whole), _key(x.shape[1], _FULL))], [*band, np.full(len(whole), b)]
                for t in range(tables):
                    most = max((int(p[p[:, 0] > t, 1].max(initial=0)) for p in ask), default=0)
                    if not most:
                        continue
                    near = cells(unit, t, hashes, most)
                    for (b, _), plan in zip(bands, ask, strict=True):
                        count = np.where(plan[:, 0] > t, plan[:, 1], 0)
                        take = np.arange(near.shape[1])[None, :] < count[:, None]
                        if t == 0 and not first:
                            take[:, :FIRST] = False
                        i, j = np.nonzero(take)
                        row, key, band = [*row, i], [*key, _key(x.shape[1], t) + near[i, j]], [*band, np.full(len(i), b)]
                at = np.concatenate([*row, np.zeros(0, np.int64)])
                for a in range(0, len(at), 1 << 16):
                    cut = slice(a, a + (1 << 16))
                    pick = pa.array(at[cut])
                    cols = [pa.array(np.concatenate(key)[cut]), pa.array(np.concatenate(band)[cut].astype(np.int32)), part.column(0).take(pick), pa.array(floor[at[cut]]), part.column(2).take(pick), sent.take(pick)]
                    yield pa.RecordBatch.from_arrays(cols, names=_SENT_NAMES)

    return asked.select("id", "v", "f4", "floor").mapInArrow(run, _SENT)


def _best(q: np.ndarray, x: np.ndarray, rep: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vector row, score) of each query's k best: larger score, then smaller rep. Scores are summed in one fixed order."""
    s = np.einsum("ij,kj->ik", q, x) if len(x) < 8 else q @ x.T
    k = min(k, len(x))
    near = np.argpartition(-s, k - 1, axis=1)[:, :k]
    floor = np.take_along_axis(s, near, axis=1).min(axis=1) - 1e-12 * np.abs(s).max(axis=1)
    i, j = np.nonzero(s >= floor[:, None])  # all that may tie with the last one
    score = (q[i] * x[j]).sum(axis=1)
    order = np.lexsort((rep[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    head = np.searchsorted(i, np.arange(len(q)))
    keep = np.arange(len(i)) - head[i] < k
    return i[keep], j[keep], score[keep]


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, target: float = TARGET, hashes: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for each query among all other rows, by inner product.

    Both inputs have (vec_id, embedding). Vectors that are null, zero or hold
    null or non-finite components take no part; rows without vec_id neither.
    Vectors are compared with those of their own dimension. Equal vectors are
    one entry that keeps its k + 1 least ids, enough for any answer. Norms are
    banded by powers of two, and a query asks every band that can hold an
    answer, so longer vectors are not missed for their direction. Buckets
    beyond TILE rows are split, on either side, into blocks that are
    multiplied one at a time; every bucket is compared in full. A query with
    fewer than ``k`` others in its first cells, or without a positive k-th
    score, is compared with all vectors. A repeated vec_id with different
    vectors counts each.
    """
    spark = vectors.sparkSession
    ship(spark)
    one = W.partitionBy("v").orderBy("id")
    few = _clean(vectors).distinct().withColumn("n", F.row_number().over(one)).where(F.col("n") <= k + 1)
    entries = few.groupBy("v", "f4").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("rep", F.element_at("ids", 1))
    entries = entries.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))
    entries = checkpoint(entries.withColumn("band", F.floor(F.log2("norm") + 0.5).cast("int")))
    seen = entries.groupBy("band").agg(F.max("norm"), F.count(F.lit(1))).collect()  # a row for each power of two at most
    bands, distinct = sorted((r[0], r[1]) for r in seen), sum(r[2] for r in seen)
    hashes = hashes or (1 if distinct <= PLAIN else 2)
    tables = 2 * hashes
    asked = checkpoint(_clean(queries).distinct().withColumn("floor", F.lit(float("-inf"))))

    found = checkpoint(_nearest(_met(lambda d: _index(entries, hashes, [0], d), lambda d: _asks(asked, bands, hashes, tables, True, target, d), k), k))
    reached = found.groupBy(F.col("query_id").alias("id")).agg(F.min("score").alias("lo"), F.count(F.lit(1)).alias("n")).where(F.col("n") > k)
    known = checkpoint(asked.drop("floor").join(reached, "id", "left").select("id", "v", "f4", F.coalesce("lo", F.lit(float("-inf"))).alias("floor")))
    more = _met(lambda d: _index(entries, hashes, [*range(tables), _FULL], d), lambda d: _asks(known, bands, hashes, tables, False, target, d), k)
    near = _nearest(found.unionByName(more), k)
    wide = near.join(entries.select("rep", "ids"), "rep").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    final = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return wide.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _nearest(found: DataFrame, k: int) -> DataFrame:
    """The k + 1 best entries (query_id, rep, score) of each query, each once."""
    top = W.partitionBy("query_id").orderBy(F.col("score").desc(), "rep")
    return found.withColumn("place", F.dense_rank().over(top)).where(F.col("place") <= k + 1).select("query_id", "rep", "score").distinct()


def _met(index, sought, k: int) -> DataFrame:
    """(query_id, rep, score): for each query in a bucket (key, band) the k + 1 best of each block of it that reach the query's floor.

    ``index`` and ``sought`` give their rows, or only their keys for the sizes
    of the buckets. Buckets that only one side is in are not sent.
    """
    size = index(False).groupBy("key", "band").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    ask = sought(False).groupBy("key", "band").agg(F.ceil(F.count("*") / TILE).cast("int").alias("turns"))
    grid = checkpoint(size.join(ask, ["key", "band"]))  # a row for each table, cell and band at most
    both = bounded(grid, GRID)
    left = index(True).join(both, ["key", "band"]).select("key", "band", F.pmod(F.xxhash64("id"), "tiles").cast("int").alias("tile"), F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), F.lit(1).alias("side"), "id", "floor", "f4", "x")
    right = sought(True).join(both, ["key", "band"]).select("key", "band", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.pmod(F.xxhash64("id"), "turns").cast("int").alias("turn"), F.lit(0).alias("side"), "id", "floor", "f4", "x")
    names = ["query_id", "rep", "score"]

    def run(batches):
        def give(parts):
            table = pa.Table.from_batches(parts).combine_chunks()
            n = int((table.column("side").to_numpy() == 0).sum())
            if not 0 < n < table.num_rows:
                return
            ids, x = table.column("id").to_numpy(), _unblob(table.column("x"), table.column("f4").to_numpy())
            floor = table.column("floor").to_numpy()[:n]
            for a in range(0, n, 1024):
                i, j, score = _best(x[a : min(n, a + 1024)], x[n:], ids[n:], k + 1)
                ok = score >= floor[a + i]
                yield pa.RecordBatch.from_arrays([pa.array(ids[a + i[ok]]), pa.array(ids[n:][j[ok]]), pa.array(score[ok])], names=names)

        held, group = [], None
        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in range(4)]
            new = np.zeros(batch.num_rows, dtype=bool)
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            cut = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if a == b:
                    continue
                key = tuple(c[a] for c in cols)
                if key != group and held:
                    yield from give(held)
                    held = []
                group = key
                held.append(batch.slice(a, b - a))
        if held:
            yield from give(held)

    parts = int(grid.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = ["key", "band", "tile", "turn"]
    return left.unionByName(right).repartition(parts, *block).sortWithinPartitions(*block, "side").mapInArrow(run, "query_id long, rep long, score double")

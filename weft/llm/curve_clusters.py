"""Centroid clustering (Lloyd's rounds, exact integers) over Hilbert-ordered blocks with zone maps.

Vectors are quantised to integers x -> floor(64 x), ordered along a Hilbert curve through the leading
principal axes and cut into blocks of BLOCK vectors, each with the least and largest value of every
component. A round looks at blocks: of the centroids those stay candidates that the block's box can't rule
out, by its distance bounds (the least distance of one centroid from the box exceeds another's largest) and
by the box's largest difference of two distances (the centroid nearest to the box's middle is nearer for every
point in the box). Only candidates are compared with the block's vectors, all at once; a block of one
candidate goes to it unseen. The curve and its axes, fitted on at most SAMPLE vectors, settle the cost, never
the result.

A task returns one sum for each centroid; k and the number of components bound what reaches the driver.

Defined cases: vectors that are null, have another number of components than ``dim`` or hold a null or
non-finite one take no part. A null id is a row like any other ('null' in the hash). Repeated rows count each.
With fewer vectors than k, each is a centroid. Components above LARGEST after quantising raise
ArithmeticError, as their squared distances needn't fit 64 bits. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import cut, partitions_for, tidy

SCALE = 64
K, ROUNDS, DIM = 16, 3, 64
BLOCK = 64
#: Axes and bits of the curve: AXES * BITS is at most 63.
AXES, BITS = 9, 7
SAMPLE = 4096
LARGEST = 1 << 27
#: Up to this component, distances are whole in double.
_DOUBLE = 1 << 20


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of non-negative integers below 2**bits along the Hilbert curve."""
    x = [points[:, i].astype(np.int64) for i in range(points.shape[1])]
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for i in range(len(x)):
            on = x[i] & bit != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] & (1 << level) != 0, (1 << level) - 1, 0)
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for c in x:
            out = out << 1 | (c ^ flip) >> level & 1
    return out


class Curve:
    """Principal axes of a sample, each cut evenly between its extremes there."""

    def __init__(self, sample: np.ndarray) -> None:
        self.mid = sample.mean(0)
        axes = np.linalg.svd(sample - self.mid, full_matrices=False)[2][:AXES]
        self.axes = axes
        at = (sample - self.mid) @ axes.T
        self.low, self.span = at.min(0), np.maximum(at.max(0) - at.min(0), 1e-9)

    def place(self, vectors: np.ndarray) -> np.ndarray:
        at = ((vectors - self.mid) @ self.axes.T - self.low) / self.span
        return hilbert(np.clip(at * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64), BITS)


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Which centroids may be nearest to some point of a box; all arithmetic is whole."""
    least = (np.maximum(0, np.maximum(low - centroids, centroids - high)) ** 2).sum(1)
    most = (np.maximum(abs(centroids - low), abs(high - centroids)) ** 2).sum(1)
    near = int(((2 * centroids - low - high) ** 2).sum(1).argmin())
    apart = centroids - centroids[near]
    norm = (centroids * centroids).sum(1)
    # the largest of |x - near|^2 - |x - c|^2 over the box
    gain = norm[near] - norm + 2 * np.maximum(low * apart, high * apart).sum(1)
    return np.flatnonzero((least <= most.min()) & (gain >= 0))


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's nearest centroid (ties: the first) and squared distance."""
    d = (vectors * vectors).sum(1)[:, None] - 2 * (vectors @ centroids.T) + (centroids * centroids).sum(1)
    own = d.argmin(1)
    return own, d[np.arange(len(d)), own].astype(np.int64)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


@tidy
def _key(batches: Iterator[pa.RecordBatch], curve: Curve, dim: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        place = curve.place(_matrix(b.column("v"), dim).astype(np.float64))
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(place)], ["id", "v", "curve"])


@tidy
def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """Blocks of neighbours with their boxes; rows come in the curve's order."""
    ids, rows = [], np.zeros((0, dim), np.int64)

    def block(n: int) -> pa.RecordBatch:
        m = rows[:n]
        return pa.RecordBatch.from_pydict({"ids": [ids[:n]], "x": [m.reshape(-1)], "low": [m.min(0)], "high": [m.max(0)], "total": [m.sum(0)]}, schema=pa.schema([(c, pa.list_(pa.int64())) for c in ("ids", "x", "low", "high", "total")]))

    for b in batches:
        ids, rows = ids + b.column("id").to_pylist(), np.vstack([rows, _matrix(b.column("v"), dim)])
        while len(ids) >= BLOCK:
            yield block(BLOCK)
            ids, rows = ids[BLOCK:], rows[BLOCK:]
    if ids:
        yield block(len(ids))


def _visited(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, kind: type) -> Iterator[tuple[dict, np.ndarray]]:
    """Each block's columns as arrays, and its candidates."""
    for b in batches:
        for i in range(b.num_rows):
            row = {c: b.column(c)[i].values for c in b.schema.names}
            box = [row[c].to_numpy().astype(kind) for c in ("low", "high")]
            yield row, candidates(*box, centroids)


@tidy
def _sums(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What a task's vectors add to each centroid."""
    k, dim = centroids.shape
    n, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
    for row, some in _visited(batches, centroids, centroids.dtype.type):
        if len(some) == 1:
            n[some[0]] += len(row["ids"])
            total[some[0]] += row["total"].to_numpy()
            continue
        x = row["x"].to_numpy().reshape(-1, dim)
        own = some[nearest(x.astype(centroids.dtype), centroids[some])[0]]
        n += np.bincount(own, minlength=k)
        for j in np.unique(own).tolist():
            total[j] += x[own == j].sum(0)
    used = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used]), pa.array(list(total[used]), pa.list_(pa.int64()))], ["cluster", "n", "total"])


@tidy
def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    for row, some in _visited(batches, centroids, centroids.dtype.type):
        x = row["x"].to_numpy().reshape(-1, centroids.shape[1]).astype(centroids.dtype)
        own, distance = nearest(x, centroids[some])
        yield pa.RecordBatch.from_arrays([row["ids"], pa.array(some[own].astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"])


def integers(vectors: DataFrame, id_col: str, vector_col: str, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(id, v): the vectors that take part, with whole components as doubles."""
    raw = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    fine = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return raw.where(F.col("x").isNotNull() & (F.size("x") == dim) & fine).select("id", F.transform("x", lambda x: F.floor(x * F.lit(float(scale))).cast("double")).alias("v"))


def blocks_of(whole: DataFrame, dim: int, n: int) -> DataFrame:
    """The written table of blocks of (id, v)."""
    drawn = whole.orderBy(F.xxhash64("id", "v")).limit(SAMPLE).toArrow()
    curve = Curve(_matrix(drawn.column("v").combine_chunks(), dim).astype(np.float64))
    keyed = cut(whole.select("id", F.col("v").cast("array<long>").alias("v")).mapInArrow(partial(_key, curve=curve, dim=dim), "id long, v array<long>, curve long").withColumn("row", F.monotonically_increasing_id()), "curve")
    # equal vectors are told apart by their rows, so that no place on the curve is one task's
    parts = max(1, min(partitions_for(keyed.sparkSession), n // (8 * BLOCK) + 1))
    ordered = keyed.repartitionByRange(parts, "curve", "row").sortWithinPartitions("curve", "row")
    return cut(ordered.mapInArrow(partial(_blocks, dim=dim), ", ".join(f"{c} array<long>" for c in ("ids", "x", "low", "high", "total"))), "blocks")


def clusters(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, dim: int = DIM, seed: str = "1:") -> DataFrame:
    """(id column, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector.

    Centroids start as the k vectors with the smallest sha256 of ``seed`` and id; each round assigns all
    vectors to their nearest centroid and moves centroids to the floor of their vectors' mean.
    """
    spark = vectors.sparkSession
    kind = f"`{id_col}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    whole = integers(vectors, id_col, vector_col, dim)
    facts = whole.agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))).alias("most")).first()
    if not facts.n:
        return spark.createDataFrame([], kind)
    if facts.most > LARGEST:
        raise ArithmeticError("vectors are too large for exact squared distances")
    number = np.float64 if facts.most <= _DOUBLE else np.int64
    name = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("null"))), 256)
    first = whole.orderBy(name, "v").limit(k).collect()
    centroids = np.array([r.v for r in first]).astype(np.int64)
    blocks = blocks_of(whole, dim, facts.n)
    for _ in range(rounds):
        part = blocks.mapInArrow(partial(_sums, centroids=centroids.astype(number)), "cluster long, n long, total array<long>")
        sums = part.select("cluster", "n", F.posexplode("total").alias("at", "x")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        for r in sums.collect():
            centroids[r.cluster, r["at"]] = r.x // r.n
    found = cut(blocks.mapInArrow(partial(_assigned, centroids=centroids.astype(number)), "id long, cluster int, distance long"), "assigned")
    inertia = {r.cluster: r.d for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()
    each = spark.createDataFrame([(c, d, sum(inertia.values()), digest(c)) for c, d in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # k rows at most
    return found.join(F.broadcast(each), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

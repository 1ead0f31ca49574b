"""Exact top-k inner products through a pivot-distance index.

Vectors are quantised to integers x -> floor(64 x) and lifted by one coordinate so that all have the
same length M; a query's added coordinate is 0: then |q' - x'|^2 = |q|^2 + M^2 - 2 <q, x>, and the
largest inner products are the nearest lifted vectors. Each vector is keyed by its nearest pivot and its distance from it; a pivot's
vectors, sorted by distance, are cut into annuli, which are the index's blocks in shared files. Queries are
dealt by their own nearest pivot and distance, so that a block of them needs the same annuli; it visits them
in order of the triangle inequality's lower bound max(0, d(q, p) - outer, inner - d(q, p)) and stops once
that bound exceeds every query's k-th distance.

Pivots are fitted on a sample of at most SAMPLE vectors; they grow as the square root of the vectors, up to
an eighth of the sample. Every vector is indexed.

Defined cases: vectors that are null or hold a null or non-finite component take no part, nor do rows
with a null id. A vector shorter than the longest counts as padded with zeros. Rows that share an id
with the query aren't its candidates; other repeated rows are ranked each. Ties go to smaller ids.
Scores are exact integers; where the largest squared length reaches 2**62 they needn't fit 64 bits, and
ArithmeticError is raised. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import cut, open_fs, partitions_for, scratch, tidy, write_file

SCALE = 64
K = 20
PIVOTS = 64
SAMPLE = 4096
#: Vectors in an annulus, at most.
ANNULUS = 256
#: Queries that visit annuli together, at most, and bounds (queries times annuli) that a task holds.
QUERY_BLOCK, BOUNDS = 1024, 4_000_000


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    n = pa.compute.list_value_length(col).to_numpy()
    flat = col.flatten().to_numpy()
    if len(n) and (n == dim).all():
        return flat.reshape(len(n), dim).astype(np.float64)
    out, at = np.zeros((len(n), dim)), 0
    for i, k in enumerate(n.tolist()):
        out[i, :k] = flat[at : at + k]
        at += k
    return out


def fit_pivots(vectors: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Centres of a few rounds of k-means."""
    rng = np.random.default_rng(seed)
    centres = vectors[rng.permutation(len(vectors))[:n]].copy()
    for _ in range(6):
        near = _distances(vectors, centres).argmin(1)
        for j in range(len(centres)):
            own = vectors[near == j]
            if len(own):
                centres[j] = own.mean(0)
    return centres


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T))


def _lift(m: np.ndarray, most: float) -> np.ndarray:
    return np.hstack([m, np.sqrt(np.maximum(0.0, most - (m * m).sum(1)))[:, None]])


@tidy
def _key(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, most: float | None, dim: int) -> Iterator[pa.RecordBatch]:
    """Nearest pivot and distance of each vector, or of each query if ``most`` is None."""
    for b in batches:
        m = _matrix(b.column("v"), dim)
        d = _distances(np.hstack([m, np.zeros((len(m), 1))]) if most is None else _lift(m, most), pivots)
        near = d.argmin(1)
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(near.astype(np.int64)), pa.array(d[np.arange(len(near)), near])], ["vec_id", "v", "pivot", "dist"])


@tidy
def _annuli(batches: Iterator[pa.RecordBatch], folder: str, dim: int) -> Iterator[pa.RecordBatch]:
    """Write a task's annuli; rows come sorted by pivot and distance."""
    from pyspark import TaskContext

    held: list[tuple[int, int, float, np.ndarray]] = []
    part, made = TaskContext.get().partitionId(), 0

    def flush() -> pa.RecordBatch:
        ids, dist = np.array([h[0] for h in held], "<i8"), [h[2] for h in held]
        path = f"{folder}/annulus-{part:06d}-{made:06d}"
        write_file(path, [ids.tobytes(), np.array([h[3] for h in held], "<f8").tobytes()])
        return pa.RecordBatch.from_pydict({"path": [path], "pivot": [held[0][1]], "inner": [dist[0]], "outer": [dist[-1]], "n": [len(held)]})

    for b in batches:
        m = _matrix(b.column("v"), dim)
        for row in zip(b.column("vec_id").to_pylist(), b.column("pivot").to_pylist(), b.column("dist").to_pylist(), m, strict=True):
            if held and (len(held) == ANNULUS or row[1] != held[-1][1]):
                yield flush()
                held, made = [], made + 1
            held.append(row)
    if held:
        yield flush()


#: No score yet.
NONE = np.iinfo(np.int64).min


class Best:
    """Each query's k best (score, id) so far; ties to smaller ids."""

    def __init__(self, ids: np.ndarray, k: int) -> None:
        self.own, self.k = ids, k
        self.score = np.full((len(ids), k), NONE)
        self.id = np.full((len(ids), k), np.iinfo(np.int64).max)

    def offer(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Merge candidates' scores (queries x candidates) into the best of the given queries."""
        scores = np.where(ids[None] == self.own[rows][:, None], NONE, scores)
        some = np.flatnonzero((scores >= self.score[rows, -1:]).any(1))
        for i in some.tolist():
            r = rows[i]
            at = np.flatnonzero((scores[i] >= self.score[r, -1]) & (scores[i] > NONE))
            s, d = np.concatenate([self.score[r], scores[i, at]]), np.concatenate([self.id[r], ids[at]])
            o = np.lexsort((d, ~s))[: self.k]
            self.score[r], self.id[r] = s[o], d[o]


@tidy
def _search(batches: Iterator[pa.RecordBatch], listing: str, pivots: np.ndarray, most: float, dim: int, k: int) -> Iterator[pa.RecordBatch]:
    names = None
    for b in batches:
        if names is None:
            fs, at = open_fs(listing)
            with fs.open_input_stream(at, compression=None) as f:
                table = pa.ipc.open_stream(f.read()).read_all()
            names, pivot = table["path"].to_pylist(), table["pivot"].to_numpy()
            inner, outer = table["inner"].to_numpy(), table["outer"].to_numpy()
        block = max(1, min(QUERY_BLOCK, BOUNDS // max(1, len(names))))
        for first in range(0, b.num_rows, block):
            q_ids = b.column("vec_id").to_numpy()[first : first + block]
            q = _matrix(b.column("v").slice(first, block), dim)
            d = _distances(np.hstack([q, np.zeros((len(q), 1))]), pivots)
            bound = np.maximum(0.0, np.maximum(d[:, pivot] - outer, inner - d[:, pivot]))
            base = (q * q).sum(1) + most
            slack = 1e-6 * (1 + np.sqrt(base))
            best = Best(q_ids, k)
            nearest = bound.min(0)
            for j in np.lexsort((np.arange(len(names)), nearest)).tolist():
                # the k-th score as a squared distance; a margin covers rounding, ties must be visited
                kth = np.where(best.score[:, -1] == NONE, np.inf, base - 2.0 * best.score[:, -1])
                reach = np.sqrt(np.maximum(kth, 0.0)) * (1 + 1e-9) + slack
                if nearest[j] > reach.max():
                    break
                rows = np.flatnonzero(bound[:, j] <= reach)
                if not len(rows):
                    continue
                fs, at = open_fs(names[j])
                with fs.open_input_stream(at, compression=None) as f:
                    raw = f.read()
                n = len(raw) // (8 + 8 * dim)
                ids = np.frombuffer(raw, "<i8", n)
                x = np.frombuffer(raw, "<f8", n * dim, 8 * n).reshape(n, dim)
                # no partial sum passes the largest squared length: up to 2**52 doubles are exact
                best.offer(rows, ids, (q[rows] @ x.T).astype(np.int64) if most < 2.0**52 else q[rows].astype(np.int64) @ x.astype(np.int64).T)
            have = best.score > NONE
            rank = np.broadcast_to(np.arange(1, k + 1, dtype=np.int32), have.shape)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.broadcast_to(q_ids[:, None], have.shape)[have]), pa.array(rank[have]), pa.array(best.id[have]), pa.array(best.score[have])], ["query_id", "rank", "vec_id", "score"]
            )


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the vectors that take part, with integer components as doubles."""
    raw = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    fine = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return raw.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & fine).select("vec_id", F.transform("x", lambda x: F.floor(x * F.lit(float(scale))).cast("double")).alias("v"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, pivots: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k largest inner products; both tables are (vec_id, v)."""
    spark = vectors.sparkSession
    facts = vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("most")).first()
    if not facts.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    q_facts = queries.agg(F.max(F.size("v")).alias("dim"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("most")).first()
    dim, most = max(1, facts.dim, q_facts.dim or 0), max(facts.most, q_facts.most or 0.0)
    if most >= 2.0**62:
        raise ArithmeticError("scores of these vectors needn't fit 64 bits")
    drawn = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    points = np.zeros((len(drawn), dim))
    for i, r in enumerate(drawn):
        points[i, : len(r.v)] = r.v
    pivots = pivots or max(PIVOTS, min(sample // 8, int(facts.n**0.5)))
    centres = fit_pivots(_lift(points, most), min(pivots, len(drawn)))
    folder = scratch(spark, "annuli")
    keyed = cut(vectors.mapInArrow(partial(_key, pivots=centres, most=most, dim=dim), "vec_id long, v array<double>, pivot long, dist double"), "keyed")
    # range partitions split a pivot with many vectors by distance
    ordered = keyed.repartitionByRange(max(1, min(partitions_for(spark), facts.n // (4 * ANNULUS) + 1)), "pivot", "dist", "vec_id").sortWithinPartitions("pivot", "dist", "vec_id")
    annuli = ordered.mapInArrow(partial(_annuli, folder=folder, dim=dim), "path string, pivot long, inner double, outer double, n long").toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, annuli.schema) as w:
        w.write_table(annuli)
    listing = f"{folder}/listing"
    write_file(listing, [sink.getvalue().to_pybytes()])
    n_q = queries.count()
    placed = queries.select("vec_id", "v").mapInArrow(partial(_key, pivots=centres, most=None, dim=dim), "vec_id long, v array<double>, pivot long, dist double")
    dealt = placed.repartitionByRange(max(1, min(partitions_for(spark), n_q // 256 + 1)), "pivot", "dist", "vec_id").sortWithinPartitions("pivot", "dist", "vec_id")
    return dealt.mapInArrow(partial(_search, listing=listing, pivots=centres, most=most, dim=dim, k=k), "query_id long, rank int, vec_id long, score long")

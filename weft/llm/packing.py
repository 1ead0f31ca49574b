"""Pack documents into fixed windows by non-negative least squares over shallow length combinations.

Token ids go to shared files, one a task; only lengths are planned. Documents are cut at multiples
of the window; each remainder is rounded up to a bin of ``grain`` tokens. All combinations of up to
three bins that fill a window are enumerated, NNLS solves how often each is repeated so that the bins'
histogram is met, and the counts are rounded down, a little short of the solution, so that some
remainders are left over. Those are laid end to end and packed greedily: first into the gaps that
rounding up left, then into windows of their own. At most the last window is padded.

Defined cases: a null text is empty, so its only id is the end id. Rows are packed one by one, so
repeated rows and null ids need nothing special. An empty table gives an empty result. Other columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.bpe import default_path, loaded
from weft.llm.common import cut, open_fs, partitions_for, pieces, scratch, small_batches, tidy, write_file
from weft.llm.mixing import ranked

WINDOW = 2048
GRAIN = 16
#: Share of each bin's solution that is left to the greedy pass, which needs tokens to fill gaps with.
SPARE = 0.04
#: Rows and bytes of text that a task holds at a time, beside the tokenizer: one executor runs several.
BATCH_ROWS = 500
BATCH_BYTES = 1 << 20


def combinations(bins: int) -> np.ndarray:
    """A column for each way to write ``bins`` as a sum of up to three numbers from 1: how often each number occurs."""
    found = [(bins,)]
    found += [(a, bins - a) for a in range(1, bins // 2 + 1)]
    found += [(a, b, bins - a - b) for a in range(1, bins // 3 + 1) for b in range(a, (bins - a) // 2 + 1)]
    out = np.zeros((bins, len(found)))
    for j, ways in enumerate(found):
        for a in ways:
            out[a - 1, j] += 1
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """The x >= 0 with least |a x - b|, by the active-set method."""
    n = a.shape[1]
    x, on = np.zeros(n), np.zeros(n, bool)
    near = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(rounds):
        slope = a.T @ (b - a @ x)
        slope[on] = -np.inf
        j = int(slope.argmax())
        if slope[j] <= near:
            break
        on[j] = True
        while True:
            at = np.flatnonzero(on)
            best = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (best > 0).all():
                x[:] = 0
                x[at] = best
                break
            low = best <= 0
            step = float((x[at][low] / np.maximum(x[at][low] - best[low], 1e-300)).min())
            x[at] += step * (best - x[at])
            on[at[x[at] <= 1e-12]] = False
            x[~on] = 0
            if not on.any():
                break
    return x


def solve(histogram: np.ndarray, spare: float = SPARE) -> tuple[np.ndarray, np.ndarray]:
    """Combinations and how often each is used; no bin is used more often than it occurs."""
    ways = combinations(len(histogram))
    times = np.floor(nnls(ways, histogram.astype(float)) * (1 - spare)).astype(np.int64)
    over = ways @ times > histogram
    while over.any():
        times[(ways[over].sum(0) > 0) & (times > 0)] -= 1
        over = ways @ times > histogram
    used = times > 0
    return ways[:, used].astype(np.int64), times[used]


@tidy
def _ids(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, end: int, width: int) -> Iterator[pa.RecordBatch]:
    """Write a task's ids to its file; a row for each document with its place there."""
    part = TaskContext.get().partitionId()
    held: list[tuple[pa.Array, np.ndarray]] = []

    def chunks() -> Iterator[bytes]:
        for whole in batches:
            for b in pieces(whole, "text", BATCH_BYTES):
                ids, at = loaded(tokenizer).encode(b.column("text"), end)
                held.append((b.column("doc_id"), np.diff(at)))
                yield ids.astype(f"<u{width}").tobytes()

    write_file(f"{folder}/ids-{part:06d}.u{width}", chunks())
    place = row = 0
    for docs, n in held:
        at = place + np.cumsum(n) - n
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part)), pa.array(row + np.arange(len(n))), docs, pa.array(at), pa.array(n)], ["part", "row", "doc_id", "at", "n"])
        place, row = place + int(n.sum()), row + len(n)


class Slots:
    """Which sequence and place the k-th remainder of a bin gets."""

    def __init__(self, ways: np.ndarray, times: np.ndarray, grain: int) -> None:
        self.first = np.cumsum(times) - times
        self.sequences = int(times.sum())
        self.bins: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for b in range(ways.shape[0]):
            which, copy = [], []
            for j in np.flatnonzero(ways[b]):
                for c in range(ways[b, j]):
                    which.append(j)
                    copy.append(c)
            w = np.array(which, np.int64)
            self.bins.append((w, np.array(copy, np.int64), np.cumsum(times[w]) if len(w) else np.zeros(0, np.int64)))
        self.times = times

    def room(self, b: int) -> int:
        ends = self.bins[b][2]
        return int(ends[-1]) if len(ends) else 0

    def place(self, b: int, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and place in it (bin * 4 + copy, so that places differ); -1 where no slot is left."""
        which, copy, ends = self.bins[b]
        if not len(ends):
            return np.full(len(k), -1), np.full(len(k), -1)
        s = np.minimum(np.searchsorted(ends, k, "right"), len(ends) - 1)
        j = which[s]
        fits = k < ends[-1]
        return np.where(fits, self.first[j] + k - (ends[s] - self.times[j]), -1), np.where(fits, b * 4 + copy[s], -1)


@tidy
def _assign(batches: Iterator[pa.RecordBatch], slots: Slots, window: int, grain: int) -> Iterator[pa.RecordBatch]:
    """Place each remainder: in a combination's slot, or among those left over.

    Rows come sorted by file, and a file's first (row -1) holds how many remainders of each bin the files before have.
    """
    seen: dict[int, np.ndarray] = {}
    for whole in batches:
        for p, pairs in zip(*(whole.filter(pa.compute.less(whole.column("row"), 0)).column(c).to_pylist() for c in ("part", "before")), strict=True):
            seen[p] = np.zeros(window // grain, np.int64)
            for x in pairs:
                seen[p][x["bin"]] = x["before"]
        b = whole.filter(pa.compute.greater_equal(whole.column("row"), 0))
        part, n = b.column("part").to_numpy(), b.column("n").to_numpy()
        rest = n % window
        kind = np.where(rest > 0, -(-rest // grain) - 1, -1)
        seq, place = np.full(len(n), -1), np.full(len(n), -1)
        for p in np.unique(part).tolist():
            base = seen.get(p, np.zeros(window // grain, np.int64))
            for x in np.unique(kind[part == p]).tolist():
                if x >= 0:
                    at = np.flatnonzero((part == p) & (kind == x))
                    seq[at], place[at] = slots.place(x, base[x] + np.arange(len(at)))
                    base[x] += len(at)
        keep = rest > 0
        cols = [b.column(c).to_numpy()[keep] for c in ("part", "row", "n")]
        yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(rest[keep]), pa.array(seq[keep]), pa.array(place[keep])], ["part", "row", "n", "rest", "seq", "place"])


@tidy
def _counts(batches: Iterator[pa.RecordBatch], window: int, grain: int) -> Iterator[pa.RecordBatch]:
    """Each file's histogram of remainders."""
    for b in batches:
        part, n = b.column("part").to_numpy(), b.column("n").to_numpy()
        for p in np.unique(part).tolist():
            m = n[part == p]
            rest = m % window
            hist = np.bincount(-(-rest[rest > 0] // grain) - 1, minlength=window // grain)
            yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([hist.tolist()], pa.list_(pa.int64()))], ["part", "hist"])


@tidy
def _cut_ids(batches: Iterator[pa.RecordBatch], folder: str, width: int) -> Iterator[pa.RecordBatch]:
    """Read pieces' ids and add their checksums. Rows come sorted by file."""
    name, data = None, np.zeros(0)
    for b in batches:
        sums = np.zeros(b.num_rows, np.int64)
        part, at, start, n = (b.column(c).to_numpy() for c in ("part", "at", "start", "length"))
        for i in range(b.num_rows):
            if part[i] != name:
                name = int(part[i])
                fs, p = open_fs(f"{folder}/ids-{name:06d}.u{width}")
                with fs.open_input_stream(p, compression=None) as f:
                    data = np.frombuffer(f.read(), f"<u{width}")
            a = at[i] + start[i]
            sums[i] = zlib.crc32(data[a : a + n[i]].astype("<u4").tobytes())
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("start"), b.column("length"), pa.array(sums), b.column("n"), b.column("sequence_id"), b.column("offset")],
            ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        )


def pack(docs: DataFrame, tokenizer: str | None = None, end: int = 1, window: int = WINDOW, grain: int = GRAIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark, tokenizer, folder = docs.sparkSession, tokenizer or default_path(), scratch(docs.sparkSession, "ids")
    width = 2 if loaded(tokenizer).whole.get_vocab_size() <= 65536 and end < 65536 else 4
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with small_batches(spark, BATCH_ROWS):
        rows = cut(own.mapInArrow(partial(_ids, folder=folder, tokenizer=tokenizer, end=end, width=width), "part long, row long, doc_id long, at long, n long"), "lengths")
    rows = rows.repartition(partitions_for(spark), "part").sortWithinPartitions("part", "row")

    # a histogram of window / grain counts for each file of ids
    counts = cut(rows.mapInArrow(partial(_counts, window=window, grain=grain), "part long, hist array<long>"), "histograms")
    counts = counts.select("part", F.posexplode("hist").alias("bin", "n")).groupBy("part", "bin").agg(F.sum("n").alias("n")).where("n > 0")
    total = np.zeros(window // grain, np.int64)
    for r in counts.groupBy("bin").agg(F.sum("n").alias("n")).collect():
        total[r.bin] = r.n
    slots = Slots(*solve(total), grain)
    before = ranked(counts.withColumn("_many", F.expr("part div 1024")), ["bin"], "_many", ["part"], F.col("n"), "before").groupBy("part").agg(F.collect_list(F.struct("bin", "before")).alias("before"))
    none = F.lit(None).cast(before.schema["before"].dataType)
    headed = rows.select("part", "row", "n", none.alias("before")).unionByName(before.select("part", F.lit(-1).cast("long").alias("row"), F.lit(0).cast("long").alias("n"), "before"))
    headed = headed.repartition(partitions_for(spark), "part").sortWithinPartitions("part", "row")

    placed = cut(headed.mapInArrow(partial(_assign, slots=slots, window=window, grain=grain), "part long, row long, n long, rest long, seq long, place long"), "placed")
    start = (F.col("n") - F.col("rest")).alias("start")
    fixed = placed.where("seq >= 0")
    # pieces of one sequence are at most three, so their offsets are sums over a list of three
    offsets = fixed.groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("place", "part", "row", "n", "rest"))).alias("all"), F.sum("rest").alias("filled"))
    in_slots = offsets.select("seq", F.posexplode("all").alias("i", "x"), "all").select(
        F.col("x.part").alias("part"), F.col("x.row").alias("row"), (F.col("x.n") - F.col("x.rest")).alias("start"), F.col("x.rest").alias("length"), F.col("seq").alias("sequence_id"),
        F.aggregate(F.slice("all", 1, F.col("i")), F.lit(0).cast("long"), lambda s, x: s + x.rest).alias("offset"),
    )

    left = placed.where("seq < 0").select("part", "row", start, F.col("rest").alias("length"))
    left = _laid_out(left, ["part", "row"], "length", "lo").withColumn("hi", F.col("lo") + F.col("length"))
    gaps = offsets.where(F.col("filled") < window).select("seq", F.col("filled").alias("offset"), (F.lit(window) - F.col("filled")).alias("length"))
    gaps = cut(_laid_out(gaps, ["seq"], "length", "lo").withColumn("hi", F.col("lo") + F.col("length")), "gaps")
    left = cut(left, "left")
    room = int(gaps.agg(F.coalesce(F.max("hi"), F.lit(0))).first()[0])
    spare = int(left.agg(F.coalesce(F.max("hi"), F.lit(0))).first()[0])
    step = 256
    near = lambda df: df.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / step), F.floor((F.col("hi") - 1) / step))))
    a = near(left.where(F.col("lo") < room)).select("part", "row", "start", F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"), "cell")
    g = near(gaps).select("seq", "offset", F.col("lo").alias("g_lo"), F.col("hi").alias("g_hi"), "cell")
    lo, hi = F.greatest("a_lo", "g_lo"), F.least("a_hi", "g_hi")
    in_gaps = a.join(g, "cell").where((lo < hi) & (F.col("cell") == F.floor(lo / step))).select(
        "part", "row", (F.col("start") + lo - F.col("a_lo")).alias("start"), (hi - lo).alias("length"), F.col("seq").alias("sequence_id"), (F.col("offset") + lo - F.col("g_lo")).alias("offset")
    )

    # what is left after the gaps fills windows of its own; whole windows of documents come last
    lo = F.greatest(F.col("lo"), F.lit(room)) - room
    tail = left.where(F.col("hi") > room).select("part", "row", "start", F.col("lo"), lo.alias("t_lo"), (F.col("hi") - room).alias("t_hi"), F.greatest(F.lit(0), F.lit(room) - F.col("lo")).alias("skip"))
    tail = tail.withColumn("w", F.explode(F.sequence(F.floor(F.col("t_lo") / window), F.floor((F.col("t_hi") - 1) / window))))
    p_lo, p_hi = F.greatest(F.col("t_lo"), F.col("w") * window), F.least(F.col("t_hi"), (F.col("w") + 1) * window)
    in_tail = tail.select(
        "part", "row", (F.col("start") + F.col("skip") + p_lo - F.col("t_lo")).alias("start"), (p_hi - p_lo).alias("length"), (F.col("w") + slots.sequences).alias("sequence_id"), (p_lo - F.col("w") * window).alias("offset")
    )
    after = slots.sequences + -(-max(0, spare - room) // window)
    wholes = rows.where(F.col("n") >= window).select("part", "row", F.expr(f"n div {window}").alias("k"))
    wholes = _laid_out(wholes, ["part", "row"], "k", "lo").select("part", "row", "lo", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("i", "_k"))
    whole = wholes.select("part", "row", (F.col("i") * window).cast("long").alias("start"), F.lit(window).cast("long").alias("length"), (F.col("lo") + F.col("i") + after).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    all_pieces = in_slots.unionByName(in_gaps).unionByName(in_tail).unionByName(whole)
    joined = all_pieces.join(rows, ["part", "row"]).select("part", "at", "doc_id", *(F.col(c).cast("long").alias(c) for c in ("start", "length", "sequence_id", "offset")), "n")
    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    sorted_ = joined.repartition(partitions_for(spark), "part").sortWithinPartitions("part", "at", "start")
    return sorted_.mapInArrow(partial(_cut_ids, folder=folder, width=width), kind)


def _laid_out(rows: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Lay rows end to end in order: the sum of ``value`` before each. Buckets of 4096 consecutive keys are summed first."""
    bucket = F.col(order[0]) if len(order) > 1 else F.expr(f"{order[0]} div 4096")
    return ranked(rows.withColumn("_b", bucket).withColumn("_all", F.lit(0)), ["_all"], "_b", order, F.col(value), name).drop("_b", "_all")

"""Mix sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents are shuffled by a keyed hash and laid out along an axis of words, cut evenly
into the source's own number of blocks (sizes differ by a word). Each source has the slots that come
nearest to its target. Slot i of the schedule takes the point frac(i / golden ratio); the point falls
into one source's stretch of the cumulative numbers of slots. What the points give a source beyond its
number is dropped, what they leave out comes at the end. The slot's rank among its source's slots
names the block it takes: rank modulo the source's blocks, in epoch rank div blocks. Golden-ratio
points keep every source's share of any run of slots within a few blocks of its weight.

Defined cases: a null text has no words and is never taken. A null source is a source, last in order.
Null ids are hashed like any other value; rows that repeat id and text are one document, counted and
taken as often as they occur. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import cut, partitions_for, pieces, tidy, unused
from weft.llm.textarrays import word_counts

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Blocks of all sources together, but for those that small sources need to have LEAST_BLOCKS.
SLOTS = 1 << 18
#: Words of a block and blocks of a source, at least; where both can't be, the words count.
LEAST_BLOCK = 16
LEAST_BLOCKS = 1024
#: frac(i / golden ratio) = (i * PHI mod 2**64) / 2**64
PHI = 0x9E3779B97F4A7C15


@tidy
def _sizes(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in pieces(whole, text):
            n = pa.array(word_counts(b.column(text)), pa.int64())
            keep = [i for i, c in enumerate(b.schema.names) if c != text]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), n], [*(b.schema.names[i] for i in keep), "size"])


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, most: float = MAX_EPOCHS) -> dict[str | None, float]:
    """Words to take of each source: shares by repeating weights, none above ``most`` times its size; the excess goes to the rest by weight."""
    order = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode("utf-8", "surrogatepass")))
    left = {s: (n, weights[i % len(weights)]) for i, (s, n) in enumerate(order)}
    rest, out = float(sum(n for _, n in sizes)), {}
    while left:
        whole = sum(w for _, w in left.values())
        above = [s for s, (n, w) in left.items() if rest * w / whole > most * n]
        if not above:
            return out | {s: rest * w / whole for s, (_, w) in left.items()}
        for s in above:
            out[s] = float(most * left.pop(s)[0])
        rest = max(0.0, float(sum(n for _, n in sizes)) - sum(out.values()))
    return out


def block_counts(sizes: dict[str | None, int]) -> dict[str | None, int]:
    """Blocks of each source: about equal tokens, but enough of them that half a block is little beside any source."""
    words = max(LEAST_BLOCK, -(-sum(sizes.values()) // SLOTS))
    return {s: max(-(-n // words), min(LEAST_BLOCKS, -(-n // LEAST_BLOCK))) for s, n in sizes.items()}


@tidy
def _points(batches: Iterator[pa.RecordBatch], bounds: list[float]) -> Iterator[pa.RecordBatch]:
    """Source number of each slot."""
    edges = np.array(bounds)
    for b in batches:
        i = b.column(0).to_numpy().astype(np.uint64)
        u = (i * np.uint64(PHI)).astype(np.float64) / 2.0**64
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.minimum(np.searchsorted(edges, u, "right"), len(edges) - 1).astype(np.int64))], ["slot", "source_no"])


def ranked(rows: DataFrame, keys: list[str], bucket: str, order: list, value, name: str) -> DataFrame:
    """Running sum of ``value`` before each row, along (bucket, order) within keys.

    Buckets are ordered pieces of a group: sums of buckets first, then a window within each bucket, so that no task sees a whole group.
    """
    sums = rows.groupBy(*keys, bucket).agg(F.sum(value).alias("_sum"))
    w = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    first = sums.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col(bucket).alias(f"_{bucket}"), F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_before"))
    same = F.lit(True)
    for k in (*keys, bucket):
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    own = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("_own", F.coalesce(F.sum(value).over(own), F.lit(0)))
        .join(first, same)
        .withColumn(name, (F.col("_own") + F.col("_before")).cast("long"))
        .drop("_own", "_before", *(f"_{k}" for k in keys), f"_{bucket}")
    )


class Mix:
    """A schedule and what it takes, as tables.

    documents: doc_id, source, row, size, source_size, target, start (on its source's axis), taken.
    slots: slot, source_no, rank, block, epoch. blocks: doc_id, source_no, row, block, start, length (words of a document in a block).
    """

    def __init__(self, docs: DataFrame, seed: int = 0, weights: tuple[float, ...] = WEIGHTS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> None:
        spark = docs.sparkSession
        own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("_text"))
        own = own.withColumn("key", F.xxhash64(F.lit(seed), "doc_id", "_text"))
        sized = cut(own.mapInArrow(partial(_sizes, text="_text"), "doc_id long, source string, key long, size long"), "sizes")
        per_source = sized.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).collect()
        goal = targets([(r.source, r.n) for r in per_source], weights)
        names = [r.source for r in per_source if r.n]
        names.sort(key=lambda s: (s is None, (s or "").encode("utf-8", "surrogatepass")))
        sizes = {r.source: r.n for r in per_source}
        n_blocks, number = block_counts(sizes), {s: i for i, s in enumerate(names)}
        facts = [(r.source, number.get(r.source), r.n, goal[r.source], n_blocks[r.source]) for r in per_source]
        table = spark.createDataFrame(facts, "s string, source_no long, source_size long, target double, n_blocks long").coalesce(1)
        # a target of less than half a block still takes one
        quota = [max(round(goal[s] * n_blocks[s] / sizes[s]), int(goal[s] > 0)) for s in names]
        n_slots = sum(quota)
        bounds = (np.cumsum(quota) / max(1, n_slots)).tolist()

        drawn = spark.range(n_slots, numPartitions=min(64, n_slots // 65_536 + 1)).withColumnRenamed("id", "slot")
        drawn = drawn.mapInArrow(partial(_points, bounds=bounds), "slot long, source_no long").withColumn("bucket", F.expr("slot div 8192"))
        drawn = ranked(drawn, ["source_no"], "bucket", ["slot"], F.lit(1), "rank").drop("bucket")
        numbers = spark.createDataFrame([(i, n_blocks[s], quota[i]) for i, s in enumerate(names)], "source_no long, n_blocks long, quota long").coalesce(1)
        drawn = cut(drawn.join(numbers.select("source_no", "quota"), "source_no").where("rank < quota").select("slot", "source_no", "rank"), "drawn")
        have = {r.source_no: r["count"] for r in drawn.groupBy("source_no").count().collect()}
        late = [(i, k) for i, n in enumerate(quota) for k in range(have.get(i, 0), n)]
        late = spark.createDataFrame([(n_slots + j, i, k) for j, (i, k) in enumerate(late)], drawn.schema)
        slots = drawn.unionByName(late).join(numbers.select("source_no", "n_blocks"), "source_no")
        self.slots = slots.select("slot", "source_no", "rank", (F.col("rank") % F.col("n_blocks")).alias("block"), F.expr("rank div n_blocks").alias("epoch"))

        n_rows = sum(r.rows for r in per_source)
        buckets = max(64, n_rows // 2000)
        laid = sized.withColumn("bucket", F.pmod(F.shiftrightunsigned("key", 16), F.lit(buckets)))
        laid = ranked(laid, ["source"], "bucket", ["key", "doc_id"], F.col("size"), "start").withColumn("row", F.monotonically_increasing_id())
        laid = cut(laid.join(table, F.col("source").eqNullSafe(F.col("s"))).drop("s", "bucket"), "laid")
        # block j holds the words from j * source_size div n_blocks on
        first, last = F.expr("((start + 1) * n_blocks - 1) div source_size"), F.expr("((start + size) * n_blocks - 1) div source_size")
        spread = laid.where("size > 0").select("doc_id", "source_no", "row", "size", "start", "source_size", "n_blocks", F.explode(F.sequence(first, last)).alias("block"))
        low, high = F.greatest("start", F.expr("block * source_size div n_blocks")), F.least(F.expr("start + size"), F.expr("(block + 1) * source_size div n_blocks"))
        self.blocks = spread.select("doc_id", "source_no", "row", "block", (low - F.col("start")).alias("from"), (high - low).alias("length"))
        times = self.slots.groupBy("source_no", "block").agg(F.count("*").alias("times"))
        taken = self.blocks.join(times, ["source_no", "block"]).groupBy("row").agg(F.sum(F.col("length") * F.col("times")).alias("taken"))
        self.documents = laid.join(taken, "row", "left").select("doc_id", "source", "key", "row", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """For each row: doc_id, size, source_size, target, taken."""
    return Mix(docs, **how).documents.select("doc_id", "size", "source_size", "target", "taken")


@tidy
def _cut_texts(batches: Iterator[pa.RecordBatch], text: str, size_col: str, taken_col: str) -> Iterator[pa.RecordBatch]:
    """Repeat each text as often as taken whole, and once more the words of each part."""
    from weft.llm.textarrays import text_bytes, word_spans

    for whole in batches:
        for b in pieces(whole, text):
            raw, off = text_bytes(b.column(text))
            starts, ends, before = word_spans(raw, off)
            rows: list[int] = []
            texts: list[str | None] = []
            for i, (size, taken, own) in enumerate(zip(b.column(size_col).to_pylist(), b.column(taken_col).to_pylist(), b.column(text).to_pylist(), strict=True)):
                times, rest = divmod(taken, size) if size else (0, 0)
                rows += [i] * (times + (rest > 0))
                texts += [own] * times
                if rest:
                    texts.append(raw[off[i] : ends[before[i] + rest - 1]].tobytes().decode("utf-8", "replace"))
            if rows:
                taken_rows = b.take(pa.array(rows))
                keep = [c for c in b.schema.names if c not in (size_col, taken_col)]
                made = pa.array(texts, pa.string())
                length = pa.compute.utf8_length(made).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([made if c == text else length if c == "n_chars" and pa.types.is_int64(b.schema.field(c).type) else taken_rows.column(c) for c in keep], keep)


def mixed_documents(docs: DataFrame, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The mix as documents with their columns: each text as often as it is taken whole, and its first words where a part is taken."""
    taken = Mix(docs, seed=seed, id_col=id_col, text_col=text_col, **how).documents.where("taken > 0").groupBy("doc_id", "key").agg(F.max("size").alias("size"), F.sum("taken").alias("sum"), F.count("*").alias("n"))
    own, key, size, part = unused(docs, "id", "key", "size", "taken")
    rows = docs.withColumns({own: F.col(id_col).cast("long"), key: F.xxhash64(F.lit(seed), F.col(id_col).cast("long"), F.col(text_col))})
    taken = taken.select(F.col("doc_id").alias("t_id"), F.col("key").alias("t_key"), F.col("size").alias(size), F.expr("sum div n").alias(part)).withColumnsRenamed({"t_id": f"{own}t", "t_key": f"{key}t"})
    joined = rows.join(taken, F.col(own).eqNullSafe(F.col(f"{own}t")) & (F.col(key) == F.col(f"{key}t")))
    names = [*(F.col(f"`{c}`") for c in docs.columns), size, part]
    return joined.select(*names).mapInArrow(partial(_cut_texts, text=text_col, size_col=size, taken_col=part), docs.schema)

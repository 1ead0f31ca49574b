"""Greedy batches of consecutive rows, found in parallel.

Where a batch ends depends only on where it starts: the next batch starts at the first row whose inclusive
prefix sum passes a budget above the start's own prefix sum. So every row has a next start, and the batches
are the rows that next starts reach from the first row.

Rows are ranked over the whole table by range partitions and packed into blocks of BLOCK_ROWS ranks, BLOCKS at
most; larger inputs have larger blocks. Prefix sums at the ends of blocks (BLOCKS numbers a budget) go to every
task. Within its block a row's next start is found by binary search. Rows whose next start lies beyond their
block ask the block that holds it, found by its end's prefix sum; a block that many rows ask is given to as many
tasks as it takes to keep each at BLOCK_ROWS of them. In each block the rows that are asked for are where batches
may enter it; each is followed to where it leaves, and pointer doubling over these (entry, next entry) pairs marks
the entries that the first row reaches, in as many joins as the number of blocks has binary digits. A last
pass numbers the batches of each block from its entry. No task holds more than a block and BLOCK_ROWS questions.
Packed blocks take little of a file, so Spark would take them and their numbers for small tables: joins with them are
merge joins by hint, lest all rows be broadcast through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.structure import ordered_rank, written

BLOCKS = 65_536
BLOCK_ROWS = 65_536
_FAR = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Sums:
    """Budgets, ranks in a block, and prefix sums by budget at the ends of all blocks."""

    limits: np.ndarray
    size: int
    ends: np.ndarray

    def block(self, b: pa.RecordBatch, i: int) -> tuple[int, np.ndarray, np.ndarray]:
        """A packed block's number, sizes and inclusive prefix sums (rows x budgets)."""
        no = b.column("block")[i].as_py()
        x = b.column("x")[i].values.to_numpy().reshape(-1, len(self.limits))
        before = self.ends[no - 1] if no else np.zeros(len(self.limits), np.int64)
        return no, x, before + np.cumsum(x, axis=0)

    def thresholds(self, x: np.ndarray, s: np.ndarray) -> np.ndarray:
        return s - x + self.limits

    def next_in(self, x: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Place of each row's next start in its block; the block's length if it lies beyond."""
        t = self.thresholds(x, s)
        return np.min([np.searchsorted(s[:, c], t[:, c], "right") for c in range(len(self.limits))], axis=0)


def _blocks(batches: Iterator[pa.RecordBatch], fn) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            out = fn(b, i)
            if out.num_rows:
                yield out


def _questions(sums: Sums, b: pa.RecordBatch, i: int) -> pa.RecordBatch:
    """(block, from, t): which block holds a row's next start, and the sums to pass there."""
    no, x, s = sums.block(b, i)
    beyond = np.flatnonzero(sums.next_in(x, s) == len(x))
    t = sums.thresholds(x, s)[beyond]
    at = np.array([np.searchsorted(sums.ends[:, c], t[:, c], "right") for c in range(len(sums.limits))]).reshape(len(sums.limits), -1)
    block = at.min(0)
    some = block < len(sums.ends)
    t = np.where(at.T == block[:, None], t, _FAR)[some]
    return pa.RecordBatch.from_arrays([pa.array(block[some]), pa.array(no * sums.size + beyond[some]), pa.array(list(t), pa.list_(pa.int64()))], ["block", "from", "t"])


def _answers(sums: Sums, b: pa.RecordBatch, i: int) -> pa.RecordBatch:
    """(from, to): next starts of the rows that ask this block."""
    no, _, s = sums.block(b, i)
    asked = b.column("asked")[i].values
    t = asked.field("t").flatten().to_numpy().reshape(-1, len(sums.limits))
    to = np.min([np.searchsorted(s[:, c], t[:, c], "right") for c in range(len(sums.limits))], axis=0)
    return pa.RecordBatch.from_arrays([asked.field("from"), pa.array(no * sums.size + to)], ["from", "to"])


def _leaves(sums: Sums, b: pa.RecordBatch, i: int) -> pa.RecordBatch:
    """(entry, last): the last batch start in the block, for each row where batches may enter it."""
    no, x, s = sums.block(b, i)
    own = np.arange(len(x))
    to = sums.next_in(x, s)
    to = np.where(to == len(x), own, to)
    for _ in range(len(x).bit_length()):
        to = to[to]
    entry = b.column("entries")[i].values.to_numpy()
    return pa.RecordBatch.from_arrays([pa.array(entry), pa.array(no * sums.size + to[entry - no * sums.size])], ["entry", "last"])


def _starts(sums: Sums, entry: int | None, no: int, x: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Which rows of a block start a batch."""
    new = np.zeros(len(x), bool)
    if entry is not None:
        to, at = sums.next_in(x, s).tolist(), entry - no * sums.size
        while at < len(x):
            new[at] = True
            at = to[at]
    return new


def _counts(sums: Sums, entries: dict[int, int], b: pa.RecordBatch, i: int) -> pa.RecordBatch:
    no, x, s = sums.block(b, i)
    return pa.RecordBatch.from_pydict({"block": [no], "n": [int(_starts(sums, entries.get(no), no, x, s).sum())]})


def _numbers(sums: Sums, entries: dict[int, int], before: np.ndarray, b: pa.RecordBatch, i: int) -> pa.RecordBatch:
    no, x, s = sums.block(b, i)
    batch = before[no] - 1 + np.cumsum(_starts(sums, entries.get(no), no, x, s))
    return pa.RecordBatch.from_arrays([pa.array(no * sums.size + np.arange(len(x))), pa.array(batch)], ["_rank", "batch"])


def _on(df: DataFrame, fn, schema: str, *known) -> DataFrame:
    return df.mapInArrow(partial(_blocks, fn=partial(fn, *known)), schema)


def greedy_batches(sized: DataFrame, limits: dict[str, int], order: list[str]) -> DataFrame:
    """``batch`` numbers, from 0, added to rows of sizes taken in order (of the columns, which should be unique)."""
    cols = list(limits)
    most = sized.agg(*(F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in cols), F.count("*").alias("_n")).first()
    if over := [c for c in cols if most[c] > limits[c]]:
        raise ValueError(f"a graph alone breaks the budget of {over}")
    if not most["_n"]:
        return sized.withColumn("batch", F.lit(None).cast("long"))
    n = most["_n"]
    size = max(BLOCK_ROWS, -(-n // BLOCKS))
    count = -(-n // size)
    ranked = written(ordered_rank(sized, order, "_rank"), "ranked")
    block = F.floor(F.col("_rank") / F.lit(size)).cast("long").alias("block")
    rows = ranked.groupBy(block).agg(F.array_sort(F.collect_list(F.struct("_rank", *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(f"x{i}") for i, c in enumerate(cols))))).alias("r"))
    packed = written(rows.select("block", F.flatten(F.transform("r", lambda r: F.array(*(r[f"x{i}"] for i in range(len(cols)))))).alias("x")), "blocks")
    total = np.zeros((count, len(cols)), np.int64)
    for r in ranked.groupBy(block).agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(f"x{i}") for i, c in enumerate(cols))).collect():
        total[r.block] = [r[f"x{i}"] for i in range(len(cols))]
    sums = Sums(np.array([limits[c] for c in cols], np.int64), size, np.cumsum(total, axis=0))
    entries = {0: 0}
    if count > 1:
        asked = written(_on(packed, _questions, "block long, from long, t array<long>", sums), "questions")
        # a block that many rows ask is given to several tasks
        ways = asked.groupBy("block").agg(F.ceil(F.count("*") / F.lit(BLOCK_ROWS)).cast("long").alias("ways"))
        way = asked.join(F.broadcast(ways), "block").withColumn("way", F.pmod(F.xxhash64("from"), F.col("ways")))
        lists = way.groupBy("block", "way").agg(F.collect_list(F.struct("from", "t")).alias("asked"))
        nexts = written(_on(packed.join(lists.hint("merge"), "block").select("block", "x", "asked"), _answers, "from long, to long", sums), "nexts")
        entry = nexts.select(F.col("to").alias("entry")).union(nexts.sparkSession.range(1).select("id")).distinct()
        by = entry.groupBy(F.floor(F.col("entry") / F.lit(size)).cast("long").alias("block")).agg(F.collect_list("entry").alias("entries"))
        leaves = _on(packed.join(by.hint("merge"), "block").select("block", "x", "entries"), _leaves, "entry long, last long", sums)
        hops = written(leaves.join(nexts.withColumnRenamed("from", "last"), "last").select("entry", "to"), "hops")
        reached = nexts.sparkSession.range(1).select(F.col("id").alias("entry"))
        for _ in range((count - 1).bit_length()):
            reached = written(reached.union(reached.join(hops, "entry").select("to")).distinct(), "reached")
            hops = written(hops.select("entry", F.col("to").alias("via")).join(hops.select(F.col("entry").alias("via"), "to"), "via").select("entry", "to"), "hops")
        # batches enter a block once at most
        entries = {r.entry // size: r.entry for r in reached.collect()}
    before = np.zeros(count, np.int64)
    for r in _on(packed, _counts, "block long, n long", sums, entries).collect():
        before[r.block] = r.n
    before = np.cumsum(before) - before
    numbers = _on(packed, _numbers, "_rank long, batch long", sums, entries, before)
    return ranked.join(numbers.hint("merge"), "_rank").select(*sized.columns, "batch")

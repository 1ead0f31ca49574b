"""The moving average of what a filter removes, over a whole table in parallel and over a stream.

Row t of a sequence moves the average by max(1 - decay, 1 / t) of the way to 1 if it is removed, to 0 if it is
kept; every some rows it is reported. One step is x -> a x + b, and steps compose, so blocks of rows are
composed apart, their (a, b) are joined in order (BLOCKS pairs at most, on the driver), and a second pass
reports from each block's start.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.operators.structure import ordered_rank, written

BLOCKS = 65_536
BLOCK_ROWS = 65_536


def rates(first: int, n: int, decay: float) -> np.ndarray:
    """How far rows first + 1 to first + n move the average."""
    return np.maximum(1.0 - decay, 1.0 / np.arange(first + 1, first + n + 1))


def steps(value: float, removed: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """The average after each row."""
    out = np.empty(len(removed))
    for i, (x, r) in enumerate(zip(removed.tolist(), rate.tolist(), strict=True)):
        value += r * (x - value)
        out[i] = value
    return out


def _composed(batches: Iterator[pa.RecordBatch], size: int, decay: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for no, flags in zip(b.column("block").to_pylist(), b.column("removed"), strict=True):
            x = np.frombuffer(flags.as_py(), np.uint8)
            r = rates(no * size, len(x), decay)
            # all rows but the last of them leave it this share
            left = np.append(np.cumprod((1 - r)[::-1])[::-1][1:], 1.0)
            yield pa.RecordBatch.from_pydict({"block": [no], "a": [float(np.prod(1 - r))], "b": [float((left * r * x).sum())], "kept": [int((x == 0).sum())]})


def _reports(batches: Iterator[pa.RecordBatch], size: int, decay: float, every: int, start: dict[int, tuple[float, int]]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for no, flags in zip(b.column("block").to_pylist(), b.column("removed"), strict=True):
            x = np.frombuffer(flags.as_py(), np.uint8)
            value, kept = start[no]
            seen = no * size + np.arange(1, len(x) + 1)
            average = steps(value, x, rates(no * size, len(x), decay))
            at = np.flatnonzero(seen % every == 0)
            if len(at):
                step = np.maximum(kept + np.cumsum(x == 0) - 1, 0)
                yield pa.RecordBatch.from_arrays([pa.array(seen[at]), pa.array(step[at].astype(np.int64)), pa.array(average[at])], ["seen", "step", "average"])


def filter_with_average(df: DataFrame, keep: Column, order: list[str], every: int = 1000, decay: float = 0.999) -> tuple[DataFrame, DataFrame]:
    """The rows that pass, and the reports (seen, step, average): after each ``every`` rows in order, the rows seen, the
    number of the last row kept, and the moving average of the share removed. A null counts as removed; ``order``
    should tell rows apart."""
    flag = F.coalesce(keep, F.lit(False))
    ranked = written(ordered_rank(df.select(*order, (~flag).cast("byte").alias("_removed")), order, "_rank"), "ranked")
    n = ranked.count()
    size = max(BLOCK_ROWS, -(-n // BLOCKS))
    block = F.floor(F.col("_rank") / F.lit(size)).cast("long").alias("block")
    flags = F.transform(F.array_sort(F.collect_list(F.struct("_rank", "_removed"))), lambda r: F.when(r["_removed"] == 1, "01").otherwise("00"))
    packed = written(ranked.groupBy(block).agg(F.unhex(F.array_join(flags, "")).alias("removed")), "blocks")
    pairs = {r.block: r for r in packed.mapInArrow(partial(_composed, size=size, decay=decay), "block long, a double, b double, kept long").collect()}
    start, value, kept = {}, 0.0, 0
    for no in sorted(pairs):
        start[no] = (value, kept)
        value, kept = pairs[no].a * value + pairs[no].b, kept + pairs[no].kept
    return df.where(flag), packed.mapInArrow(partial(_reports, size=size, decay=decay, every=every, start=start), "seen long, step long, average double")


def stream_averages(df: DataFrame, keep: Column, by: str, order: str, every: int = 1000, decay: float = 0.999) -> DataFrame:
    """The reports (key, seen, step, average) of a stream, by key: rows of a micro-batch count in order of a column, after
    those of the batches before. Counts and average are the state, so a stream that starts again goes on from there."""

    def fn(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen, kept, value = state.get if state.exists else (0, 0, 0.0)
        rows = pd.concat(list(parts)).sort_values("_order", kind="stable")
        x = rows["_removed"].to_numpy(np.uint8)
        average = steps(value, x, rates(seen, len(x), decay))
        count = seen + np.arange(1, len(x) + 1)
        total = kept + np.cumsum(x == 0)
        at = np.flatnonzero(count % every == 0)
        if len(x):
            state.update((int(count[-1]), int(total[-1]), float(average[-1])))
        yield pd.DataFrame({"key": [str(key[0])] * len(at), "seen": count[at], "step": np.maximum(total[at] - 1, 0).astype(np.int64), "average": average[at]})

    rows = df.select(F.col(by).alias("_key"), F.col(order).alias("_order"), (~F.coalesce(keep, F.lit(False))).cast("byte").alias("_removed"))
    return rows.groupBy("_key").applyInPandasWithState(fn, "key string, seen long, step long, average double", "seen long, kept long, average double", "append", "NoTimeout")

"""Bounded sketches of a table's 64-bit keys, built in parallel and small enough to broadcast."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weft.llm.common import tidy

SEGMENTS = 16


@tidy
def _marks(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    held = np.zeros(1 << bits, bool)
    for b in batches:
        held[places(b.column(0).to_numpy(), bits)] = True
    packed = np.packbits(held).reshape(SEGMENTS, -1)
    some = [i for i in range(SEGMENTS) if packed[i].any()]
    if some:
        yield pa.RecordBatch.from_pydict({"segment": pa.array(some, pa.int64()), "data": [packed[i].tobytes() for i in some]})


@tidy
def _either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for b in batches:
        for s, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x = np.frombuffer(d, np.uint8)
            held[s] = held[s] | x if s in held else x
    if held:
        yield pa.RecordBatch.from_pydict({"segment": pa.array(list(held), pa.int64()), "data": [x.tobytes() for x in held.values()]})


def places(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) >> np.uint64(64 - bits)).astype(np.int64)


def bitmap(keys: DataFrame, bits: int = 24) -> np.ndarray:
    """Which of 2**bits places (of a multiplicative hash) hold a key of the table's only column: 2**bits / 8 bytes."""
    kind = "segment long, data binary"
    found = keys.mapInArrow(partial(_marks, bits=bits), kind).repartition(SEGMENTS, "segment").mapInArrow(_either, kind).collect()
    out = np.zeros((SEGMENTS, (1 << bits) // 8 // SEGMENTS), np.uint8)
    for r in found:
        out[r.segment] |= np.frombuffer(r.data, np.uint8)
    return out.reshape(-1)


def has(marks: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be in the table."""
    at = places(keys, (len(marks) * 8).bit_length() - 1)
    return (marks[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)

"""Words of whole batches as numpy and Arrow arrays.

A word is a maximal run of bytes other than space and ``\\x09``-``\\x0D``; no byte of a longer UTF-8
character is one of these, so bytes and characters agree. A null text has no words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)
_KIND[65:91] = _KIND[97:123] = 1
_KIND[[ord(c) for c in ".,!?;:"]] = 2

#: Longer spans are hashed one by one.
LONG_SPAN = 4096

#: Odd multipliers of the hashes below; any fixed odd numbers do.
BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array, and where each text starts (with the end of the last)."""
    texts = texts.fill_null("") if texts.null_count else texts
    texts = texts.cast(pa.large_string())
    off = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1 + texts.offset)[texts.offset :]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def lowered(raw: np.ndarray) -> np.ndarray:
    """Bytes with A to Z in lower case."""
    return _LOWER[raw]


def word_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the number of words before it (one more at the end)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    ink = ~_SPACE[raw]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    cuts = off[(off > 0) & (off < len(raw))]
    first[cuts] = ink[cuts]
    last[cuts - 1] = ink[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def words(texts: pa.Array, lower: bool) -> tuple[pa.LargeStringArray, np.ndarray]:
    """All words of a batch as one Arrow array, and for each text the number of words before it."""
    raw, off = text_bytes(texts)
    return strings(raw, *word_spans(raw, off), lower)


def strings(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray, lower: bool) -> tuple[pa.LargeStringArray, np.ndarray]:
    """The spans, which hold all bytes but white space, as an Arrow array."""
    data = raw[~_SPACE[raw]]
    if lower:
        data = _LOWER[data]
    bounds = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=bounds[1:])
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))), before


def letter_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As word_spans, with words cut further wherever an ASCII letter meets one of ``.,!?;:``."""
    starts, ends, before = word_spans(raw, off)
    if not len(raw):
        return starts, ends, before
    kind = _KIND[raw]
    meet = np.flatnonzero((kind[1:] | kind[:-1]) == 3) + 1
    meet = meet[~_member(meet, off)]
    starts = np.sort(np.concatenate([starts, meet]), kind="stable")
    ends = np.sort(np.concatenate([ends, meet]), kind="stable")
    return starts, ends, np.searchsorted(starts, off)


def _member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit hash over all its bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * _MIX
    h = h ^ (h >> np.uint64(29))
    h = h * BASE
    return h ^ (h >> np.uint64(32))


def powers(n: int) -> np.ndarray:
    p = np.full(n, BASE)
    p[:1] = 1
    return np.multiply.accumulate(p)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes: eight bytes at a time, spread between them; of long spans by blake2b."""
    n = ends - starts
    h = mix(n.astype(np.uint64) + BASE)
    if not len(n):
        return h
    eights = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    keep = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
    long = n > LONG_SPAN
    rows, at = np.flatnonzero((n > 0) & ~long), 0
    while len(rows):
        part = np.ascontiguousarray(eights[starts[rows] + at]).view("<u8")[:, 0]
        h[rows] = mix(h[rows] ^ (part & keep[np.minimum(n[rows] - at, 8)]))
        at += 8
        rows = rows[n[rows] > at]
    for i in np.flatnonzero(long).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return h


def string_hashes(values: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string."""
    raw, off = text_bytes(values)
    return span_hashes(raw, off[:-1], off[1:])


def word_hashes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and for each text the number of words before it."""
    raw, off = text_bytes(texts)
    starts, ends, before = word_spans(raw, off)
    return span_hashes(_LOWER[raw] if lower else raw, starts, ends), before


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each run of k word hashes; of fewer words, one hash of them all; of none, nothing."""
    k_ = min(k, len(h))
    if not k_:
        return np.zeros(0, np.uint64)
    p, n = powers(k_ + 1)[1:], len(h) - k_ + 1
    s = np.full(n, k_, np.uint64)
    for i in range(k_):
        s += h[i : i + n] * p[i]
    return mix(s)


def word_counts(texts: pa.Array) -> np.ndarray:
    """Words of each text."""
    raw, off = text_bytes(texts)
    return np.diff(word_spans(raw, off)[2])

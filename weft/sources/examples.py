"""Examples by columns: checksums, framing and wire format over whole Arrow batches.

What is long (lists of numbers, strings, checksums) is done by numpy for all rows of a batch at once; a Python
step a row only walks over the few fields of its Example. Arrays of any depth are stored flat, with the lengths
of their inner arrays as ``<name>.d1`` (those in the outermost), ``<name>.d2`` and so on.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import types as T

#: Bytes that a record's checksum takes at a time, each such run apart from the others.
RUN = 512
HEAD = 12
#: Bytes of records that are decoded together.
BATCH = 4 << 20


@cache
def _one() -> np.ndarray:
    """CRC-32C of a byte, from the reflected polynomial."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = one >> np.uint32(1) ^ np.where(one & np.uint32(1), np.uint32(0x82F63B78), np.uint32(0))
    return one


@cache
def _tables() -> np.ndarray:
    """CRC-32C of two bytes followed by 6, 4, 2 or 0 zero bytes: 4 x 65536."""
    one = _one()
    two = np.arange(65536, dtype=np.uint32)
    for _ in range(2):
        two = one[two & 255] ^ two >> np.uint32(8)
    out = [two]
    for _ in range(3):
        two = one[two & 255] ^ two >> np.uint32(8)
        two = one[two & 255] ^ two >> np.uint32(8)
        out.append(two)
    return np.stack(out[::-1])


def _shifted(crc: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    return matrix[0][crc & 0xFFFF] ^ matrix[1][crc >> np.uint32(16)]


@cache
def _zeros(k: int) -> np.ndarray:
    """What 2**k zero bytes make of a checksum's lower and upper half: 2 x 65536."""
    if k:
        half = _zeros(k - 1)
        return np.stack([_shifted(half[0], half), _shifted(half[1], half)])
    low = np.arange(65536, dtype=np.uint32)
    return np.stack([_one()[c & 255] ^ c >> np.uint32(8) for c in (low, low << np.uint32(16))])


def crc32c_many(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32C of many spans of bytes at once.

    Spans are cut into runs of RUN bytes from their ends; all runs are summed side by side, eight bytes a step, and
    then joined span by span.
    """
    n = lengths.astype(np.int64)
    runs, width = -(-n // RUN), min(RUN, -(-int(n.max(initial=1)) // 8) * 8)
    span = np.repeat(np.arange(len(n)), runs)
    nth = np.arange(len(span)) - np.repeat(np.cumsum(runs) - runs, runs)
    # the first run of a span is the short one: zeros before it change nothing
    at = (starts + n)[span] - (runs[span] - nth) * RUN + RUN - width
    cell = at[:, None] + np.arange(width)
    inside = cell >= starts[span][:, None]
    cells = np.where(inside, raw[np.where(inside, cell, 0)] if len(raw) else 0, 0).astype(np.uint8)
    pairs = np.ascontiguousarray(cells).view("<u2").reshape(len(span), width // 8, 4)
    t = _tables()
    crc, later = np.zeros(len(span), np.uint32), t[2][pairs[:, :, 2]] ^ t[3][pairs[:, :, 3]]
    for j in range(width // 8):
        crc = t[0][pairs[:, j, 0] ^ (crc & np.uint32(0xFFFF))] ^ t[1][pairs[:, j, 1] ^ (crc >> np.uint32(16))] ^ later[:, j]
    total, shift = np.zeros(len(n), np.uint32), _zeros(RUN.bit_length() - 1)
    first = np.cumsum(runs) - runs
    rows, k = np.flatnonzero(runs > 0), 0
    while len(rows):
        total[rows] = _shifted(total[rows], shift) ^ crc[first[rows] + k]
        k += 1
        rows = rows[runs[rows] > k]
    start = np.full(len(n), 0xFFFFFFFF, np.uint32)
    for k in range(int(n.max(initial=0)).bit_length()):
        on = n >> k & 1 == 1
        start[on] = _shifted(start[on], _zeros(k))
    return total ^ start ^ np.uint32(0xFFFFFFFF)


def masked_many(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    c = crc32c_many(raw, starts, lengths)
    return (c >> np.uint32(15) | c << np.uint32(17)) + np.uint32(0xA282EAD8)


def framed(records: list[bytes]) -> bytes:
    """Records with their lengths and checksums, one after the other."""
    n = np.array([len(r) for r in records], np.int64)
    heads = n.astype("<u8").view(np.uint8)
    at = np.arange(len(n)) * 8
    raw = np.frombuffer(b"".join(records), np.uint8)
    a, b = masked_many(heads, at, np.full(len(n), 8)), masked_many(raw, np.cumsum(n) - n, n)
    return b"".join(x for r, k, h, d in zip(records, n.tolist(), a.tolist(), b.tolist(), strict=True) for x in (struct.pack("<QI", k, h), r, struct.pack("<I", d)))


def frames(raw: bytes, at: int, where: str, last: bool, verify: bool = True) -> tuple[list[bytes], int]:
    """The whole records of a buffer and the number of bytes they take; ``at`` is its place in the file ``where``.
    With ``last`` nothing may be left over. A damaged record is named by its place."""
    starts, lengths, i = [], [], 0
    while i + HEAD <= len(raw):
        (n,) = struct.unpack_from("<Q", raw, i)
        if i + HEAD + n + 4 > len(raw):
            break
        starts.append(i)
        lengths.append(n)
        i += HEAD + n + 4
    if verify and starts:
        b, s, n = np.frombuffer(raw, np.uint8), np.array(starts, np.int64), np.array(lengths, np.int64)
        told = lambda p: b[p[:, None] + np.arange(4)].copy().view("<u4")[:, 0]
        bad = (told(s + 8) != masked_many(b, s, np.full(len(s), 8))) | (told(s + HEAD + n) != masked_many(b, s + HEAD, n))
        if bad.any():
            raise ValueError(f"{where}: the record at byte {at + starts[int(bad.argmax())]} doesn't match its checksum")
    if last and i < len(raw):
        raise ValueError(f"{where}: the record at byte {at + i} is cut short")
    return [raw[s + HEAD : s + HEAD + n] for s, n in zip(starts, lengths, strict=True)], i


# ---------------------------------------------------------------- numbers as varints


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of many varints, and where each starts (with the end of the last)."""
    v = values.astype(np.int64).view(np.uint64)
    size = np.ones(len(v), np.int64)
    for k in range(1, 10):
        size += v >= np.uint64(1) << np.uint64(7 * k)
    off = np.append(0, np.cumsum(size))
    out = np.zeros(int(off[-1]), np.uint8)
    for k in range(int(size.max(initial=0))):
        on = np.flatnonzero(size > k)
        part = (v[on] >> np.uint64(7 * k)).astype(np.uint8) & 127
        out[off[on] + k] = part | np.where(size[on] > k + 1, 128, 0).astype(np.uint8)
    return out, off


def unvarints(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of many varints, and where each ends."""
    ends = np.flatnonzero(raw < 128) + 1
    starts = np.append(0, ends[:-1]) if len(ends) else ends
    out = np.zeros(len(ends), np.uint64)
    for k in range(int((ends - starts).max(initial=0))):
        on = np.flatnonzero(ends - starts > k)
        out[on] |= (raw[starts[on] + k] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * k)
    return out.view(np.int64), ends


def _woven(heads: np.ndarray, h: np.ndarray, bodies: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of two arrays by turns: head, body, head, body; and where each pair starts."""
    hn, bn = np.diff(h), np.diff(b)
    off = np.append(0, np.cumsum(hn + bn))
    out = np.zeros(int(off[-1]), np.uint8)
    spread = lambda n, at: np.repeat(at - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    out[spread(hn, off[:-1])] = heads
    out[spread(bn, off[:-1] + hn)] = bodies
    return out, off


# ---------------------------------------------------------------- encoding


def base(kind: T.DataType) -> tuple[T.DataType, int]:
    """The type of a column's elements, and how deep its arrays are."""
    depth = 0
    while isinstance(kind, T.ArrayType):
        kind, depth = kind.elementType, depth + 1
    return kind, depth


def io_type(kind: T.DataType) -> str:
    """bytes, float or int: how a column is stored."""
    kind, _ = base(kind)
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    return "bytes" if isinstance(kind, (T.StringType, T.BinaryType)) else "int"


def levels(col: pa.Array, depth: int) -> tuple[pa.Array, list[np.ndarray], list[np.ndarray]]:
    """The elements of a column; for each row and level where its arrays start (with the end of the last), and the
    arrays' lengths at all levels but the first. Null arrays are empty, a null cell is no element."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    rows = np.arange(len(col) + 1)
    if not depth:
        return col.drop_null(), [np.append(0, np.cumsum(col.is_valid().to_numpy(zero_copy_only=False)))], []
    bounds, lengths = [], []
    for level in range(depth):
        n = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        if level:
            lengths.append(n)
        rows = np.append(0, np.cumsum(n))[rows]
        bounds.append(rows)
        col = col.flatten()
    return col, bounds, lengths


def _payload(values: pa.Array, kind: str) -> tuple[bytes, np.ndarray]:
    """A column's elements as list contents, and where each starts."""
    n = len(values)
    if kind == "float":
        v = pc.fill_null(values.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False).astype("<f4")
        return v.tobytes(), np.arange(n + 1) * 4
    if kind == "int":
        v = values.cast(pa.int64()) if not pa.types.is_boolean(values.type) else values.cast(pa.int8()).cast(pa.int64())
        raw, off = varints(pc.fill_null(v, 0).to_numpy(zero_copy_only=False))
        return raw.tobytes(), off
    v = pc.fill_null(values.cast(pa.large_binary()), b"")
    off = np.append(0, np.cumsum(pc.binary_length(v).to_numpy(zero_copy_only=False)))
    body = np.frombuffer(b"".join(v.to_pylist()), np.uint8)
    size, at = varints(np.diff(off))
    heads = np.insert(size, at[:-1], 0x0A) if n else size
    raw, off = _woven(heads, at + np.arange(n + 1), body, off)
    return raw.tobytes(), off


def _sized(data: bytes, tag: int) -> bytes:
    n = len(data)
    if n < 128:
        return bytes((tag, n)) + data
    head = bytearray((tag,))
    while n > 127:
        head.append(n & 127 | 128)
        n >>= 7
    head.append(n)
    return bytes(head) + data


_FIELD = {"bytes": 0x0A, "float": 0x12, "int": 0x1A}


def encode_columns(columns: dict[str, tuple[pa.Array, str, int]]) -> list[bytes]:
    """Each row as an Example: by name a column, its kind of storage and its depth."""
    parts: list[tuple[str, str, bytes, np.ndarray]] = []
    for name, (col, kind, depth) in columns.items():
        values, bounds, lengths = levels(col, depth)
        raw, off = _payload(values, kind)
        parts.append((name, kind, raw, off[bounds[-1]]))
        for i, n in enumerate(lengths, 1):
            raw, off = _payload(pa.array(n), "int")
            parts.append((f"{name}.d{i}", "int", raw, off[bounds[i - 1]]))
    parts.sort()
    rows = len(next(iter(columns.values()))[0]) if columns else 0
    out = [b""] * rows
    for name, kind, raw, cut in parts:
        key, tag, cuts = _sized(name.encode(), 0x0A), _FIELD[kind], cut.tolist()
        for i in range(rows):
            a, b = cuts[i], cuts[i + 1]
            lists = b"" if a == b else _sized(raw[a:b] if kind == "bytes" else _sized(raw[a:b], 0x0A), tag)
            out[i] += _sized(key + _sized(lists, 0x12), 0x0A)
    return [_sized(x, 0x0A) for x in out]


# ---------------------------------------------------------------- decoding


def _entries(data: bytes, wanted: dict[bytes, int], found: list) -> None:
    """Put the contents of the wanted lists of an Example into ``found``: (kind, bytes), or values that aren't packed."""

    def varint(at: int) -> tuple[int, int]:
        x = shift = 0
        while True:
            b = data[at]
            at += 1
            x |= (b & 127) << shift
            if b < 128:
                return x, at
            shift += 7

    def fields(at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
        while at < end:
            key, at = varint(at)
            wire = key & 7
            if wire == 2:
                n, at = varint(at)
            elif wire == 0:
                n, to = varint(at)
                yield key >> 3, 0, at, to
                at = to
                continue
            elif wire in (1, 5):
                n = 8 if wire == 1 else 4
            else:
                raise ValueError(f"wire type {wire}")
            if at + n > end:
                raise ValueError("a field is cut short")
            yield key >> 3, wire, at, at + n
            at += n

    for number, wire, a, b in fields(0, len(data)):
        if number != 1 or wire != 2:
            continue
        for number, wire, c, d in fields(a, b):  # noqa: PLW2901
            if number != 1 or wire != 2:
                continue
            name, value = b"", None
            for n, _, e, f in fields(c, d):
                if n == 1:
                    name = data[e:f]
                elif n == 2:
                    value = (e, f)
            at = wanted.get(name)
            if at is None:
                continue
            found[at] = None
            for kind, _, e, f in fields(*value) if value else ():
                whole = [(x, y) for n, w, x, y in fields(e, f) if n == 1]
                if kind == 1:
                    found[at] = (1, [data[x:y] for x, y in whole])
                else:
                    found[at] = (kind, data[whole[0][0] : whole[0][1]] if len(whole) == 1 else b"".join(data[x:y] for x, y in whole))


def _column(cells: list, kind: str) -> tuple[pa.Array, np.ndarray]:
    """Elements of all rows' lists, and the number of each row's."""
    code = {"bytes": 1, "float": 2, "int": 3}[kind]
    if any(c and c[0] != code and c[1] for c in cells):
        raise ValueError(f"a list isn't one of {kind}")
    if kind == "bytes":
        return pa.array([x for c in cells if c for x in c[1]], pa.binary()), np.array([len(c[1]) if c else 0 for c in cells], np.int64)
    raw = b"".join(c[1] for c in cells if c)
    size = np.array([len(c[1]) if c else 0 for c in cells], np.int64)
    if kind == "float":
        return pa.array(np.frombuffer(raw, "<f4")), size // 4
    v, ends = unvarints(np.frombuffer(raw, np.uint8))
    return pa.array(v), np.diff(np.searchsorted(ends, np.append(0, np.cumsum(size)), "right"))


def decode_columns(records: list[bytes], columns: dict[str, T.DataType], arrow: pa.Schema) -> list[pa.Array]:
    """Examples as columns of the given types; what they lack is 0, empty or an empty array."""
    names: list[tuple[str, str]] = []
    for c, kind in columns.items():
        depth = base(kind)[1]
        names += [(c, io_type(kind)), *((f"{c}.d{i}", "int") for i in range(1, depth))]
    wanted = {n.encode(): i for i, (n, _) in enumerate(names)}
    cells: list[list] = []
    for r in records:
        row: list = [None] * len(names)
        _entries(r, wanted, row)
        cells.append(row)
    flat = {n: _column([row[i] for row in cells], kind) for i, (n, kind) in enumerate(names)}
    out = []
    for (c, kind), to in zip(columns.items(), arrow, strict=True):
        leaf, depth = base(kind)
        values, count = flat[c]
        want = to.type
        for _ in range(depth):
            want = want.value_type
        if pa.types.is_boolean(want):
            values = pc.not_equal(values, 0)
        values = values.cast(want)
        if not depth:
            first = np.cumsum(count) - count
            got = values.take(pa.array(np.where(count > 0, first, 0), mask=count == 0))
            zero = {"bytes": b"" if isinstance(leaf, T.BinaryType) else "", "float": 0.0, "int": False if pa.types.is_boolean(want) else 0}[io_type(kind)]
            out.append(pc.fill_null(got, pa.scalar(zero, want)))
            continue
        for level in range(depth - 1, 0, -1):
            lengths = flat[f"{c}.d{level}"][0].to_numpy()
            if int(lengths.sum()) != len(values):
                raise ValueError(f"{c}: its inner arrays hold {int(lengths.sum())} values, not {len(values)}")
            values = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32)), values)
        top = flat[f"{c}.d1"][1] if depth > 1 else count
        out.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(top)).astype(np.int32)), values).cast(to.type))
    return out

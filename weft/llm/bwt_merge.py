"""Removal of repeated byte strings by merging Burrows-Wheeler transforms of shards.

A byte goes if a string of ``length`` bytes that covers it also starts earlier (smaller doc_id, then text
hash, or earlier in the same document). A window is such a string with its place. The work is dealt out
so that equal windows always meet:

* Every window holds an anchor, its KEY-byte string of least hash (the leftmost, if several are). Windows
  whose anchor lies in their left half are keyed by the CORE bytes from the anchor on, the others by the
  CORE bytes around it; neighbouring windows of one core make a context. Cores that occur once can't
  repeat; of the others (a bitmap of them; what it lets through besides costs time only) each task keeps one
  context of each content and sends it to its core's task. Cores of over HOT contexts are cut into single
  windows, keyed by the whole window, so that no core's contexts all meet in one task.
* There contexts of one content count once. The rest, strings that share a core but not all, are dealt to
  shards of SHARD bytes; each shard's suffixes are sorted once, which gives its Burrows-Wheeler transform
  (of pairs of bytes). The transforms are merged by refining their interleave: each pass deals the merged
  order out by the two bytes before each suffix, stably, and so lengthens the known common prefixes by two;
  after length / 2 passes the boundaries between neighbours are the repeated intervals, and the earliest
  window of each interval stays. No suffix is sorted again.

Contexts are rotated cyclically with an end mark, so windows never run into another context.

Defined cases: null texts are empty; texts shorter than ``length`` stay. Rows that repeat both id and text
are one document and are treated alike; null ids come first. Long texts are read in stretches of STRETCH
bytes, whatever their length. An empty table gives an empty result. Other columns are kept, whatever their
names, where ``repeats_removed`` is asked for them. ``length`` is even, from 96 to 156.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm.bitmaps import bitmap, has
from weft.llm.common import cut, partitions_for, pieces, tidy, unused
from weft.llm.textarrays import mix, text_bytes

LENGTH = 100
KEY, CORE = 32, 64
STRETCH = 1 << 18
#: Bytes of contexts that a task packs at once.
PACKED = 16 << 20
SHARD, SHARDS = 1 << 16, 8
HOT = 10_000
#: No byte of UTF-8 text.
END = 0xFF

_BYTES = mix(np.arange(1, 257, dtype=np.uint64))
_STEPS = mix(np.arange(1001, 1009, dtype=np.uint64)) | np.uint64(1)


def _grams(raw: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all strings of KEY bytes and of ``size`` bytes (a power of two above it), by where they start."""
    h, n, k, key = _BYTES[raw], 1, 0, None
    while n < size:
        h = h[:-n] * _STEPS[k] + h[n:] if len(h) > n else h[:0]
        h ^= h >> np.uint64(31)
        n, k = 2 * n, k + 1
        if n == KEY:
            key = h.copy()
    return key, h


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    n = 1
    while 2 * n <= width:
        v = np.minimum(v[:-n], v[n:])
        n *= 2
    return np.minimum(v[: len(v) - (width - n)], v[width - n :]) if n < width else v


class Contexts:
    """Runs of windows with one core, as arrays: first byte, windows, text and key."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, length: int) -> None:
        self.raw, self.length = raw, length
        none = np.zeros(0, np.int64)
        self.start = self.n = self.doc = none
        self.key, self.core = none.astype(np.uint64), none.astype(np.uint64)
        if len(raw) < length:
            return
        key, self.core = _grams(raw, CORE)
        low = np.uint64(0xFFFFFFFF)
        anchor = _least((key & ~low) | np.arange(len(key), dtype=np.uint64), length - KEY + 1)
        turn = np.append(0, np.flatnonzero(anchor[1:] != anchor[:-1]) + 1)
        a = (anchor[turn] & low).astype(np.int64)
        # a context ends where the anchor or its side changes, and with its text's last whole window
        ends = off[1:] - length + 1
        side = a - (length - KEY) // 2
        side = side[(side > turn) & (side < np.append(turn[1:], len(anchor)))]
        cuts = np.concatenate([turn, side, off[:-1], ends])
        first = np.unique(cuts[(cuts >= 0) & (cuts < len(anchor))])
        n = np.diff(np.append(first, len(anchor)))
        doc = np.searchsorted(off, first, "right") - 1
        whole = first < ends[np.minimum(doc, len(ends) - 1)]
        first, n, doc = first[whole], n[whole], doc[whole]
        a = (anchor[first] & low).astype(np.int64)
        right = a - first <= (length - KEY) // 2
        self.start, self.n, self.doc = first, n, doc
        # windows end inside their text, and so do their cores
        self.key = mix(self.core[np.where(right, a, np.maximum(a - (CORE - KEY), 0))] + (~right).astype(np.uint64))

    def take(self, at: np.ndarray) -> None:
        self.start, self.n, self.doc, self.key = self.start[at], self.n[at], self.doc[at], self.key[at]

    def split(self, hot: np.ndarray) -> None:
        """Cut some contexts into single windows, keyed by the whole window."""
        if not hot.any():
            return
        n = self.n[hot]
        rows = np.repeat(np.flatnonzero(hot), n)
        start = self.start[rows] + np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
        key = mix(self.core[start] * _STEPS[6] + self.core[start + self.length - CORE])
        keep = ~hot
        self.start = np.concatenate([self.start[keep], start])
        self.n = np.concatenate([self.n[keep], np.ones(len(rows), np.int64)])
        self.doc = np.concatenate([self.doc[keep], self.doc[rows]])
        self.key = np.concatenate([self.key[keep], key])

    def bodies(self) -> pa.BinaryArray:
        size = self.n + self.length - 1
        bounds = np.zeros(len(size) + 1, np.int32)
        np.cumsum(size, out=bounds[1:])
        at = np.repeat(self.start - bounds[:-1], size) + np.arange(bounds[-1])
        return pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(self.raw[at]))])


def _contexts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[pa.RecordBatch, Contexts, int, np.ndarray]]:
    """Contexts of each stretch, with the stretch's place in its batch's texts and where those start."""
    for whole in batches:
        for b in pieces(whole, "text", STRETCH):
            raw, off = text_bytes(b.column("text"))
            for a in range(0, max(1, len(raw) - length + 1), STRETCH):
                part = raw[a : a + STRETCH + length - 1]
                yield b, Contexts(part, np.clip(off - a, 0, len(part)), length), a, off


@tidy
def _cores(batches: Iterator[pa.RecordBatch], length: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Keys of all contexts, packed by part."""
    for _, c, _, _ in _contexts(batches, length):
        if len(c.key):
            part = (c.key % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            some, first = np.unique(part[order], return_index=True)
            keys = np.split(c.key[order], first[1:])
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([k.tobytes() for k in keys], pa.binary())], ["part", "data"])


@tidy
def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys that occur twice or more, with how often; rows come sorted by part."""
    part, held = None, []

    def flush() -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        keys, n = keys[n > 1], n[n > 1]
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

    for b in batches:
        for p, d in zip(b.column("part").to_pylist(), b.column("data").to_pylist(), strict=True):
            if held and p != part:
                yield flush()
                held = []
            part = p
            held.append(np.frombuffer(d, np.uint64))
    if held:
        yield flush()


def _sorted_by(place: tuple[np.ndarray, np.ndarray, np.ndarray], code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows by code and place; of those, which is its code's first, and which holds its code's first place (repeated rows)."""
    order = np.lexsort((place[2], place[1], place[0], code))
    c = code[order]
    first = np.ones(len(order), bool)
    first[1:] = c[1:] != c[:-1]
    head = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
    same = np.ones(len(order), bool)
    for p in place:
        same &= p[order] == p[head]
    return order, first, same


_RUNS = ["doc", "sig", "start", "n"]


def _packed(t: pa.Table, part: np.ndarray, known: bool) -> Iterator[pa.RecordBatch]:
    """A table's rows by part, compressed."""
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    t, part = t.take(pa.array(order)).combine_chunks(), part[order]
    lead = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    data = []
    for x, y in zip(lead.tolist(), np.append(lead[1:], len(part)).tolist(), strict=True):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(t.slice(x, y - x))
        data.append(sink.getvalue().to_pybytes())
    yield pa.RecordBatch.from_arrays([pa.array(part[lead]), pa.array([known] * len(data), pa.bool_()), pa.array(data, pa.binary())], ["part", "known", "data"])


def _joined(doc: np.ndarray, sig: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.Table:
    """Runs of windows, those that touch joined into one."""
    order = np.lexsort((start, sig, doc))
    doc, sig, start, n = doc[order], sig[order], start[order], n[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (sig[1:] != sig[:-1]) | (start[1:] != start[:-1] + n[:-1])
    first = np.flatnonzero(new)
    total = np.add.reduceat(n, first) if len(first) else n
    return pa.table(dict(zip(_RUNS, (doc[first], sig[first], start[first], total), strict=True)))


@tidy
def _suspects(batches: Iterator[pa.RecordBatch], length: int, marks: np.ndarray, hot: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Contexts whose core may repeat: one of each content with its bytes; of the others only that all their windows go."""
    held: list[pa.RecordBatch] = []
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        code = t.column("body").combine_chunks().dictionary_encode().indices.to_numpy()
        key, doc, sig, start, n = (t.column(c).to_numpy() for c in ("key", *_RUNS))
        order, first, same = _sorted_by((doc, sig, start), code)
        kept, known = order[first], order[~first & ~same]
        yield from _packed(t.take(pa.array(kept)), (key[kept] % np.uint64(parts)).astype(np.int64), False)
        runs = _joined(doc[known], sig[known], start[known], n[known])
        yield from _packed(runs, (mix(runs.column("sig").to_numpy().view(np.uint64)) % np.uint64(parts)).astype(np.int64), True)

    for b, c, a, off in _contexts(batches, length):
        c.take(np.flatnonzero(has(marks, c.key.view(np.int64))))
        if not len(c.key):
            continue
        c.split(has(hot, c.key.view(np.int64)))
        doc, sig = b.column("doc").to_numpy()[c.doc], b.column("sig").to_numpy()[c.doc]
        held.append(pa.RecordBatch.from_arrays([pa.array(c.key), pa.array(doc), pa.array(sig), pa.array(c.start + a - off[c.doc]), pa.array(c.n), c.bodies()], ["key", *_RUNS, "body"]))
        size += held[-1].nbytes
        if size > PACKED:
            yield from out()
            held, size = [], 0
    if held:
        yield from out()


def transform(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A shard's suffixes in order and its transform.

    ``strings`` are rows of bytes that end in END marks; suffixes are their cyclic rotations, numbered along
    the rows. The transform is the two bytes before each suffix, as one number.
    """
    m, width = strings.shape
    rank = np.zeros((m, width), np.int64)
    for i in range(7):
        rank = rank << 8 | np.roll(strings, -i, 1)
    known = 7
    while known < width:
        flat = rank.reshape(-1)
        order = np.argsort(flat, kind="stable")
        ordered = flat[order]
        new = np.zeros(len(flat), np.int64)
        new[1:] = ordered[1:] != ordered[:-1]
        np.cumsum(new, out=new)
        flat = np.empty_like(new)
        flat[order] = new
        rank = flat.reshape(m, width)
        if new[-1] == len(new) - 1:
            break
        rank = rank * (m * width) + np.roll(rank, -known, 1)
        known *= 2
    order = np.argsort(rank.reshape(-1), kind="stable")
    pairs = np.roll(strings, 2, 1).astype(np.uint16) << 8 | np.roll(strings, 1, 1)
    return order, pairs.reshape(-1)[order]


def merge(transforms: list[np.ndarray], passes: int) -> tuple[np.ndarray, np.ndarray]:
    """The interleave of several transforms (which one each place of the merged order belongs to) after so many
    passes, and the number of the interval, of suffixes with a common prefix of 2 * passes bytes, at each place."""
    shard = np.repeat(np.arange(len(transforms), dtype=np.uint8), [len(t) for t in transforms])
    given = np.concatenate(transforms)
    block = np.zeros(len(shard), np.int32)
    for _ in range(passes):
        c = np.empty_like(given)
        c[np.argsort(shard, kind="stable")] = given
        order = np.argsort(c, kind="stable")
        shard, c, block = shard[order], c[order], block[order]
        new = np.zeros(len(c), np.int32)
        new[1:] = (c[1:] != c[:-1]) | (block[1:] != block[:-1])
        block = np.cumsum(new, dtype=np.int32)
    return shard, block


def intervals(raw: np.ndarray, start: np.ndarray, size: np.ndarray, length: int) -> list[np.ndarray]:
    """For each string the intervals of its suffixes by common prefixes of ``length`` bytes, through shards."""
    width = int(size.max()) + 2
    width += width % 2
    rows = max(1, SHARD // width)
    shards, orders = [], []
    for first in range(0, len(start), rows):
        n = size[first : first + rows]
        m = np.full((len(n), width), END, np.uint8)
        inside = np.arange(width) < n[:, None]
        m[inside] = raw[(start[first : first + rows, None] + np.arange(width))[inside]]
        order, pairs = transform(m)
        orders.append(order)
        shards.append(pairs)
    shard, block = merge(shards, length // 2)
    out = []
    for s, order in enumerate(orders):
        own = np.empty(len(order), np.int32)
        own[order] = block[shard == s]
        out.append(own.reshape(-1, width))
    return out


def _later(body: pa.BinaryArray, place: tuple[np.ndarray, np.ndarray, np.ndarray], n: np.ndarray, key: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts of some cores: which rows go whole, and the row and place of each window that goes of others."""
    code = body.dictionary_encode().indices.to_numpy().astype(np.int64)
    order, first, same = _sorted_by(place, code)
    known = order[~first & ~same]
    head = order[first]
    # strings that share their core with another string
    k = key[head]
    _, inverse, count = np.unique(k, return_inverse=True, return_counts=True)
    head = head[count[inverse] > 1]
    if not len(head):
        return known, known[:0], known[:0]
    bounds = np.frombuffer(body.buffers()[1], np.int32, len(body) + 1 + body.offset)[body.offset :].astype(np.int64)
    raw = np.frombuffer(body.buffers()[2], np.uint8)
    # windows whose hash occurs once can't repeat; strings are cut to what is left
    windows = n[head]
    row = np.repeat(np.arange(len(head)), windows)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    lo, hi = bounds[head], bounds[head + 1]
    size = hi - lo
    flat = raw[np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
    begin = np.cumsum(size) - size
    core = _grams(flat, CORE)[1]
    at = begin[row] + nth
    h = core[at] * _STEPS[7] + core[at + length - CORE]
    _, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
    may = count[inverse] > 1
    row, nth, at = row[may], nth[may], at[may]
    if not len(row):
        return known, known[:0], known[:0]
    some, lead = np.unique(row, return_index=True)
    from_ = nth[lead]
    to = nth[np.append(lead[1:], len(row)) - 1]
    found = intervals(flat, begin[some] + from_, to - from_ + length, length)
    index = np.searchsorted(some, row)
    # each window's interval; the earliest of an interval stays
    per = len(found[0])
    interval = np.empty(len(row), np.int64)
    for s, own in enumerate(found):
        here = index // per == s
        interval[here] = own[index[here] - s * per, nth[here] - from_[index[here]]]
    h_row = head[row]
    order, first, same = _sorted_by((place[0][h_row], place[1][h_row], place[2][h_row] + nth), interval)
    gone = order[~first & ~same]
    return known, h_row[gone], nth[gone]


@tidy
def _groups(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Runs of windows that start later than an equal one: rows come sorted by part; cores are taken some at a time."""
    held: list[pa.Table] = []
    part = None

    def out() -> Iterator[pa.RecordBatch]:
        t = pa.concat_tables(held).sort_by("key").combine_chunks()
        key = t.column("key").to_numpy()
        ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
        before = np.append(0, np.cumsum(pc.binary_length(t.column("body")).to_numpy()))
        at = 0
        while at < len(key):
            to = int(ends[np.searchsorted(before[ends], before[at] + SHARD * SHARDS).clip(0, len(ends) - 1)])
            own = t.slice(at, to - at)
            at = to
            doc, sig, start, n = (own.column(c).to_numpy() for c in _RUNS)
            known, row, nth = _later(own.column("body").combine_chunks(), (doc, sig, start), n, own.column("key").to_numpy(), length)
            rows = np.concatenate([known, row])
            yield from _joined(doc[rows], sig[rows], np.concatenate([start[known], start[row] + nth]), np.concatenate([n[known], np.ones(len(row), np.int64)])).to_batches()

    for b in batches:
        for p, known, data in zip(b.column("part").to_pylist(), b.column("known").to_pylist(), b.column("data").to_pylist(), strict=True):
            t = pa.ipc.open_stream(data).read_all()
            if known:
                yield from t.to_batches()
                continue
            if held and p != part:
                yield from out()
                held = []
            part = p
            held.append(t)
    if held:
        yield from out()


def spans(windows: list, n_bytes: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes that runs of windows (start, n) cover: where they start and stop."""
    edge = np.zeros(n_bytes + 1, np.int32)
    np.add.at(edge, np.array([w["start"] for w in windows], np.int64), 1)
    np.add.at(edge, np.array([w["start"] + w["n"] - 1 + length for w in windows], np.int64), -1)
    cover = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
    turn = np.flatnonzero(cover[1:] != cover[:-1])
    return turn[::2], turn[1::2]


@tidy
def _rebuild(batches: Iterator[pa.RecordBatch], text: str, found: str, length: int, out: list[str]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in pieces(whole, text, STRETCH):
            raw, off = text_bytes(b.column(text))
            kept, removed, runs, lists = [], [], [], []
            for i, w in enumerate(b.column(found).to_pylist()):
                own = raw[off[i] : off[i + 1]]
                start, stop = spans(w, len(own), length) if w else (np.zeros(0, np.int64),) * 2
                keep = np.ones(len(own), bool)
                for x, y in zip(start.tolist(), stop.tolist(), strict=True):
                    keep[x:y] = False
                kept.append(own[keep].tobytes() if len(start) else own.tobytes())
                removed.append(int((stop - start).sum()))
                runs.append(len(start))
                lists.append([{"start": x, "stop": y} for x, y in zip(start.tolist(), stop.tolist(), strict=True)])
            made = [pa.array(np.diff(off)), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(lists, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(kept, pa.binary())]
            names = [n for n in b.schema.names if n != found]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *made], [*names, *out])


def repeated_windows(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc, sig, start, n): runs of windows of ``docs`` (doc, sig, text) that start later than an equal one."""
    spark = docs.sparkSession
    parts = 4 * partitions_for(spark)
    packed = docs.mapInArrow(partial(_cores, length=length, parts=parts), "part long, data binary").repartition(parts // 4, "part").sortWithinPartitions("part")
    repeated = cut(packed.mapInArrow(_repeated, "key long, n long"), "cores")
    counts = repeated.agg(F.count("*").alias("n"), F.count(F.when(F.col("n") > HOT, 1)).alias("hot")).first()
    bits = lambda n: min(26, max(16, (8 * n).bit_length()))
    marks = bitmap(repeated.select("key"), bits(counts.n))
    hot = bitmap(repeated.where(F.col("n") > HOT).select("key"), bits(counts.hot))
    kind = "part long, known boolean, data binary"
    met = docs.mapInArrow(partial(_suspects, length=length, marks=marks, hot=hot, parts=parts), kind).repartition(parts // 4, "part").sortWithinPartitions("part")
    return met.mapInArrow(partial(_groups, length=length), "doc long, sig long, start long, n long")


def repeats_removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """All rows and columns, and of each text n_bytes, n_removed, n_spans, _spans (byte ranges removed) and _kept (bytes that stay);
    a column of docs that has one of these names is left out."""
    if length % 2 or not 96 <= length <= 156:
        raise ValueError("length must be even, from 96 to 156")
    made = ["n_bytes", "n_removed", "n_spans", "_spans", "_kept"]
    own = [c for c in docs.columns if c.lower() not in made]
    least = F.lit(-(2**63))
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), least).alias("doc"), F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)).alias("sig"), F.col(text_col).alias("text"))
    windows = repeated_windows(keyed, length)
    doc, sig, found = unused(docs, "doc", "sig", "found")
    lists = windows.groupBy("doc", "sig").agg(F.collect_list(F.struct("start", "n")).alias(found)).select(F.col("doc").alias(doc), F.col("sig").alias(sig), found)
    rows = docs.select(*(F.col(f"`{c}`") for c in own))
    joined = rows.join(lists, (F.coalesce(F.col(id_col).cast("long"), least) == F.col(doc)) & (F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)) == F.col(sig)), "left")
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
    kind = T.StructType([*rows.schema.fields, *(T.StructField(n, k) for n, k in zip(made, (T.LongType(), T.LongType(), T.LongType(), span, T.BinaryType()), strict=True))])
    return joined.select(*(F.col(f"`{c}`") for c in own), found).mapInArrow(partial(_rebuild, text=text_col, found=found, length=length, out=made), kind)

"""Line dedup by content-defined chunks of lines.

Each line with a word is hashed; a chunk ends where a rolling hash over the last WINDOW such lines falls into one
of AVERAGE classes, or after LONGEST lines, so chunks are the same wherever a run of lines stands; FAMILIES such
hashes cut the same lines apart. Chunks of two
lines or more whose hash occurs more than once anywhere are looked up: all but the first occurrence (smallest
doc_id, then text, then place) are removed after their bytes have been compared with the first occurrence's.
A removed chunk is extended line by line to both sides for as long as the lines equal those beside the first
occurrence (by 64-bit hashes of them), up to the next chunk on either side that is looked up itself, so a repeated run goes whole once a chunk lies inside it, whatever
stands around it. Every line that goes has an equal one earlier, so the first of each line always stays.

With ``passages``, single lines of at least PASSAGE words are chunks too, each of its own.

Defined cases: null and empty texts stay as they are. Lines without words belong to a chunk only between its
lines. Short runs may hold no whole chunk and stay (of random runs of 2 to 40 lines less than a tenth do). A text
all of whose lines are removed becomes empty. Rows that repeat both id and text are one occurrence and are
treated alike; null ids come first. Lines end at \\n; a last line without it is a line; a text that ends in \\n
still does. Other columns are kept, n_chars is set anew.
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
from weft.llm.common import cut, pieces, tidy, unused
from weft.llm.groups import attach
from weft.llm.textarrays import BASE, mix, powers, span_hashes, text_bytes, word_spans

WINDOW = 2
AVERAGE = 2
LONGEST = 32
#: Families of ends that cut the same lines: with three, few short runs hold no whole chunk of any.
FAMILIES = 3
PASSAGE = 50


class Chunks:
    """Chunks of a batch of texts, as arrays: text, hash, first and last line (places among the text's lines)."""

    def __init__(self, texts: pa.Array, passages: bool = False) -> None:
        raw, off = text_bytes(texts)
        self.raw = raw
        ends = np.flatnonzero(raw == 10)
        starts = np.sort(np.concatenate([off[:-1][np.diff(off) > 0], ends[~np.isin(ends + 1, off)] + 1]))
        doc = np.searchsorted(off, starts, "right") - 1
        stop = np.append(starts[1:], len(raw)) if len(starts) else starts
        words = np.diff(np.searchsorted(word_spans(raw, off)[0], np.append(starts, len(raw)))) if len(starts) else starts
        self.line_doc, self.line_start, self.line_stop, self.ink = doc, starts, stop, words > 0
        self.place = np.arange(len(starts)) - np.searchsorted(doc, doc)
        inked = np.flatnonzero(self.ink)
        self.inked, self.alone = inked, words[inked] >= PASSAGE if passages else np.zeros(len(inked), bool)
        every = span_hashes(raw, starts, stop - (raw[stop - 1] == 10) if len(starts) else stop)
        self.line_hash = every[inked]
        # of lines beside chunks their hashes are passed on, odd where the line has a word
        self.marks = (every & ~np.uint64(1) | self.ink.astype(np.uint64)).view(np.int64)
        self.cut(0)

    def families(self) -> Iterator[Chunks]:
        """The same texts cut by each family of ends in turn."""
        for family in range(FAMILIES):
            self.cut(family)
            yield self

    def cut(self, family: int) -> None:
        inked, h, alone = self.inked, self.line_hash, self.alone
        n = len(inked)
        doc = self.line_doc[inked]
        new = np.ones(n, bool)
        new[1:] = doc[1:] != doc[:-1]
        new[1:] |= alone[1:] | alone[:-1]
        since = np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0))
        roll = h * BASE
        for k in range(1, WINDOW):
            past = np.zeros_like(h)
            past[k:] = h[:-k] if k < n else past[k:]
            roll += np.where(since >= k, past * powers(WINDOW + 1)[k + 1], np.uint64(0))
        end = mix(roll + np.uint64(family)) % np.uint64(AVERAGE) == 0
        new[1:] |= end[:-1]
        at = np.flatnonzero(new)
        run = np.arange(n) - np.repeat(at, np.diff(np.append(at, n)))
        at = np.flatnonzero(new | (run % LONGEST == 0))
        lines = np.diff(np.append(at, n))
        weight = np.arange(n) - np.repeat(at, lines)
        # what stands between two lines of a chunk counts by its length
        gap = np.zeros(n, np.int64)
        gap[1:] = self.line_start[inked][1:] - self.line_stop[inked][:-1]
        own = h + np.where(weight > 0, mix(gap.astype(np.uint64)), np.uint64(0))
        self.hash = mix(np.add.reduceat(mix(own) * powers(LONGEST + 1)[weight + 1], at) + (lines + LONGEST * family).astype(np.uint64)) if n else h
        self.first, self.last = inked[at], inked[at + lines - 1] if n else inked
        self.doc, self.lines, self.single = doc[at], lines, alone[at] & (family == 0)
        # the chunks before and after that bound an extension: looked up themselves, or their text's first or last
        own, some = np.arange(len(at)), (lines > 1) | alone[at]
        lead = np.searchsorted(self.doc, self.doc)
        tail = np.searchsorted(self.doc, self.doc, "right") - 1
        seen = np.maximum.accumulate(np.where(some, own, -1))
        self.back = np.minimum(np.maximum(np.append(-1, seen[:-1]), lead), own) if len(at) else own
        # ends near a run's start depend on what stands before it, so its first lines may be cut otherwise elsewhere
        self.reach = inked[np.maximum(at[self.back] - WINDOW, at[lead])] if len(at) else inked
        seen = np.minimum.accumulate(np.where(some, own, len(at))[::-1])[::-1]
        self.ahead = np.maximum(np.minimum(np.append(seen[1:], len(at)), tail), own) if len(at) else own

    def looked_up(self) -> np.ndarray:
        return np.flatnonzero((self.lines > 1) | self.single)

    def _bytes(self, a: int, b: int) -> bytes:
        """From the start of line a to the end of line b, without the last line's end; of lines among the batch's."""
        return self.raw[self.line_start[a] : self.line_stop[b]].tobytes().removesuffix(b"\n")

    def text(self, i: int) -> bytes:
        """A chunk's bytes, without the last line's end."""
        return self._bytes(self.first[i], self.last[i])

    def before(self, i: int) -> bytes:
        """Hashes of the lines before the chunk in its text, from WINDOW lines before the last chunk before that is looked up."""
        return self.marks[self.reach[i] : self.first[i]].tobytes()

    def after(self, i: int) -> bytes:
        """Hashes of the lines after the chunk, up to the end of the next chunk that is looked up."""
        return self.marks[self.last[i] + 1 : self.last[self.ahead[i]] + 1].tobytes()

    def without(self, k: int, ranges: list) -> tuple[bytes, int]:
        """The k-th text without these lines (first, last), and how many lines went."""
        lo, hi = np.searchsorted(self.line_doc, [k, k + 1]).tolist()
        gone = np.zeros(hi - lo, bool)
        for r in ranges:
            gone[r["first"] : r["last"] + 1] = True
        kept = [self.raw[self.line_start[lo + i] : self.line_stop[lo + i]].tobytes().removesuffix(b"\n") for i in np.flatnonzero(~gone).tolist()]
        ended = kept and self.raw[self.line_stop[hi - 1] - 1] == 10
        return b"\n".join(kept) + (b"\n" if ended else b""), int(gone.sum())


def _alike(x: np.ndarray, y: np.ndarray) -> int:
    """How many of the first lines are equal, up to the last of them with a word."""
    n = min(len(x), len(y))
    other = np.flatnonzero(x[:n] != y[:n])
    inked = np.flatnonzero(x[: other[0] if len(other) else n] & 1)
    return int(inked[-1]) + 1 if len(inked) else 0


def same_before(a: bytes, b: bytes) -> int:
    """How many lines at the end of a and b are equal, up to the first of them with a word."""
    return _alike(np.frombuffer(a, np.int64)[::-1], np.frombuffer(b, np.int64)[::-1])


def same_after(a: bytes, b: bytes) -> int:
    """How many lines at the start of a and b are equal, up to the last of them with a word."""
    return _alike(np.frombuffer(a, np.int64), np.frombuffer(b, np.int64))


@tidy
def _scan(batches: Iterator[pa.RecordBatch], text: str, passages: bool) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in pieces(whole, text, 2 << 20):
            for c in Chunks(b.column(text), passages).families():
                yield pa.RecordBatch.from_arrays([pa.array(c.hash[c.looked_up()].view(np.int64))], ["hash"])


@tidy
def _texts(batches: Iterator[pa.RecordBatch], text: str, passages: bool, marks: np.ndarray) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in pieces(whole, text, 2 << 20):
            for c in Chunks(b.column(text), passages).families():
                at = c.looked_up()
                at = at[has(marks, c.hash[at].view(np.int64))]
                rows, some = pa.array(c.doc[at]), at.tolist()
                cols = [b.column("doc_id").take(rows), b.column("sig").take(rows), pa.array(c.hash[at].view(np.int64)), pa.array(c.place[c.first[at]]), pa.array(c.place[c.last[at]])]
                cols += [pa.array([f(i) for i in some], pa.binary()) for f in (c.text, c.before, c.after)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "sig", "hash", "no", "end", "body", "before", "after"])


@tidy
def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, sig, first, last): lines that go of each verified hit."""
    for b in batches:
        x = {c: b.column(c).to_pylist() for c in ("no", "end", "before", "after", "before0", "after0")}
        first = [n - same_before(p, q) for n, p, q in zip(x["no"], x["before"], x["before0"], strict=True)]
        last = [n + same_after(p, q) for n, p, q in zip(x["end"], x["after"], x["after0"], strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("sig"), pa.array(first, pa.int64()), pa.array(last, pa.int64())], ["doc_id", "sig", "first", "last"])


@tidy
def _rebuild(batches: Iterator[pa.RecordBatch], text: str, gone_col: str) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in pieces(whole, text, 2 << 20):
            gone, lost = b.column(gone_col).to_pylist(), [0] * b.num_rows
            if any(gone):
                rows = [i for i, g in enumerate(gone) if g]
                c = Chunks(b.column(text).take(pa.array(rows)))
                new = b.column(text).to_pylist()
                for k, i in enumerate(rows):
                    left, lost[i] = c.without(k, gone[i])
                    new[i] = left.decode("utf-8", "replace")
                made = pa.array(new, pa.string())
            else:
                made = b.column(text)
            removed = pa.array(lost, pa.int64())
            names = [n for n in b.schema.names if n != gone_col]
            length = pc.utf8_length(made).cast(pa.int64())
            cols = [made if n == text else pc.if_else(pc.greater(removed, 0), length, b.column(n)) if n == "n_chars" and pa.types.is_int64(b.schema.field(n).type) else b.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*cols, removed], [*names, "_removed"])


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passages: bool = False) -> DataFrame:
    """All rows and columns with repeated chunks of lines removed from the texts, and _removed: how many lines."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("sig", F.xxhash64("doc_id", "text"))
    found = own.mapInArrow(partial(_scan, text="text", passages=passages), "hash long")
    repeated = cut(found.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "repeated")
    marks = bitmap(repeated, min(26, max(16, (16 * repeated.count()).bit_length())))
    kind = "doc_id long, sig long, hash long, no long, end long, body binary, before binary, after binary"
    rows = cut(own.mapInArrow(partial(_texts, text="text", passages=passages, marks=marks), kind), "chunks", "zstd")
    # chunks are told apart by their bytes' hash too, so that of two that share a hash both go
    rows = rows.withColumn("chunk", F.struct("hash", F.xxhash64("body").alias("body64")))
    firsts = rows.groupBy("chunk").agg(F.min(F.struct("doc_id", "sig", "no", "body", "before", "after")).alias("at"), F.count("*").alias("n")).where("n > 1")
    firsts = cut(firsts, "firsts", "zstd")
    is_first = F.col("doc_id").eqNullSafe(F.col("at.doc_id")) & (F.col("sig") == F.col("at.sig")) & (F.col("no") == F.col("at.no"))
    # a chunk in a large share of all texts is broadcast, not one task's
    hits = attach(rows, firsts, "chunk", "n", rows.count()).where(F.col("at").isNotNull() & ~is_first & (F.col("body") == F.col("at.body")))
    hits = hits.select("doc_id", "sig", "no", "end", "before", "after", F.col("at.before").alias("before0"), F.col("at.after").alias("after0"))
    lost = hits.mapInArrow(_extended, "doc_id long, sig long, first long, last long")
    mine, gone, lost_id, lost_sig = unused(docs, "own", "gone", "id", "sig")
    lists = lost.groupBy("doc_id", "sig").agg(F.collect_set(F.struct("first", "last")).alias(gone)).select(F.col("doc_id").alias(lost_id), F.col("sig").alias(lost_sig), gone)
    keyed = docs.withColumn(mine, F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)))
    joined = keyed.join(lists, (F.col(mine) == F.col(lost_sig)) & F.col(id_col).cast("long").eqNullSafe(F.col(lost_id)), "left")
    kind = T.StructType([*docs.schema.fields, T.StructField("_removed", T.LongType())])
    return joined.select(*(F.col(f"`{c}`") for c in docs.columns), gone).mapInArrow(partial(_rebuild, text=text_col, gone_col=gone), kind)

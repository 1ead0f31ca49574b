"""Token-id files: an adaptive context-mixing range coder in independently reset, checksummed blocks.

Three predictors say what the next id may be. Order 2 and order 1 remember, by context, the last id
that followed and how often in a row it was right; a probability for each degree of confidence is
adapted after every id. Order 0 is the file's own table of id frequencies. The mixture

    P(id) = w2 [id = guess2] + w1 [id = guess1] + w0 F(id)

has its weights w2 = p2[confidence2], w1 = (1 - w2) p1[confidence1] and w0 the rest, so it is one
cumulative distribution, and a 64-bit range coder codes each id in a single step against it. Every
block starts from fresh predictors and coder, so blocks of a file are coded side by side: one numpy
lane a block, one step an id.

A file: magic, sizes, a zlib-packed index (document ids, their lengths, block lengths and checksums)
and frequency table with a checksum of their own, then the blocks' 32-bit words. All integers are
little-endian. Reading verifies every checksum.

Defined cases: a null text is empty, so its only id is the end id. Rows with a null doc_id come
first. Repeated rows are written as often as they occur. Long documents span blocks. An empty table
gives no files. Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.bpe import default_path, loaded
from weft.llm.common import open_fs, partitions_for, pieces, scratch, tidy, write_file

MAGIC = b"WTOK\x01\x00\x00\x00"
BLOCK = 1024
#: Blocks coded side by side; bounds the predictors' memory.
LANES = 8192
#: Ids in a file, at most, unless one document alone has more.
FILE_IDS = LANES * BLOCK
_SLOTS = 512
_SURE = 8
_FREQ_BITS, _TOTAL_BITS, _P_BITS = 20, 30, 16
#: Adapted probabilities stay below this, which leaves order 0 at least 2**_FREQ_BITS of 2**_TOTAL_BITS.
_P_MOST = 63_000
#: Confidence after a miss and after a hit; one of at most 2 gives the slot to the new id.
_NEXT = np.array([*(1 if c <= 2 else c >> 1 for c in range(_SURE)), *(min(c + 1, _SURE - 1) for c in range(_SURE))], np.int32)
_32, _LOW32 = np.uint64(32), np.uint64(0xFFFFFFFF)


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids that occur, in order, and their frequencies, at least 1 each, that sum to 2**_FREQ_BITS."""
    if ids.max(initial=0) < 1 << 20:
        n = np.bincount(ids)
        symbols = np.flatnonzero(n)
        n = n[symbols]
    else:
        symbols, n = np.unique(ids, return_counts=True)
    total = 1 << _FREQ_BITS
    if len(symbols) > total // 2:
        raise ValueError("too many distinct ids for a file")
    f = np.maximum(1, (n * ((total - len(symbols)) / n.sum())).astype(np.int64))
    f[f.argmax()] += total - f.sum()
    return symbols.astype(np.uint32), f


class Model:
    """Predictors of many blocks, a lane each, that all start anew. Arrays of both orders are stacked: row 0 is order 1."""

    def __init__(self, lanes: int, freq: np.ndarray) -> None:
        self.cum = np.zeros(len(freq) + 1, np.uint64)
        np.cumsum(freq, out=self.cum[1:])
        both = np.arange(2 * lanes, dtype=np.int64).reshape(2, lanes)
        self.slot_of, self.sure_of = both * _SLOTS, both * _SURE
        #: Guess and confidence of each slot, as guess << 3 | confidence.
        self.slots = np.zeros(2 * lanes * _SLOTS, np.int32)
        start = (np.arange(_SURE) + 0.4) / (np.arange(_SURE) + 1.6) * _P_MOST
        start[0] = 0  # nothing seen yet
        self.p = np.tile(start.astype(np.int64), 2 * lanes)
        self.keys = np.zeros((2, lanes), np.int64)

    def predict(self, n: int) -> None:
        """Set the mixture of the first n lanes' next ids: both guesses with their masses, and order 0's mass."""
        self.at = (self.keys[:, :n] >> 5 & _SLOTS - 1) + self.slot_of[:, :n]
        self.held = self.slots.take(self.at, mode="clip")
        self.g = self.held >> 3
        self.sure = self.held & 7
        self.p_at = self.sure_of[:, :n] + self.sure
        self.w = self.p.take(self.p_at, mode="clip")
        self.m = np.empty((2, n), np.int64)
        np.left_shift(self.w[1], _TOTAL_BITS - _P_BITS, out=self.m[1])
        np.right_shift(((1 << _P_BITS) - self.w[1]) * self.w[0], 2 * _P_BITS - _TOTAL_BITS, out=self.m[0])
        self.m0 = ((1 << _TOTAL_BITS) - self.m[0] - self.m[1]).view(np.uint64)

    def span(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and width of symbols in the mixture's cumulative distribution."""
        f = np.uint64(_FREQ_BITS)
        lo = self.cum.take(s, mode="clip") * self.m0 >> f
        width = (self.cum.take(s + 1, mode="clip") * self.m0 >> f) - lo
        self.hit = self.g == s
        lo += ((self.g < s) * self.m).sum(0).view(np.uint64)
        width += (self.hit * self.m).sum(0).view(np.uint64)
        return lo, width

    def find(self, v: np.ndarray, inverse: np.ndarray) -> np.ndarray:
        """The symbols whose spans hold v."""
        f, one = np.uint64(_FREQ_BITS), np.uint64(1)
        swap = self.g[0] > self.g[1]
        a, b = self.g.min(0), self.g.max(0)
        ma, mb = np.where(swap, self.m[::-1], self.m).view(np.uint64)
        low_a = self.cum.take(a, mode="clip") * self.m0 >> f
        end_a = (self.cum.take(a + 1, mode="clip") * self.m0 >> f) + ma
        low_b = (self.cum.take(b, mode="clip") * self.m0 >> f) + ma
        end_b = (self.cum.take(b + 1, mode="clip") * self.m0 >> f) + ma + mb
        past_a, past_b = v >= end_a, v >= end_b
        u = v - past_a * ma - past_b * mb
        c = (((u + one) << f) - one) // self.m0
        s = inverse.take(c.view(np.int64), mode="clip")
        s = np.where((v >= low_b) & ~past_b, b, s)
        return np.where((v >= low_a) & ~past_a, a, s).astype(np.int64)

    def learn(self, s: np.ndarray, n: int) -> None:
        """After span() of the same symbols."""
        self.p[self.p_at] = self.w + ((self.hit * _P_MOST - self.w) >> 5)
        kept = self.hit | (self.sure > 2)
        self.slots[self.at] = np.where(kept, self.held & -8, (s << 3).astype(np.int32)) | _NEXT.take(self.sure + (self.hit << 3), mode="clip")
        self.keys[1, :n] = self.keys[0, :n] * 0x5851 + s * 0x9E35
        self.keys[0, :n] = s * 0x9E35


def _narrow(low: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Lanes whose top word is settled, after cutting lanes that straddle it with too little width left."""
    settled = (low ^ (low + width - np.uint64(1))) <= _LOW32
    short = width <= _LOW32
    if (short > settled).any():
        cut = np.flatnonzero(short > settled)
        width[cut] = (np.uint64(1) << _32) - (low[cut] & _LOW32)
        settled[cut] = True
    return np.flatnonzero(settled)


def _shift(low: np.ndarray, width: np.ndarray, done: np.ndarray) -> np.ndarray:
    """Drop the settled words of lanes; those of them that have another one. A width of 2**32 would not fit after the shift, so all lose 1."""
    low[done] = lo = low[done] << _32
    width[done] = wd = (width[done] - np.uint64(1)) << _32 | _LOW32
    again = done[_narrow(lo, wd)]
    if len(again):
        width[done] = wd
    return again


def encode_blocks(symbols: np.ndarray, freq: np.ndarray) -> list[np.ndarray]:
    """Words of each block of BLOCK symbols (positions in the frequency table)."""
    out: list[np.ndarray] = []
    for first in range(0, len(symbols), BLOCK * LANES):
        part = symbols[first : first + BLOCK * LANES]
        lanes = -(-len(part) // BLOCK)
        grid = np.zeros(lanes * BLOCK, np.int32)
        grid[: len(part)] = part
        grid = np.ascontiguousarray(grid.reshape(lanes, BLOCK).T)
        model = Model(lanes, freq)
        low, width = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
        words = np.zeros((lanes, BLOCK + 8), np.uint32)
        used = np.zeros(lanes, np.int64)
        short = len(part) - (lanes - 1) * BLOCK
        for t in range(BLOCK if lanes > 1 else short):
            n = lanes if t < short else lanes - 1
            s = grid[t, :n].astype(np.int64)
            model.predict(n)
            start, freq_ = model.span(s)
            lo, wd = low[:n], width[:n]
            r = wd >> np.uint64(_TOTAL_BITS)
            lo += start * r
            np.multiply(freq_, r, out=wd)
            done = _narrow(lo, wd)
            while len(done):
                if (used[done] >= words.shape[1] - 2).any():
                    words = np.concatenate([words, np.zeros((lanes, BLOCK), np.uint32)], axis=1)
                words[done, used[done]] = (lo[done] >> _32).astype(np.uint32)
                used[done] += 1
                done = _shift(lo, wd, done)
            model.learn(s, n)
        for i in range(lanes):
            end = [int(low[i] >> _32), int(low[i] & _LOW32)]
            out.append(np.concatenate([words[i, : used[i]], np.array(end, np.uint32)]))
    return out


def decode_blocks(data: np.ndarray, words: np.ndarray, total: int, freq: np.ndarray) -> np.ndarray:
    """All symbols of blocks laid end to end; words: how many each has."""
    inverse = np.repeat(np.arange(len(freq), dtype=np.int32), freq)
    out = np.zeros(total, np.int32)
    data = np.concatenate([data, np.zeros(4, np.uint32)])
    starts = np.cumsum(words) - words
    for first in range(0, len(words), LANES):
        part = min(total - first * BLOCK, BLOCK * LANES)
        lanes = -(-part // BLOCK)
        at, end = starts[first : first + lanes].copy(), (starts + words)[first : first + lanes]
        model = Model(lanes, freq)
        low, width = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
        code = (data[at].astype(np.uint64) << _32) | data[at + 1]
        at += 2
        grid = np.zeros((BLOCK, lanes), np.int32)
        short = part - (lanes - 1) * BLOCK
        for t in range(BLOCK if lanes > 1 else short):
            n = lanes if t < short else lanes - 1
            model.predict(n)
            lo, wd, cd = low[:n], width[:n], code[:n]
            r = wd >> np.uint64(_TOTAL_BITS)
            v = np.minimum((cd - lo) // r, np.uint64((1 << _TOTAL_BITS) - 1))
            s = model.find(v, inverse)
            start, freq_ = model.span(s)
            lo += start * r
            np.multiply(freq_, r, out=wd)
            done = _narrow(lo, wd)
            while len(done):
                here = at[done]
                cd[done] = (cd[done] << _32) | np.where(here < end[done], data[np.minimum(here, len(data) - 1)], 0).astype(np.uint64)
                at[done] = here + 1
                done = _shift(lo, wd, done)
            model.learn(s, n)
            grid[t, :n] = s
        out[first * BLOCK : first * BLOCK + part] = grid.T.reshape(-1)[: lanes * BLOCK][:part]
    return out


def pack_file(docs: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> Iterator[bytes]:
    """A file's bytes: documents' ids and lengths, and all their token ids."""
    symbols, freq = frequencies(ids)
    if symbols[-1] < 1 << 20:
        number = np.zeros(int(symbols[-1]) + 1, np.int32)
        number[symbols] = np.arange(len(symbols))
        blocks = encode_blocks(number[ids], freq)
    else:
        blocks = encode_blocks(np.searchsorted(symbols, ids).astype(np.int32), freq)
    sums = [zlib.crc32(ids[i : i + BLOCK].astype("<u4").tobytes()) for i in range(0, len(ids), BLOCK)]
    known = np.array([d is not None for d in docs], np.uint8)
    head = b"".join(
        x.tobytes()
        for x in (known, np.array([d or 0 for d in docs], "<i8"), lengths.astype("<i8"), np.array([len(b) for b in blocks], "<u4"), np.array(sums, "<u4"), symbols.astype("<u4"), freq.astype("<u4"))
    )
    packed = zlib.compress(head, 6)
    yield MAGIC + struct.pack("<QQQQQI", len(docs), len(ids), len(blocks), len(symbols), len(packed), zlib.crc32(head)) + packed
    for b in blocks:
        yield b.astype("<u4").tobytes()


HEAD = len(MAGIC) + struct.calcsize("<QQQQQI")


def _index(data: bytes) -> tuple[list[np.ndarray], int, int]:
    """What a file's index holds, how many ids the file has, and where its blocks start."""
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token-id file")
    n_docs, n_ids, n_blocks, n_symbols, n_packed, crc = struct.unpack_from("<QQQQQI", data, len(MAGIC))
    head = zlib.decompress(data[HEAD : HEAD + n_packed])
    if zlib.crc32(head) != crc:
        raise ValueError("a file's index doesn't match its checksum")
    at, parts = 0, []
    for kind, n in (("u1", n_docs), ("<i8", n_docs), ("<i8", n_docs), ("<u4", n_blocks), ("<u4", n_blocks), ("<u4", n_symbols), ("<u4", n_symbols)):
        parts.append(np.frombuffer(head, kind, n, at))
        at += n * parts[-1].itemsize
    return parts, n_ids, HEAD + n_packed


def read_block(data: bytes, i: int) -> np.ndarray:
    """The token ids of one block, decoded from the file's index and that block's words alone; its checksum is verified."""
    (_, _, _, words, sums, symbols, freq), n_ids, at = _index(data)
    first = int(words[:i].sum())
    body = np.frombuffer(data, "<u4", int(words[i]), at + 4 * first)
    n = min(BLOCK, n_ids - i * BLOCK)
    ids = symbols[decode_blocks(body, words[i : i + 1].astype(np.int64), n, freq.astype(np.int64))]
    if zlib.crc32(ids.astype("<u4").tobytes()) != sums[i]:
        raise ValueError(f"block {i} doesn't match its checksum")
    return ids


def unpack_file(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Documents' ids, their lengths and all token ids; every checksum is verified."""
    (known, docs, lengths, words, sums, symbols, freq), n_ids, at = _index(data)
    n_blocks = len(words)
    body = np.frombuffer(data, "<u4", int(words.sum()), at)
    ids = symbols[decode_blocks(body, words.astype(np.int64), n_ids, freq.astype(np.int64))] if n_ids else np.zeros(0, np.uint32)
    for i in range(n_blocks):
        if zlib.crc32(ids[i * BLOCK : (i + 1) * BLOCK].astype("<u4").tobytes()) != sums[i]:
            raise ValueError(f"block {i} doesn't match its checksum")
    return [d if k else None for d, k in zip(docs.tolist(), known.tolist(), strict=True)], lengths, ids


@tidy
def _write(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, end: int) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    docs: list[int | None] = []
    lengths: list[np.ndarray] = []
    held: list[np.ndarray] = []
    made = size = 0

    def flush() -> pa.RecordBatch:
        ids = np.concatenate(held)
        path = f"{folder}/{part:06d}-{made:06d}.tok"
        write_file(path, pack_file(docs, np.concatenate(lengths), ids))
        return pa.RecordBatch.from_pydict({"part": [part], "no": [made], "path": [path], "n": [len(ids)]})

    for whole in batches:
        for b in pieces(whole, "text"):
            ids, at = loaded(tokenizer).encode(b.column("text"), end)
            if held and size + len(ids) > FILE_IDS:
                yield flush()
                made, size, docs, lengths, held = made + 1, 0, [], [], []
            docs += b.column("doc_id").to_pylist()
            lengths.append(np.diff(at))
            held.append(ids)
            size += len(ids)
    if held:
        yield flush()


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int]]:
    """Encode all texts and write their ids in ascending order of doc_id: (path, ids before it) of each file, in order."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    own = own.repartitionByRange(partitions_for(spark), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    files = own.mapInArrow(partial(_write, folder=folder, tokenizer=tokenizer or default_path(), end=end), "part long, no long, path string, n long").collect()
    out, before = [], 0
    for f in sorted(files, key=lambda f: (f.part, f.no)):
        out.append((f.path, before))
        before += f.n
    return out


@tidy
def _read(batches: Iterator[pa.RecordBatch], with_ids: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            fs, at = open_fs(path)
            with fs.open_input_stream(at, compression=None) as f:
                docs, lengths, ids = unpack_file(f.read())
            ends = np.cumsum(lengths)
            raw = ids.astype("<u4").tobytes()
            sums = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for n, e in zip(lengths.tolist(), ends.tolist(), strict=True)]
            cols = [pa.array(docs, pa.int64()), pa.array(before + ends - lengths), pa.array(lengths), pa.array(sums, pa.int64())]
            names = ["doc_id", "start", "n_tokens", "ids_crc32"]
            if with_ids:
                cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)


def read_token_files(spark: SparkSession, files: list[tuple[str, int]], with_ids: bool = False) -> DataFrame:
    """For each document of the files: doc_id, start, n_tokens, ids_crc32, and its ids if asked for."""
    kind = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    if not files:
        return spark.createDataFrame([], kind)
    listed = spark.createDataFrame(files, "path string, before long").repartition(len(files))
    return listed.mapInArrow(partial(_read, with_ids=with_ids), kind)


def token_round_trip(docs: DataFrame, tokenizer: str | None = None, end: int = 2) -> DataFrame:
    """Write all documents' ids to files and read the files back."""
    spark = docs.sparkSession
    return read_token_files(spark, write_token_files(docs, scratch(spark, "tokens"), tokenizer, end))

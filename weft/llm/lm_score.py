"""Language-model scores: online logistic mixing of hashed-context bit predictors, over all texts.

A text is its lower-case words and one end token. Bits are coded at two levels.

Tokens in context. Of every token the model first codes one bit: whether the token is the one that most often followed these two in the training texts. Predictors
of that bit are how often the guess followed and failed, that with the outcomes of the last two such bits
of the text, with the run of hits so far, and the hashed token before; their log-odds are mixed by weights that a
gate (the guess's counts) selects, learned online over the training texts in order, and adaptive tables
refine the mixture. A training token's own occurrence is left out of the counts that predict it.

Tokens by themselves. Tokens without a guess, and those that aren't it, are coded by two experts: their exact training count, and
their spelling: a token's bytes and a stop byte, each byte as eight bits, highest first. Five predictors
give each bit's odds from counts kept in hashed slots: the contexts are the last one, two, three and four
bytes and the whole of the token so far, each with the bits of the current byte, mixed and refined in the
same way (the gate: how often the token so far was seen, and the place in the byte).
P = (1 - e) count / all + e P(bits), with e the share of training tokens that occur once (how often a token
is new). Minus the sum of log2 is a text's cost in bits; the score is log10.

Nothing is ever gathered in one place but tables of fixed size: texts are coded by task-wise
dictionaries, whose tokens, and whose pairs of a context and what follows, meet by hash range (all
occurrences are counted, so what moves grows with the corpus); counts come back to each task's
dictionary, and texts are scored from their codes. Mixers learn on each range or unit of text and are averaged.

Tokens are told apart by 64-bit hashes, contexts by 48 bits and followers of one by 24 (fewer bytes to move). Defined cases: null and empty texts have the end token alone.
A null id is the text "null" when folds are drawn. Repeated rows are scored alike. Without training
texts all counts are 0 and every bit costs one bit. An empty table gives an empty result. Other
columns are ignored.
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

from weft.llm.common import FREE_SHUFFLES, cut, open_fs, partitions_for, pieces, scratch, setting, tidy, write_file
from weft.llm.textarrays import BASE, mix, word_hashes, words

FOLDS, HELD = 7, 2
END = b"\n"
STOP = 0x20
ORDERS = 5
SLOT_BITS = 20
#: Pieces of a predictor's slots that are summed apart.
SEGMENTS = 16
GATES = 12
CURVE = 24
_LN10 = np.log(10)
#: Text that one dictionary covers.
UNIT_BYTES = 16 << 20
END_HASH = np.uint64(0xE0D)
#: Levels of counts: 0, 1, 2, 3-4, 5-8, 9-16, 17-64 and more.
LEVELS = np.array([1, 2, 3, 5, 9, 17, 65])
#: Slots of the predictors of hits: by counts, with the last two outcomes, with the run of hits, and by the token before.
HIT_SLOTS = (64, 64 * 9, 8 * 16, 1 << 14)
HIT_TABLE = sum(HIT_SLOTS)
HIT_CURVE = 24
STRETCH = 1 << 18


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(("null" if doc_id is None else str(doc_id)).encode()) % FOLDS == HELD


class Bits:
    """Every bit of some tokens: its token, value, gate place and the five predictors' slots."""

    def __init__(self, data: np.ndarray, ends: np.ndarray) -> None:
        n = np.diff(np.concatenate([[0], ends]))
        start = ends - n
        whole = n + 1  # with the stop byte
        at = np.cumsum(whole) - whole
        own = np.repeat(np.arange(len(n)), whole)
        place = np.arange(int(whole.sum())) - at[own]
        byte = np.full(len(own), STOP, np.uint64)
        byte[place < n[own]] = data
        prev = [np.zeros(len(own), np.uint64)]
        for k in range(1, 5):
            p = np.zeros(len(own), np.uint64)
            p[k:] = byte[:-k] + np.uint64(1)
            p[place < k] = 0
            prev.append(p)
        low = [prev[1]]
        for k in range(2, 5):
            low.append(low[-1] * np.uint64(257) + prev[k])
        # a hash of all bytes so far: differences of one running sum would depend on the batch, so go place by place
        so_far = np.zeros(len(own), np.uint64)
        order = np.argsort(place, kind="stable")
        bounds = np.searchsorted(place[order], np.arange(int(place.max(initial=0)) + 2))
        for k in range(1, len(bounds) - 1):
            rows = order[bounds[k] : bounds[k + 1]]
            so_far[rows] = (so_far[rows - 1] + byte[rows - 1] + np.uint64(1)) * BASE
        self.token, self.byte, self.place = own, byte.astype(np.int64), place
        self.contexts = [mix(c + np.uint64(k + 1) * np.uint64(0xABCDEF123457)) for k, c in enumerate([*low, so_far])]

    def bit(self, j: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """The j-th bits, the byte's bits before them with a leading 1, and the slots."""
        node = (1 << j) | (self.byte >> (8 - j))
        salt = node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        slots = [((c ^ salt) * BASE >> np.uint64(64 - SLOT_BITS)).astype(np.int64) for c in self.contexts]
        return self.byte >> (7 - j) & 1, node, slots


def _unpack(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(range, hashes, counts, bytes, ends) of each row of a vocabulary."""
    for r, h, c, d, e in zip(*(b.column(x) for x in ("r", "hashes", "counts", "data", "ends")), strict=True):
        yield r.as_py(), *(_get(x, t) for x, t in ((h, "<u8"), (c, "<i8"), (d, "u1"), (e, "<i8")))


def _cut_tokens(data: np.ndarray, ends: np.ndarray, size: int = 60_000) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    for i in range(0, len(ends), size):
        lo = ends[i - 1] if i else 0
        part = slice(i, min(i + size, len(ends)))
        yield part, data[lo : ends[part.stop - 1]], ends[part] - lo


UNITS = "unit long, r long, hashes binary, counts binary, data binary, ends binary"


def _put(x: np.ndarray) -> bytes:
    """An array's bytes, the lowest of all numbers first: sorted or small numbers then compress well."""
    return np.ascontiguousarray(x.view("u1").reshape(len(x), x.itemsize).T).tobytes() if x.itemsize > 1 else x.tobytes()


def _get(x, kind: str) -> np.ndarray:
    """The array of a binary scalar that _put() wrote."""
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(x.as_buffer() if hasattr(x, "as_buffer") else x, "u1").reshape(size, -1).T).view(kind).reshape(-1)


def _row(unit: int, r: int, *parts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in (unit, r)), *(pa.array([_put(x)], pa.binary()) for x in parts)], [c.split()[0] for c in UNITS.split(", ")][: 2 + len(parts)])


def contexts(h: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What follows and the context of every token: 24 bits of its hash, and 48 of the hash of the two tokens before. h: texts end to end; count: tokens of each."""
    first = np.cumsum(count) - count
    opens = np.zeros(len(h) + 1, bool)
    opens[first] = True
    keys = np.empty(len(h), np.uint64)
    for i in range(0, len(h), STRETCH):  # a stretch at a time, for the sake of memory
        n = min(STRETCH, len(h) - i)
        before = np.full(n + 2, BASE)
        lo = max(0, i - 2)
        before[2 - (i - lo) :] = h[lo : i + n]
        new = opens[i : i + n]
        one = np.where(new, BASE, before[1 : n + 1])
        after = np.concatenate([opens[i - 1 : i] if i else [True], new[:-1]])  # the token before opens its text
        two = np.where(new | after, BASE, before[:n])
        keys[i : i + n] = mix(mix(two) * BASE + one) & ~np.uint64(0xFFFF)
    return h >> np.uint64(40), keys


def pairs(key: np.ndarray, tag: np.ndarray) -> np.ndarray:
    """A number for each pair of a context and what follows; it starts with the context's first 24 bits."""
    return key & ~np.uint64((1 << 40) - 1) | mix(key + tag * BASE) >> np.uint64(24)


@tidy
def _code(batches: Iterator[pa.RecordBatch], folder: str, ranges: int) -> Iterator[pa.RecordBatch]:
    """Write texts as codes of a dictionary for each unit of text; give out the dictionaries by hash range."""
    part, unit, size = TaskContext.get().partitionId(), 0, 0
    held: list[tuple] = []

    def flush() -> Iterator[pa.RecordBatch]:
        h = np.concatenate([x[0] for x in held])
        train = np.concatenate([x[2] for x in held])
        count = np.concatenate([x[1] for x in held])
        distinct, first, code = np.unique(h, return_index=True, return_inverse=True)
        in_train = np.bincount(code, np.repeat(train, count), len(distinct)).astype(np.int64)
        words_ = pa.chunked_array([x[3] for x in held]).combine_chunks() if len(held) > 1 else held[0][3]
        words_ = (words_.combine_chunks() if isinstance(words_, pa.ChunkedArray) else words_).take(pa.array(first))
        docs = [d for x in held for d in x[4]]
        sizes = np.concatenate([x[5] for x in held])
        name = part << 20 | unit
        known = np.array([d is not None for d in docs], "u1")
        packed = [pa.compress(x, codec="zstd", asbytes=True) for x in (_put(distinct), _put(code.astype("<u4")))]
        write_file(
            f"{folder}/codes-{name:012x}",
            [np.array([len(docs), len(code), len(distinct), len(packed[0]), len(packed[1])], "<i8").tobytes(), known.tobytes(), np.array([d or 0 for d in docs], "<i8").tobytes(), train.astype("u1").tobytes(), count.astype("<i8").tobytes(), sizes.astype("<i8").tobytes(), *packed],
        )
        off = np.frombuffer(words_.buffers()[1], "<i8", len(words_) + 1)
        data = np.frombuffer(words_.buffers()[2], "u1", off[-1]) if len(words_) and off[-1] else np.zeros(0, "u1")
        r = ((distinct >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        cuts = np.searchsorted(r, np.arange(ranges + 1))
        for i in range(ranges):
            a, b = cuts[i], cuts[i + 1]
            if a < b:
                yield _row(name, i, distinct[a:b], in_train[a:b], data[off[a] : off[b]], off[a + 1 : b + 1] - off[a])

    for whole in batches:
        for b in pieces(whole, "text"):
            texts = b.column("text")
            h, before = word_hashes(texts)
            flat, _ = words(texts, lower=True)
            n = np.diff(before)
            # the end token goes after each text's words
            at = before[1:] + np.arange(len(n))
            all_h = np.empty(len(h) + len(n), np.uint64)
            last = np.zeros(len(all_h), bool)
            last[at] = True
            all_h[last], all_h[~last] = END_HASH, h
            # only first uses need their bytes: keep the batch's distinct tokens
            docs = b.column("doc_id").to_pylist()
            train = np.array([not held_out(d) for d in docs])
            text_of = np.full(len(all_h), len(flat))
            text_of[~last] = np.arange(len(h))
            held.append((all_h, n + 1, train, pa.concat_arrays([flat, pa.array([END.decode()], pa.large_string())]).take(pa.array(text_of)), docs, np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0)).astype(np.int64)))
            size += int(held[-1][5].sum())
            if size > UNIT_BYTES:
                yield from flush()
                held, size, unit = [], 0, unit + 1
    if held:
        yield from flush()


class Texts:
    """A unit of texts, from its file of codes."""

    def __init__(self, unit: int, folder: str) -> None:
        fs, path = open_fs(f"{folder}/codes-{unit:012x}")
        with fs.open_input_stream(path, compression=None) as f:
            raw = f.read()
        self.docs, n_codes, n_distinct, *packed = np.frombuffer(raw, "<i8", 5).tolist()
        at, parts = 40, []
        for kind, k in (("u1", self.docs), ("<i8", self.docs), ("u1", self.docs), ("<i8", self.docs), ("<i8", self.docs), ("u1", packed[0]), ("u1", packed[1])):
            parts.append(np.frombuffer(raw, kind, k, at))
            at += parts[-1].nbytes
        self.known, self.ids, self.train, self.tokens, self.size, distinct, code = parts
        unpack = lambda x, n, kind: _get(pa.decompress(pa.py_buffer(x), decompressed_size=n * np.dtype(kind).itemsize, codec="zstd"), kind)
        self.distinct, self.code = unpack(distinct, n_distinct, "<u8"), unpack(code, n_codes, "<u4")

    def contexts(self) -> tuple[np.ndarray, np.ndarray]:
        """What follows and the context of every token."""
        return contexts(self.distinct[self.code], self.tokens)


FOLLOW = "unit long, r long, hashes binary, counts binary, data binary"


@tidy
def _follow(batches: Iterator[pa.RecordBatch], folder: str, ranges: int) -> Iterator[pa.RecordBatch]:
    """Each unit's distinct pairs of a context and what follows, with their training occurrences, by hash range. They are made anew from the codes, so no table holds them. All rows that name a unit come to one task."""
    done: set[int] = set()
    for b in batches:
        for name in b.column("unit").unique().to_pylist():
            if name in done:
                continue
            done.add(name)
            texts = Texts(name, folder)
            tag, key = texts.contexts()
            pair, some, which = np.unique(pairs(key, tag), return_index=True, return_inverse=True)
            seen = np.bincount(which, np.repeat(texts.train, texts.tokens), len(pair)).astype("<u4")
            key, tag = key[some], tag[some].astype("<u4")
            del texts, some, which
            cuts = np.searchsorted((pair >> np.uint64(40)) * np.uint64(ranges) >> np.uint64(24), np.arange(ranges + 1))
            for i in range(ranges):
                x = slice(cuts[i], cuts[i + 1])
                if x.start < x.stop:
                    yield _row(name, i, key[x], seen[x], tag[x])


VOCAB = "r long, n long, ones long, tokens long, hashes binary, counts binary, data binary, ends binary"


@tidy
def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vocabulary of each hash range: distinct tokens with their training counts. Rows come sorted by range."""
    held: list[tuple] = []

    def flush() -> pa.RecordBatch:
        h = np.concatenate([x[1] for x in held])
        distinct, first, code = np.unique(h, return_index=True, return_inverse=True)
        count = np.bincount(code, np.concatenate([x[2] for x in held]).astype(float), len(distinct)).astype(np.int64)
        data = np.concatenate([x[3] for x in held])
        shift = np.cumsum([0, *(len(x[3]) for x in held[:-1])])
        ends = np.concatenate([x[4] + s for x, s in zip(held, shift, strict=True)])
        n = np.concatenate([np.diff(np.concatenate([[0], x[4]])) for x in held])[first]
        ends = ends[first]
        out = np.cumsum(n)
        pos = np.arange(int(n.sum())) + np.repeat(ends - out, n)
        return pa.RecordBatch.from_pydict(
            {"r": [held[0][0]], "n": [int((count > 0).sum())], "ones": [int((count == 1).sum())], "tokens": [int(count.sum())], "hashes": [_put(distinct)], "counts": [_put(count)], "data": [data[pos].tobytes()], "ends": [_put(out.astype("<i8"))]}
        )

    for b in batches:
        for row in _unpack(b):
            if held and row[0] != held[0][0]:
                yield flush()
                held = []
            held.append(row)
    if held:
        yield flush()


@tidy
def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ones and zeros seen in each slot over these tokens' training occurrences."""
    held = np.zeros((ORDERS, 2, 1 << SLOT_BITS), np.float64)
    for b in batches:
        for _, _, count, data, ends in _unpack(b):
            some = count > 0
            n = np.diff(np.concatenate([[0], ends]))
            data, ends = data[np.repeat(some, n)], np.cumsum(n[some])
            for part, d, e in _cut_tokens(data, ends):
                bits, c = Bits(d, e), count[some][part].astype(float)
                for j in range(8):
                    bit, _, slots = bits.bit(j)
                    w = c[bits.token]
                    for k, s in enumerate(slots):
                        held[k] += np.bincount(s + (bit << SLOT_BITS), w, 2 << SLOT_BITS).reshape(2, -1)
    size = (1 << SLOT_BITS) // SEGMENTS
    for k in range(ORDERS):
        for g in range(SEGMENTS):
            part = held[k][:, g * size : (g + 1) * size]
            at = np.flatnonzero(part.any(0))
            if len(at):
                yield pa.RecordBatch.from_pydict({"k": [k * SEGMENTS + g], "at": [_put(at.astype("<u4"))], "data": [_put(part[:, at].astype("<f4").reshape(-1))]})


@tidy
def _sum_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for b in batches:
        for k, at, d in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
            if k not in held:
                held[k] = np.zeros((2, (1 << SLOT_BITS) // SEGMENTS))
            held[k][:, _get(at, "<u4")] += _get(d, "<f4").reshape(2, -1)
    for k, x in held.items():
        yield pa.RecordBatch.from_pydict({"k": [k], "data": [x.astype("<f4").tobytes()]})


class Mixer:
    """Slot counts in a shared file, mixing weights by gate and refining curves."""

    def __init__(self, path: str | None) -> None:
        self.path = path
        self.steps = 0
        self.w = np.full((GATES * 8, ORDERS + 1), 0.3)
        self.w[:, -1] = 0
        self.curve = np.zeros((GATES, CURVE, 2))
        self._counts: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_counts": None}

    def counts(self) -> np.ndarray:
        if self._counts is None:
            fs, at = open_fs(self.path)
            with fs.open_input_stream(at, compression=None) as f:
                self._counts = np.frombuffer(f.read(), "<f4").reshape(ORDERS, 2, -1)
        return self._counts

    def inputs(self, bit: np.ndarray, slots: list[np.ndarray], j: int, own: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of each predictor (and a constant), and the gate; own: training occurrences to leave out of the counts."""
        x = np.empty((len(bit), ORDERS + 1), np.float32)
        c = self.counts()
        for k, s in enumerate(slots):
            n0, n1 = c[k, 0][s], c[k, 1][s]
            if np.ndim(own):
                n0, n1 = np.maximum(0, n0 - own * (bit == 0)), np.maximum(0, n1 - own * (bit == 1))
            x[:, k] = np.log((n1 + np.float32(0.15)) / (n0 + np.float32(0.15)))
            if k == ORDERS - 1:
                gate = np.minimum(GATES - 1, np.log2(n0 + n1 + 1).astype(np.int64))
        x[:, -1] = 1
        return x, gate * 8 + j

    def learn(self, x: np.ndarray, gate: np.ndarray, bit: np.ndarray, weight: np.ndarray, rate: float) -> None:
        """One gradient step on the coding cost, by gate."""
        p = 1 / (1 + np.exp(-np.clip((x * self.w[gate]).sum(1), -30, 30)))
        g = ((bit - p) * weight)[:, None] * x
        total = np.bincount(gate, weight, len(self.w))
        for k in range(x.shape[1]):
            self.w[:, k] += rate * np.bincount(gate, g[:, k], len(self.w)) / np.maximum(total, 1e-9) * np.minimum(1, total / 20)

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """The mixture's log-odds."""
        return np.clip((x * self.w[gate].astype(np.float32)).sum(1), -15, 15)

    def refined(self, z: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """P(bit = 1) after the curves."""
        p = 1 / (1 + np.exp(-z.astype(np.float64)))
        cell = self.cell(z)
        seen = self.curve[gate >> 3, cell]
        q = (seen[:, 1] + 30 * p) / (seen.sum(1) + 30)
        return np.clip((p + q) / 2, 1e-6, 1 - 1e-6)

    @staticmethod
    def cell(z: np.ndarray) -> np.ndarray:
        return np.clip(((z + 12) * (CURVE / 24)).astype(np.int64), 0, CURVE - 1)


@tidy
def _train(batches: Iterator[pa.RecordBatch], mixer: Mixer) -> Iterator[pa.RecordBatch]:
    """An online pass over these training tokens: mixing weights, and the curves' counts with the weights as learnt so far."""
    seen = 0.0
    for b in batches:
        for _, _, count, data, ends in _unpack(b):
            some = count > 0
            n = np.diff(np.concatenate([[0], ends]))
            data, ends = data[np.repeat(some, n)], np.cumsum(n[some])
            for part, d, e in _cut_tokens(data, ends, 20_000):
                bits, c = Bits(d, e), count[some][part].astype(np.float32)
                weight = c[bits.token]
                seen += float(weight.sum())
                for j in range(8):
                    bit, _, slots = bits.bit(j)
                    x, gate = mixer.inputs(bit, slots, j, np.ones(len(bit), np.float32))
                    for i in range(0, len(bit), 4096):
                        s = slice(i, i + 4096)
                        mixer.steps += 1
                        mixer.learn(x[s], gate[s], bit[s], weight[s], 0.05 + 0.3 / (1 + mixer.steps / 200))
                    at = (gate >> 3) * CURVE + Mixer.cell(mixer.mixed(x, gate))
                    for v in (0, 1):
                        mixer.curve[:, :, v] += np.bincount(at, weight * (bit == v), GATES * CURVE).reshape(GATES, CURVE)
    if seen:
        yield pa.RecordBatch.from_pydict({"seen": [seen], "data": [np.concatenate([(mixer.w * seen).reshape(-1), mixer.curve.reshape(-1)]).tobytes()]})


@tidy
def _score_vocab(batches: Iterator[pa.RecordBatch], mixer: Mixer, total: int, new: float) -> Iterator[pa.RecordBatch]:
    """log10 probability of each token of the vocabulary."""
    for b in batches:
        for r, h, count, data, ends in _unpack(b):
            out = np.zeros(len(h))
            for part, d, e in _cut_tokens(data, ends):
                if mixer.path is None:
                    out[part] = -8 * (np.diff(np.concatenate([[0], e])) + 1) * np.log10(2)
                    continue
                bits = Bits(d, e)
                cost = np.zeros(len(bits.token))
                for j in range(8):
                    bit, _, slots = bits.bit(j)
                    x, gate = mixer.inputs(bit, slots, j, 0.0)
                    p = mixer.refined(mixer.mixed(x, gate), gate)
                    cost += np.log10(np.where(bit == 1, p, 1 - p))
                spelled = np.bincount(bits.token, cost, len(e)) + np.log10(new)
                out[part] = np.logaddexp(spelled * _LN10, np.log(np.maximum(count[part], 1e-300) * ((1 - new) / total))) / _LN10
            yield pa.RecordBatch.from_pydict({"r": [r], "hashes": [_put(h)], "counts": [_put(count)], "logs": [out.astype("<f4").tobytes()]})


@tidy
def _look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each dictionary's counts and scores, in its own order. Rows come sorted by range, the range's vocabulary (unit -1) first."""
    known: tuple[np.ndarray, ...] = ()
    for b in batches:
        for unit, r, h, c, s in zip(b.column("unit").to_pylist(), b.column("r").to_pylist(), *(b.column(x) for x in ("hashes", "counts", "logs")), strict=True):
            own = _get(h, "<u8")
            if unit < 0:
                known = own, _get(c, "<i8"), np.frombuffer(s.as_buffer(), "<f4")
                continue
            at = np.searchsorted(known[0], own)
            yield _answer(0, unit, r, known[1][at].astype("<i8").tobytes(), known[2][at].tobytes())


ANSWERS = "kind int, unit long, r long, a binary, b binary"


def _answer(kind: int, unit: int, r: int, a: bytes, b: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([unit], pa.int64()), pa.array([r], pa.int64()), pa.array([a], pa.binary()), pa.array([b], pa.binary())], ["kind", "unit", "r", "a", "b"])


def _state(hit: np.ndarray, right: np.ndarray, wrong: np.ndarray) -> np.ndarray:
    """A guess as a byte: whether there is one, whether it hits, and levels of how often it followed and something else did. No guess is 0."""
    state = 1 | hit.astype(np.int64) << 1 | np.searchsorted(LEVELS, right, "right") << 2 | np.searchsorted(LEVELS, wrong, "right") << 5
    return np.where(right > 0, state, 0).astype("u1")


def guesses(key: np.ndarray, tag: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States of pairs of a context and what follows, for a text outside training and for one of the ``seen`` training occurrences, which is left out.

    The guess is what follows most often; of equals, the smaller tag.
    """
    order = np.lexsort((tag, key))
    k, t = key[order], tag[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (t[1:] != t[:-1])
    at = np.flatnonzero(new)
    pair_of = np.empty(len(k), np.int64)
    pair_of[order] = np.cumsum(new) - 1
    k, t, n = k[at], t[at], np.add.reduceat(seen[order].astype(np.int64), at)
    best = np.lexsort((t, -n, k))
    head = np.ones(len(k), bool)
    head[1:] = k[1:] != k[:-1]  # the contexts, which both orders share
    first = np.flatnonzero(head)
    size = np.diff(np.append(first, len(k)))
    g, c1, total = t[best[first]], n[best[first]], np.add.reduceat(n, first)
    second = best[np.minimum(first + 1, len(k) - 1)]
    c2, t2 = np.where(size > 1, n[second], 0), t[second]
    of = np.cumsum(head) - 1  # a pair's context
    is_guess = t == g[of]
    outside = _state(is_guess, c1[of], (total - c1)[of])
    left = c1[of] - is_guess  # the guess's count without one occurrence of this pair
    stays = ~is_guess | (left > c2[of]) | ((left == c2[of]) & (t < t2[of]))
    right = np.where(stays, left, c2[of])
    inside = _state(is_guess & stays, right, total[of] - 1 - right)
    return outside[pair_of], inside[pair_of]


@tidy
def _guesses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """States of each unit's pairs, in its own order. Rows come sorted by range."""
    held: list[tuple] = []

    def flush() -> Iterator[pa.RecordBatch]:
        outside, inside = guesses(*(np.concatenate([x[i] for x in held]) for i in (2, 3, 4)))
        at = 0
        for unit, r, key, *_ in held:
            yield _answer(1, unit, r, outside[at : at + len(key)].tobytes(), inside[at : at + len(key)].tobytes())
            at += len(key)

    for b in batches:
        for unit, r, k, t, n in zip(b.column("unit").to_pylist(), b.column("r").to_pylist(), *(b.column(x) for x in ("hashes", "data", "counts")), strict=True):
            if held and r != held[0][1]:
                yield from flush()
                held = []
            held.append((unit, r, _get(k, "<u8"), _get(t, "<u4"), _get(n, "<u4")))
    if held:
        yield from flush()


@tidy
def _unit(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """All answers to a unit in one row, those about its guesses for each of its tokens. Rows come sorted by unit, kind and range."""
    held: list[tuple] = []

    def flush() -> pa.RecordBatch:
        join = lambda kind, i: b"".join(x[i] for x in held if x[1] == kind)
        counts, logs, outside, inside = _put(np.frombuffer(join(0, 2), "<i8")), join(0, 3), np.frombuffer(join(1, 2), "u1"), np.frombuffer(join(1, 3), "u1")
        unit = held[0][0]
        held.clear()
        texts = Texts(unit, folder)
        tag, key = texts.contexts()
        which = np.unique(pairs(key, tag), return_inverse=True)[1]
        del tag, key
        states = np.where(np.repeat(texts.train, texts.tokens) == 1, inside[which], outside[which])
        return pa.RecordBatch.from_arrays([pa.array([unit]), *(pa.array([x], pa.binary()) for x in (counts, logs, states.tobytes()))], ["unit", "counts", "logs", "states"])

    for b in batches:
        for row in zip(b.column("unit").to_pylist(), b.column("kind").to_pylist(), b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True):
            if held and row[0] != held[0][0]:
                yield flush()
                held = []
            held.append(row)
    if held:
        yield flush()


class Unit(Texts):
    """A unit of texts with its counts, scores of tokens and states of its guesses."""

    def __init__(self, row: dict, folder: str) -> None:
        super().__init__(row["unit"], folder)
        self.count, self.logs = _get(row["counts"], "<i8"), np.frombuffer(row["logs"], "<f4")
        state = np.frombuffer(row["states"], "u1")
        self.at = np.flatnonzero(state)
        owner, state = np.repeat(np.arange(self.docs, dtype=np.int32), self.tokens)[self.at], state[self.at].astype(np.int32)
        #: Which tokens with a guess are of training texts; hits; levels of both counts.
        self.learned, self.hit, self.level = self.train[owner] == 1, state >> 1 & 1, state >> 2
        before = self.distinct[self.code[np.maximum(self.at - 1, 0)]]
        self.slots = self._slots(owner, before)

    def _slots(self, owner: np.ndarray, before: np.ndarray) -> list[np.ndarray]:
        """Slots of each predictor: from what came before in the text alone."""
        n = len(owner)
        own = np.ones(n, bool)
        own[1:] = owner[1:] != owner[:-1]
        last = np.zeros((2, n), np.int64)  # 0: none, 1: a miss, 2: a hit
        last[0, 1:] = np.where(own[1:], 0, self.hit[:-1] + 1)
        last[1, 1:] = np.where(own[1:], 0, last[0, :-1])
        place = np.arange(n)
        missed = np.maximum.accumulate(np.where(own | np.concatenate([[True], self.hit[:-1] == 0])[:n], place, 0)) if n else place
        run = np.minimum(15, place - missed)
        out = [self.level, self.level * 9 + last[0] * 3 + last[1], (self.level & 7) * 16 + run, (mix(before) >> np.uint64(50)).astype(np.int64)]
        return [(s + first).astype(np.int32) for s, first in zip(out, np.cumsum([0, *HIT_SLOTS[:-1]]).tolist(), strict=True)]


class Hits:
    """Predictors of hits, their mixing weights by gate (the level of counts) and refining curves."""

    def __init__(self) -> None:
        self.seen = np.zeros((HIT_TABLE, 2))
        self.w = np.full((64, len(HIT_SLOTS) + 1), 1 / len(HIT_SLOTS))
        self.w[:, -1] = 0
        self.curve = np.zeros((64, HIT_CURVE, 2))

    def inputs(self, slots: list[np.ndarray]) -> np.ndarray:
        odds = np.log((self.seen[:, 1] + 0.4) / (self.seen[:, 0] + 0.4))
        return np.stack([*(odds[s] for s in slots), np.ones(len(slots[0]))], axis=1)

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return np.clip((x * self.w[gate]).sum(1), -12, 12)

    def learn(self, unit: Unit, batch: int = 4096) -> None:
        """Gradient steps on the coding cost over a unit's training texts, in order, and then the curves' counts."""
        rows = np.flatnonzero(unit.learned)
        stretches = [rows[i : i + 16 * batch] for i in range(0, len(rows), 16 * batch)]  # a stretch at a time, for the sake of memory
        for own in stretches:
            x, gate, bit = self.inputs([s[own] for s in unit.slots]), unit.level[own], unit.hit[own]
            for i in range(0, len(own), batch):
                s = slice(i, i + batch)
                error = (bit[s] - 1 / (1 + np.exp(-self.mixed(x[s], gate[s]))))[:, None] * x[s]
                n = np.bincount(gate[s], minlength=64)
                for k in range(x.shape[1]):
                    self.w[:, k] += 0.02 * np.bincount(gate[s], error[:, k], 64) / np.sqrt(np.maximum(n, 1) * batch)
        for own in stretches:
            gate, bit = unit.level[own], unit.hit[own]
            cell = gate * HIT_CURVE + self.cell(self.mixed(self.inputs([s[own] for s in unit.slots]), gate))
            for v in (0, 1):
                self.curve[:, :, v] += np.bincount(cell, bit == v, 64 * HIT_CURVE).reshape(64, HIT_CURVE)

    def probability(self, unit: Unit) -> np.ndarray:
        """P(hit) of each of a unit's guesses."""
        out = np.empty(len(unit.at))
        for i in range(0, len(out), 65_536):
            part = slice(i, i + 65_536)
            level = unit.level[part]
            z = self.mixed(self.inputs([s[part] for s in unit.slots]), level)
            p, seen = 1 / (1 + np.exp(-z)), self.curve[level, self.cell(z)]
            out[part] = np.clip((p + (seen[:, 1] + 30 * p) / (seen.sum(1) + 30)) / 2, 1e-5, 1 - 1e-5)
        return out

    @staticmethod
    def cell(z: np.ndarray) -> np.ndarray:
        return np.clip((z + HIT_CURVE / 2).astype(np.int64), 0, HIT_CURVE - 1)


def _units(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[Unit]:
    for b in batches:
        for i in range(b.num_rows):
            yield Unit(b.slice(i, 1).to_pylist()[0], folder)


def _parts(values: np.ndarray) -> pa.RecordBatch:
    """Those of some sums that aren't 0."""
    at = np.flatnonzero(values)
    return pa.RecordBatch.from_arrays([pa.array(at), pa.array(values[at])], ["k", "v"])


@tidy
def _hit_counts(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Misses and hits of each predictor's slots in training texts."""
    held = np.zeros(2 * HIT_TABLE)
    for unit in _units(batches, folder):
        for s in unit.slots:
            held += np.bincount(2 * s[unit.learned] + unit.hit[unit.learned], minlength=2 * HIT_TABLE)
    yield _parts(held)


@tidy
def _hit_weights(batches: Iterator[pa.RecordBatch], folder: str, hits: Hits) -> Iterator[pa.RecordBatch]:
    """Weights after an online pass, times the training tokens seen; those tokens; the curves' counts."""
    seen = 0
    for unit in _units(batches, folder):
        hits.learn(unit)
        seen += int(unit.learned.sum())
    yield _parts(np.concatenate([[seen], (hits.w * seen).reshape(-1), hits.curve.reshape(-1)]))


def _summed(parts: DataFrame, n: int) -> np.ndarray:
    """Sums over all tasks of n numbers."""
    out = np.zeros(n)
    for r in parts.groupBy("k").agg(F.sum("v").alias("v")).collect():
        out[r.k] = r.v
    return out


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"


@tidy
def _score_texts(batches: Iterator[pa.RecordBatch], folder: str, n: int, v: int, hits: Hits) -> Iterator[pa.RecordBatch]:
    """Scores of every text of each unit, from its codes."""
    for unit in _units(batches, folder):
        first = np.cumsum(unit.tokens) - unit.tokens
        base = np.add.reduceat(np.log10(unit.count + 1.0)[unit.code], first) - unit.tokens * np.log10(n + v + 1.0)
        seen = np.add.reduceat((unit.count > 0)[unit.code].astype(np.int64), first)
        cost = unit.logs[unit.code].astype(np.float64)
        p = hits.probability(unit)
        cost[unit.at] = np.where(unit.hit == 1, np.log10(p), np.log10(1 - p) + cost[unit.at])
        score = np.add.reduceat(cost, first)
        yield pa.RecordBatch.from_arrays(
            [pa.array(unit.ids, mask=unit.known == 0), pa.array(unit.train == 0), pa.array(unit.tokens), pa.array(seen), pa.array(np.full(unit.docs, n)), pa.array(base), pa.array(score), pa.array(unit.size), pa.array(-score * np.log2(10) / np.maximum(1, unit.size))],
            [c.split()[0] for c in SCORES.split(", ")],
        )


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte."""
    spark, folder = docs.sparkSession, scratch(docs.sparkSession, "lm")
    parts = partitions_for(spark)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dicts = cut(own.mapInArrow(partial(_code, folder=folder, ranges=4 * parts), UNITS), "dictionaries", "zstd")
    dealt = dicts.select("r", "hashes", "counts", "data", "ends").repartition(parts, "r").sortWithinPartitions("r")
    vocab = dealt.mapInArrow(_merge, VOCAB)
    vocab = cut(vocab, "vocabulary", "zstd")
    facts = vocab.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("v"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("ones"), F.lit(0)).alias("ones")).first()
    new = (facts.ones + 1) / (facts.n + 2)
    # read three times, so not dealt out: each time would write it all again
    spread = vocab.select("r", "hashes", "counts", "data", "ends").coalesce(min(parts, max(12, int(parts**0.5))))

    mixer = Mixer(None)
    if facts.n:
        with setting(spark, FREE_SHUFFLES, "true"):
            sums = spread.mapInArrow(_slot_counts, "k long, at binary, data binary").repartition(ORDERS * SEGMENTS, "k").mapInArrow(_sum_slots, "k long, data binary").collect()
        table = np.zeros((ORDERS, SEGMENTS, 2, (1 << SLOT_BITS) // SEGMENTS), "<f4")
        for r in sums:
            table[r.k // SEGMENTS, r.k % SEGMENTS] = np.frombuffer(r.data, "<f4").reshape(2, -1)
        table = table.transpose(0, 2, 1, 3).reshape(ORDERS, 2, -1)
        mixer = Mixer(f"{folder}/slots")
        write_file(mixer.path, [x.tobytes() for x in table])
        del table, sums
        got = spread.mapInArrow(partial(_train, mixer=mixer), "seen double, data binary").collect()
        total = sum(np.frombuffer(r.data, "<f8") for r in got)
        mixer.w, mixer.curve = total[: mixer.w.size].reshape(mixer.w.shape) / sum(r.seen for r in got), total[mixer.w.size :].reshape(mixer.curve.shape)
    scored = spread.mapInArrow(partial(_score_vocab, mixer=mixer, total=int(facts.n), new=new), "r long, hashes binary, counts binary, logs binary")
    # a range's vocabulary comes first in its task, then the dictionaries that ask for it
    none = F.lit(None).cast("binary")
    asked = scored.select(F.lit(-1).cast("long").alias("unit"), "r", "hashes", "counts", "logs").unionByName(dicts.select("unit", "r", "hashes", none.alias("counts"), none.alias("logs")))
    found = asked.repartition(parts, "r").sortWithinPartitions("r", "unit").mapInArrow(_look_up, ANSWERS)
    follow = dicts.select("unit").repartition(parts, "unit").mapInArrow(partial(_follow, folder=folder, ranges=4 * parts), FOLLOW).repartition(parts, "r").sortWithinPartitions("r", "unit")
    answers = found.unionByName(follow.mapInArrow(_guesses, ANSWERS)).repartition(parts, "unit").sortWithinPartitions("unit", "kind", "r")
    units = cut(answers.mapInArrow(partial(_unit, folder=folder), "unit long, counts binary, logs binary, states binary"), "units", "zstd")

    hits = Hits()
    if facts.n:
        hits.seen = _summed(units.mapInArrow(partial(_hit_counts, folder=folder), "k long, v double"), 2 * HIT_TABLE).reshape(-1, 2)
        got = _summed(units.mapInArrow(partial(_hit_weights, folder=folder, hits=hits), "k long, v double"), 1 + hits.w.size + hits.curve.size)
        if got[0]:
            hits.w = got[1 : 1 + hits.w.size].reshape(hits.w.shape) / got[0]
            hits.curve = got[1 + hits.w.size :].reshape(hits.curve.shape)
    return units.mapInArrow(partial(_score_texts, folder=folder, n=int(facts.n), v=int(facts.v), hits=hits), SCORES)

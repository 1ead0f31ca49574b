"""Ordinal cumulative-link regression on graded ratings, over hashed text.

P(grade >= j) = sigmoid(w.x - t_j) with one weight vector for all grades and thresholds t_1 < t_2 < ...
kept in order by learning t_1 and the logarithms of the gaps. x holds the presence of hashed
lower-case prefixes of words (4 to 8 bytes; shorter words whole), and a few shares of the whole text:
upper case, digits, other signs, long words, repeated words. All of these count against a text: only prefixes that
are significantly more frequent in a lower grade get a weight, and weights stay at most 0, so that
neither short texts nor long ones gather noise. The fit is by AdaGrad on a sample
of at most SAMPLE labelled rows, those with the smallest hashes of their ids; all else covers all rows.

A row's expected grade is the sum of P(grade >= j), its tail probability P(grade >= the top grade);
rows are kept while that is at least KEEP times the tail probability of a text that nothing counts against.

Defined cases: null and empty texts, and those without a word, have nothing to keep: their grades are 0 and
they are never selected. Labels with a null id or quality, and ids without a document, are not used; a null toxic counts
as 0. Without any labelled row nothing counts against any text, and all with a word are kept.
Repeated rows get equal scores. Other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import pieces, tidy
from weft.llm.textarrays import _LOWER, BASE, mix, text_bytes, word_spans

BITS = 22
SAMPLE = 12_000
EPOCHS = 40
KEEP = 0.85
SHARES = 5
PREFIXES = (4, 5, 6, 8)
#: A prefix must be in so many sampled rows, and be more frequent in a lower grade by so many standard errors.
LEAST_ROWS, LEAST_Z = 12, 6.0
_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,'"]] = 3


def columns(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Hashed prefixes of every word (an array for each length of prefix), words before each text, and the texts' bytes."""
    raw, off = text_bytes(texts)
    starts, ends, before = word_spans(raw, off)
    h, out = np.zeros(len(starts), np.uint64), []
    padded = np.concatenate([_LOWER[raw], np.zeros(PREFIXES[-1], np.uint8)])
    for k in range(PREFIXES[-1]):
        c = np.where(starts + k < ends, padded[starts + k], 0).astype(np.uint64)
        h = (h + c + np.uint64(1)) * BASE
        if k + 1 in PREFIXES:
            out.append((mix(h) >> np.uint64(64 - BITS)).astype(np.int32))
    return out, before, raw, off


def shares_of(last: np.ndarray, before: np.ndarray, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Upper case, digits and other signs by byte, overlong words, and words that repeat the one before; all from 0 to 1."""
    n, words = np.maximum(1, np.diff(off)), np.diff(before)
    kind, sums = _CLASS[raw], np.zeros(len(raw) + 1, np.int64)
    out = []
    for k in range(1, 4):
        np.cumsum(kind == k, out=sums[1:])
        out.append((sums[off[1:]] - sums[off[:-1]]) / n)
    out.append(np.clip((n / np.maximum(1, words) - 8) / 20, 0, 1))
    again = np.zeros(len(last) + 1, np.int64)
    np.cumsum(last[1:] == last[:-1], out=again[2:])
    out.append(np.clip((again[before[1:]] - again[np.minimum(before[:-1] + 1, before[1:])]) / np.maximum(1, words), 0, 1))
    return np.where(words == 0, 0.0, np.array(out)).T.astype(np.float32)


def features(texts: pa.Array, active: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed prefixes of each text, each once, as (columns, text starts), the texts' shares and numbers of words; only active columns if given."""
    cols, before, raw, off = columns(texts)
    doc = np.repeat(np.arange(len(before) - 1), np.diff(before))
    pairs = []
    for c in cols:
        keep = np.flatnonzero(active[c]) if active is not None else np.arange(len(c))
        pairs.append(doc[keep].astype(np.int64) << BITS | c[keep])
    pair = np.unique(np.concatenate(pairs))
    at = np.searchsorted(pair >> BITS, np.arange(len(before)))
    return (pair & (1 << BITS) - 1).astype(np.int32), at, shares_of(cols[-1], before, raw, off), np.diff(before)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * z)


def telling(cols: np.ndarray, at: np.ndarray, grade: np.ndarray, grades: int) -> np.ndarray:
    """Which columns are present more often in a lower grade, by LEAST_Z standard errors."""
    by = np.repeat(grade.astype(np.int8), np.diff(at))
    have = [np.bincount(cols[by == g], minlength=1 << BITS).astype(np.float32) for g in range(grades)]
    n = np.bincount(grade, minlength=grades)
    out = np.zeros(1 << BITS, bool)
    for a in range(grades):
        for b in range(a):
            if n[a] and n[b]:
                often = np.flatnonzero(have[a] + have[b] >= LEAST_ROWS)
                x, y = have[a][often].astype(float), have[b][often].astype(float)
                p = (x + y) / (n[a] + n[b])
                z = (y / n[b] - x / n[a]) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n[a] + 1 / n[b]))
                out[often[z >= LEAST_Z]] = True
    return out


class Ordinal:
    """Shared weights and ordered thresholds."""

    def __init__(self, grades: int = 3) -> None:
        self.w = np.zeros((1 << BITS) + SHARES, np.float32)
        self.t = np.array([-4.0, *[0.0] * (grades - 2)])
        self.active = np.ones(1 << BITS, bool)

    def __getstate__(self) -> tuple:
        some = np.flatnonzero(self.w)
        return some, self.w[some], self.t

    def __setstate__(self, state: tuple) -> None:
        self.__init__(len(state[2]) + 1)
        self.w[state[0]], self.t = state[1], state[2]
        self.active = self.w[: 1 << BITS] != 0

    def thresholds(self) -> np.ndarray:
        return np.cumsum(np.concatenate([self.t[:1], np.exp(self.t[1:])]))

    def raw(self, cols: np.ndarray, at: np.ndarray, shares: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(self.w[cols], dtype=np.float64)])
        return sums[at[1:]] - sums[at[:-1]] + shares.astype(np.float64) @ self.w[1 << BITS :].astype(np.float64)

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1, 2, ..."""
        return _sigmoid(score[:, None] - self.thresholds()[None])

    def fit(self, cols: np.ndarray, at: np.ndarray, shares: np.ndarray, grade: np.ndarray, epochs: int = EPOCHS, batch: int = 256, rate: float = 0.15, ridge: float = 1e-6, seed: int = 0) -> Ordinal:
        self.active = telling(cols, at, grade, len(self.t) + 1)
        keep = self.active[cols]
        at = np.concatenate([[0], np.cumsum(keep, dtype=np.int32)])[at].astype(np.int64)
        cols = cols[keep]
        rng, g_w, g_t = np.random.default_rng(seed), np.full(len(self.w), 1e-2, np.float32), np.full(len(self.t), 1e-2)
        count = np.bincount(grade, minlength=len(self.t) + 1)
        weight = (len(grade) / np.maximum(1, count) / len(count)) ** 0.5
        for _ in range(epochs):
            order = rng.permutation(len(grade))
            for first in range(0, len(order), batch):
                rows = order[first : first + batch]
                n = at[rows + 1] - at[rows]
                pos = np.repeat(at[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())
                c, own = cols[pos], np.repeat(np.arange(len(rows)), n)
                s = np.bincount(own, self.w[c], len(rows)) + shares[rows] @ self.w[1 << BITS :]
                p = np.hstack([np.ones((len(rows), 1)), self.tails(s), np.zeros((len(rows), 1))])
                y = grade[rows]
                i = np.arange(len(rows))
                q = np.maximum(p[i, y] - p[i, y + 1], 1e-9)
                slope = p * (1 - p)
                # d -log q / d score, and by threshold
                d_s = -(slope[i, y] - slope[i, y + 1]) / q * weight[y]
                d_t = np.zeros((len(rows), len(self.t)))
                low, high = y > 0, y < len(self.t)
                d_t[i[low], y[low] - 1] += (slope[i, y] / q * weight[y])[low]
                d_t[i[high], y[high]] -= (slope[i, y + 1] / q * weight[y])[high]
                touched, which = np.unique(c, return_inverse=True)
                g = (np.bincount(which, d_s[own], len(touched)) / len(rows) + ridge * self.w[touched]).astype(np.float32)
                g_w[touched] += g * g
                self.w[touched] = np.minimum(0, self.w[touched] - rate * g / np.sqrt(g_w[touched]))
                g = (d_s @ shares[rows] / len(rows)).astype(np.float32)
                tail = slice(1 << BITS, None)
                g_w[tail] += g * g
                self.w[tail] = np.minimum(0, self.w[tail] - rate * 3 * g / np.sqrt(g_w[tail]))
                through = np.cumsum(d_t.mean(0)[::-1])[::-1]
                through[1:] *= np.exp(self.t[1:])
                g_t += through * through
                self.t -= rate * through / np.sqrt(g_t)
        self.active = self.w[: 1 << BITS] != 0
        return self


@tidy
def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in pieces(whole, "text"):
            cols, at, shares, _ = features(b.column("text"))
            kept = [cols[at[i] : at[i + 1]].astype("<i4").tobytes() for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("grade"), pa.array(kept, pa.binary()), pa.array([x.astype("<f4").tobytes() for x in shares], pa.binary())], ["id", "grade", "cols", "shares"])


def graded(labels: DataFrame) -> DataFrame:
    """(id, grade): 0 low quality, 1 good but toxic, 2 good; the lowest where an id has several labels."""
    grade = F.when(F.col("quality") == 0, 0).when(F.coalesce("toxic", F.lit(0)) != 0, 1).otherwise(2)
    return labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min(grade).alias("grade"))


def train(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Ordinal | None:
    """Fit on the ``sample`` rated rows whose ids hash lowest."""
    drawn = ratings.orderBy(F.xxhash64("id"), "id").limit(sample)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = own.join(F.broadcast(drawn), "id").mapInArrow(_features_of, "id long, grade int, cols binary, shares binary")
    # the sample is bounded, so it fits in one task, whose memory is larger than the driver's
    fitted = rows.repartition(1).mapInArrow(_fit, "model binary").collect()
    return pickle.loads(fitted[0].model) if fitted else None


@tidy
def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("id", "cols", "shares", "grade")), strict=True)]
    if not rows:
        return
    rows.sort()
    at = np.concatenate([[0], np.cumsum([len(c) // 4 for _, c, _, _ in rows])])
    shares, grade = np.array([np.frombuffer(x, "<f4") for _, _, x, _ in rows]), np.array([g for *_, g in rows])
    cols = np.frombuffer(b"".join(c for _, c, _, _ in rows), "<i4")
    del rows
    yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(Ordinal().fit(cols, at, shares, grade))]})


def judged(texts: pa.Array, model: Ordinal | None, keep: float) -> tuple[np.ndarray, np.ndarray]:
    """P(grade >= j) of each text, and whether it is kept."""
    model = model or Ordinal()
    cols, at, shares, words = features(texts, model.active)
    tails = np.where(words[:, None] > 0, model.tails(model.raw(cols, at, shares)), 0.0)
    return tails, (words > 0) & (tails[:, -1] >= keep * model.tails(np.zeros(1))[0, -1])


@tidy
def _score(batches: Iterator[pa.RecordBatch], model: Ordinal | None, keep: float) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in pieces(whole, "text"):
            tails, kept = judged(b.column("text"), model, keep)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(tails.sum(1)), pa.array(tails[:, -1]), pa.array(kept)], ["doc_id", "expected_grade", "tail_prob", "selected"])


def score(docs: DataFrame, model: Ordinal | None, keep: float = KEEP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: doc_id, expected_grade, tail_prob, selected."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(partial(_score, model=model, keep=keep), "doc_id long, expected_grade double, tail_prob double, selected boolean")


@tidy
def _select(batches: Iterator[pa.RecordBatch], model: Ordinal | None, keep: float, text: str) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in pieces(whole, text):
            yield b.filter(pa.array(judged(b.column(text), model, keep)[1]))


def selected(docs: DataFrame, model: Ordinal | None, keep: float = KEEP, text_col: str = "text") -> DataFrame:
    """The rows that are kept, with all their columns."""
    return docs.mapInArrow(partial(_select, model=model, keep=keep, text=text_col), docs.schema)

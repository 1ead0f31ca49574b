"""Phrase mining over sorted occurrence relations, by set-oriented joins (SETM).

Texts are split into pieces and words. The occurrence relation of single words, (piece, position, word)
in that order, is written once, in rows of a few megabytes of one language with a dictionary of their words.
Occurrences of phrases of k words are the merge join of those of k - 1 words with themselves by piece and
adjacent position, after a semi-join with the frequent groups of each shorter length: a phrase is extended only
where both its first and its last words are frequent. Groups are counted within each row first, then over all
rows by parts of a hash of the phrase, as packed strings; the strings decide, not their hashes. The semi-joins
ask a bitmap of the frequent groups, of 26 bits at most, which may let other groups through; those are counted
and dropped by their count, so the result doesn't depend on it.

Scores are exact decimals: with counts of up to 14 digits no product has over 37.

Defined cases: null and empty texts have no words; a null language is ``und``; a text without words adds
nothing to its language, which then has no rows. Very long texts are a row of their own. Repeated rows count each.
Words are any bytes but blanks and the cuts; other columns don't matter, whatever their names. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.bitmaps import bitmap, has
from weft.llm.common import cut, partitions_for, pieces, tidy
from weft.llm.groups import attach
from weft.llm.textarrays import lowered, mix, string_hashes, text_bytes

WORDS = 3
LEAST = 10
SHARE = 50
TOP = 2000
SLICE = 2 << 20
#: Strings that a part holds before it adds up equal ones.
HELD = 500_000

_CUT = np.zeros(256, bool)
_CUT[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BLANK = _CUT.copy()
_BLANK[[0x20, 0x09]] = True
_STEP = mix(np.arange(2001, 2012, dtype=np.uint64)) | np.uint64(1)


def _language_rows(b: pa.RecordBatch) -> Iterator[tuple[str, pa.Array]]:
    lang = b.column("lang").dictionary_encode()
    codes = lang.indices.to_numpy()
    for i, name in enumerate(lang.dictionary.to_pylist()):
        yield name, b.filter(pa.array(codes == i))


def _blob(**columns: pa.Array) -> bytes:
    """Columns of one length, compressed: rows of the relation stay small outside the task that reads them."""
    sink = pa.BufferOutputStream()
    b = pa.RecordBatch.from_pydict(columns)
    with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(b)
    return sink.getvalue().to_pybytes()


def _relation(rows: list[tuple[str, pa.Array, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Rows of the relation of (language, dictionary, words, positions)."""
    return pa.RecordBatch.from_pydict(
        {"lang": [r[0] for r in rows], "n": [len(r[2]) for r in rows], "words": [_blob(word=r[1]) for r in rows], "occurrences": [_blob(code=pa.array(r[2].astype(np.int32)), pos=pa.array(r[3].astype(np.int32))) for r in rows]},
        schema=pa.schema([("lang", pa.string()), ("n", pa.int64()), ("words", pa.binary()), ("occurrences", pa.binary())]),
    )


@tidy
def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the relation of single words: language, dictionary, and for each occurrence its word and position;
    position 0 begins a piece."""
    for whole in batches:
        for name, own in _language_rows(whole):
            for b in pieces(own, "text", SLICE):
                raw, off = text_bytes(b.column("text"))
                if not len(raw):
                    continue
                raw = lowered(raw)
                ink = ~_BLANK[raw]
                edge = np.flatnonzero(ink[1:] != ink[:-1]) + 1
                # texts end pieces too
                turn = np.unique(np.concatenate([[0], edge, off]))
                start, stop = turn[:-1], turn[1:]
                word = ink[start]
                start, stop = start[word], stop[word]
                if not len(start):
                    continue
                cuts = np.union1d(np.flatnonzero(_CUT[raw]), off[:-1])
                piece = np.searchsorted(cuts, start, "right")
                new = np.ones(len(start), bool)
                new[1:] = piece[1:] != piece[:-1]
                at = np.arange(len(start))
                pos = at - np.maximum.accumulate(np.where(new, at, 0))
                bounds = np.append(0, np.cumsum(stop - start))
                words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(raw[ink]))).dictionary_encode()
                yield _relation([(name, words.dictionary.cast(pa.string()), words.indices.to_numpy(), pos)])


def phrase_hash(lang: int, words: list[np.ndarray]) -> np.ndarray:
    """Hash of phrases by the hashes of their language and words."""
    h = np.full(len(words[0]), lang, np.uint64)
    for i, w in enumerate(words):
        h = mix(h * _STEP[i] + w)
    return h


def _frequent(code: np.ndarray, pos: np.ndarray, hashes: np.ndarray, lang: int, marks: list[np.ndarray]) -> np.ndarray:
    """Where phrases of len(marks) + 1 words start whose shorter parts may all be frequent: joins by adjacent position."""
    at = np.arange(len(code))
    for k, m in enumerate(marks, 1):
        # semi-join of the occurrences of k words with their frequent groups
        at = at[has(m, phrase_hash(lang, [hashes[code[at + i]] for i in range(k)]).view(np.int64))]
        # merge join: the occurrence that starts one place on, in the same piece
        at = at[:-1][(at[1:] == at[:-1] + 1) & (pos[at[1:]] == pos[at[:-1]] + 1)]
    return at


def _grouped(code: np.ndarray, at: np.ndarray, k: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct phrase of k words, and how often it occurs."""
    group = code[at].astype(np.int64)
    bound = size
    for i in range(1, k):
        if bound * size >= 1 << 62:
            group = np.unique(group, return_inverse=True)[1].astype(np.int64)
            bound = len(group) + 1
        group, bound = group * size + code[at + i], bound * size
    _, first, n = np.unique(group, return_index=True, return_counts=True)
    return at[first], n


@tidy
def _counted(batches: Iterator[pa.RecordBatch], marks: list[np.ndarray], parts: int) -> Iterator[pa.RecordBatch]:
    """Phrases of len(marks) + 1 words with their counts in each row, packed by part: joined by line ends."""
    k = len(marks) + 1
    for b in batches:
        for i in range(b.num_rows):
            name = b.column("lang")[i].as_py()
            words = pa.ipc.open_stream(b.column("words")[i].as_buffer()).read_all().column(0).combine_chunks()
            own = pa.ipc.open_stream(b.column("occurrences")[i].as_buffer()).read_all()
            code, pos = (own.column(c).to_numpy() for c in ("code", "pos"))
            hashes, lang = string_hashes(words), int(string_hashes(pa.array([name]))[0])
            at, n = _grouped(code, _frequent(code, pos, hashes, lang, marks), k, len(words))
            if not len(at):
                continue
            part = (phrase_hash(lang, [hashes[code[at + j]] for j in range(k)]) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            at, n, part = at[order], n[order], part[order]
            terms = [words.take(pa.array(code[at + j])) for j in range(k)]
            phrases = terms[0] if k == 1 else pc.binary_join_element_wise(*terms, " ")
            raw, off = text_bytes(phrases)
            lead = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
            lined = np.insert(raw, off[1:], 10)
            ends = off + np.arange(len(off))
            data = [lined[ends[x] : ends[y]].tobytes() for x, y in zip(lead[:-1], lead[1:], strict=True)]
            counts = [n[x:y].astype("<u4").tobytes() for x, y in zip(lead[:-1], lead[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(part[lead[:-1]]), pa.array([name] * len(data)), pa.array(data, pa.binary()), pa.array(counts, pa.binary())], ["part", "lang", "data", "counts"])


@tidy
def _added(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Phrases that occur often enough, with their counts; rows come sorted by part and language."""
    held: list[pa.Table] = []
    rows, at = 0, None

    def add() -> pa.Table:
        t = pa.concat_tables(held).group_by("phrase").aggregate([("f", "sum")])
        return pa.table({"phrase": t.column("phrase"), "f": t.column("f_sum")})

    def out() -> pa.RecordBatch:
        t = add()
        t = t.filter(pc.greater_equal(t.column("f"), least)).combine_chunks()
        return pa.RecordBatch.from_arrays([pa.array([at[1]] * t.num_rows, pa.string()), t.column("phrase").combine_chunks().cast(pa.string()), t.column("f").combine_chunks()], ["lang", "phrase", "f"])

    for b in batches:
        for p, name, data, counts in zip(b.column("part").to_pylist(), b.column("lang").to_pylist(), b.column("data").to_pylist(), b.column("counts").to_pylist(), strict=True):
            if held and (p, name) != at:
                yield out()
                held, rows = [], 0
            at = (p, name)
            raw = np.frombuffer(data, np.uint8)
            end = np.flatnonzero(raw == 10)
            bounds = np.append(0, end - np.arange(len(end))).astype(np.int64)
            phrases = pa.LargeStringArray.from_buffers(len(end), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(raw[raw != 10])))
            held.append(pa.table({"phrase": phrases, "f": np.frombuffer(counts, "<u4").astype(np.int64)}))
            rows += len(end)
            if rows > HELD:
                held = [add()]
                rows = held[0].num_rows if held[0].num_rows < HELD // 2 else 0
    if held:
        yield out()


@tidy
def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each phrase, as phrase_hash gives it."""
    for b in batches:
        raw, off = text_bytes(b.column("phrase"))
        k = int((raw[: off[1]] == 0x20).sum()) + 1 if b.num_rows else 1
        # words of a phrase are joined by one blank each
        split = np.sort(np.concatenate([off[:-1], np.flatnonzero(raw == 0x20) + 1]))
        words = pa.LargeStringArray.from_buffers(len(split), pa.py_buffer(np.append(split - np.arange(len(split)) + np.arange(len(split)) // k, len(raw) - (k - 1) * b.num_rows)), pa.py_buffer(np.ascontiguousarray(raw[raw != 0x20])))
        h = string_hashes(words).reshape(-1, k)
        lang = string_hashes(b.column("lang"))
        out = lang.copy()
        for i in range(k):
            out = mix(out * _STEP[i] + h[:, i])
        yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64))], ["key"])


def frequent_phrases(docs: DataFrame, words: int = WORDS, least: int = LEAST, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n): all word occurrences; and for each length up to ``words`` the phrases (lang, phrase, f) that occur at least so often."""
    spark = docs.sparkSession
    own = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    relation = cut(own.mapInArrow(_occurrences, "lang string, n long, words binary, occurrences binary"), "occurrences")
    totals = relation.groupBy("lang").agg(F.sum("n").alias("n"))
    parts = partitions_for(spark)
    marks: list[np.ndarray] = []
    found: list[DataFrame] = []
    for _ in range(words):
        packed = relation.mapInArrow(partial(_counted, marks=list(marks), parts=parts), "part long, lang string, data binary, counts binary")
        dealt = packed.repartition(parts, "part").sortWithinPartitions("part", "lang")
        groups = cut(dealt.mapInArrow(partial(_added, least=least), "lang string, phrase string, f long"), "phrases")
        found.append(groups)
        if len(found) < words:
            bits = min(26, max(16, (16 * groups.count()).bit_length()))
            marks.append(bitmap(groups.mapInArrow(_keys, "key long"), bits))
    return totals, found


def collocations(docs: DataFrame, words: int = WORDS, least: int = LEAST, share: int = SHARE, top: int = TOP, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the highest-scoring phrases of two to ``words`` words of each language.

    a, l and r count the phrase and the parts of its lowest-scoring cut, n all words; a phrase goes if a longer
    candidate that contains it occurs at least ``share`` per cent as often.
    """
    totals, found = frequent_phrases(docs, words, least, lang_col, text_col)
    totals = cut(totals, "totals")
    n_rows = totals.agg(F.sum("n")).first()[0] or 0
    spark = docs.sparkSession
    if words < 2:
        return spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    every = every.select(F.struct("lang", "phrase").alias("key"), F.col("f").alias("of"))
    longer = found[1]
    for f in found[2:]:
        longer = longer.unionByName(f)
    terms = F.split("phrase", " ")
    part = lambda first, n: F.array_join(F.slice("terms", first, n), " ")
    cuts = longer.select("lang", "phrase", F.col("f").alias("a"), terms.alias("terms")).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("terms") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", F.struct("lang", part(F.lit(1), F.col("k")).alias("phrase")).alias("left"), F.struct("lang", part(F.col("k") + 1, F.size("terms") - F.col("k")).alias("phrase")).alias("right"))
    # parts that many phrases share are few and are broadcast
    for side, name in (("left", "l"), ("right", "r")):
        cuts = attach(cuts, every.select(F.col("key").alias(side), F.col("of").alias(name)), side, name, n_rows).drop(side)
    exact = lambda c: F.col(c).cast("decimal(14,0)")
    scored = cuts.withColumn("a14", exact("a")).withColumn("l14", exact("l")).withColumn("r14", exact("r")).withColumn("score", F.expr("(a14 * a14 * 1000000BD) div (l14 * r14)"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    inner = longer.select("lang", F.col("f").alias("by"), terms.alias("terms")).where(F.size("terms") > 2)
    inner = inner.withColumn("n", F.explode(F.sequence(F.lit(2), F.size("terms") - 1))).withColumn("at", F.explode(F.sequence(F.lit(1), F.size("terms") - F.col("n") + 1)))
    inner = inner.groupBy("lang", part(F.col("at"), F.col("n")).alias("phrase")).agg(F.max("by").alias("by"))
    left = best.join(inner, ["lang", "phrase"], "left").where(F.col("by").isNull() | (F.lit(100) * F.col("by") < F.lit(share) * F.col("a")))
    flat = left.select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = flat.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

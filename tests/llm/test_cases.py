"""Cases found in reviews: each is a plain statement of what an operator must do there."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weft.llm import jaccard, line_chunks, lm_score, mixing, ordinal, pivot_search, token_coder, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_coder_reads_one_block_by_itself():
    ids = (np.random.default_rng(3).zipf(1.3, 10_000) % 49_000).astype(np.uint32)
    data = b"".join(token_coder.pack_file([5], np.array([10_000]), ids))
    for i in (9, 0, 4):
        assert (token_coder.read_block(data, i) == ids[i * token_coder.BLOCK : (i + 1) * token_coder.BLOCK]).all()
    damaged = bytearray(data)
    damaged[-5] ^= 1
    assert (token_coder.read_block(bytes(damaged), 3) == ids[3 * token_coder.BLOCK : 4 * token_coder.BLOCK]).all()
    with pytest.raises(ValueError):
        token_coder.read_block(bytes(damaged), 9)


def test_coder_narrows_to_a_width_of_one():
    """A lane cut to width 1 becomes 2**32 wide at the next word, and 2**64 must not overflow after that."""
    low, width = np.array([0x12345678FFFFFFFF], np.uint64), np.array([5], np.uint64)
    done, steps = token_coder._narrow(low, width), 0
    assert width[0] == 1
    while len(done):
        done, steps = token_coder._shift(low, width, done), steps + 1
        assert steps < 4
    assert width[0] > 1 << 32


def test_guesses_against_counters():
    """The guess of a context is what follows most often in training, without the occurrence that is being predicted."""
    rng = np.random.default_rng(8)
    key, tag = rng.integers(0, 12, 300).astype(np.uint64), rng.integers(0, 5, 300).astype("<u4")
    key, tag = (x for x in np.unique(np.stack([key, tag.astype(np.uint64)]), axis=1))
    key, tag = np.concatenate([key, key[:20]]), np.concatenate([tag, tag[:20]]).astype("<u4")  # two units ask alike
    seen = rng.integers(0, 4, len(key)).astype("<u4")
    outside, inside = lm_score.guesses(key, tag, seen)
    counts = collections.defaultdict(collections.Counter)
    for k, t, n in zip(key.tolist(), tag.tolist(), seen.tolist(), strict=True):
        counts[k][t] += n

    def state(c, t):
        n, g = max(((n, -x) for x, n in c.items()), default=(0, 0))
        level = lambda x: int(np.searchsorted(lm_score.LEVELS, x, "right"))
        return 1 | (t == -g) << 1 | level(n) << 2 | level(sum(c.values()) - n) << 5 if n > 0 else 0

    for k, t, n, out, own in zip(key.tolist(), tag.tolist(), seen.tolist(), outside.tolist(), inside.tolist(), strict=True):
        assert out == state(counts[k], t)
        if n:
            assert own == state(counts[k] - collections.Counter([t]), t)


def test_every_token_has_a_context():
    """No share of contexts is drawn: each token is asked, and its context is the two tokens before it in its text."""
    h = np.random.default_rng(5).integers(1, 2**63, 900).astype(np.uint64)
    h[300:303] = h[700:703]
    tag, key = lm_score.contexts(h, np.array([1, 299, 600]))
    assert len(tag) == len(key) == len(h) and key[0] == key[1] == key[300] and key[302] == key[702]
    assert len(np.unique(key)) == len(h) - 4 and (key & np.uint64(0xFFFF) == 0).all() and (tag < 1 << 24).all()


def test_lm_scores_depend_on_the_order_of_words(spark):
    rng = random.Random(2)
    phrases = [" ".join(rng.choice("abcdefgh") + str(rng.randint(0, 400)) for _ in range(9)) for _ in range(30)]
    rows = [(i, " ".join(rng.choice(phrases) for _ in range(20))) for i in range(120)]
    mixed = [(1000 + i, " ".join(rng.sample(t.split(), len(t.split())))) for i, t in rows]
    got = {r.doc_id: r for r in lm_score.lm_scores(spark.createDataFrame(rows + mixed, "doc_id long, text string")).collect()}
    assert all(abs(got[i].base_score - got[1000 + i].base_score) < 1 for i in range(120) if got[i].held_out == got[1000 + i].held_out)
    ordered, shuffled = (np.mean([got[i].bits_per_byte for i in range(k, k + 120) if got[i].held_out]) for k in (0, 1000))
    assert ordered < 0.95 * shuffled


@pytest.mark.parametrize("passages", [False, True])
def test_line_chunks_against_a_plain_version(spark, passages):
    """Chunks that aren't the first of their kind go, and with them the lines beside them that equal those beside the first."""
    rng = random.Random(4)
    pool = ["aa bb", "cc", "dd ee ff", "", "gg", " ".join(["long"] * 50), "hh ii"]
    runs = [[f"run {i} line {j}" if j % 3 else "" for j in range(1, 12)] for i in range(5)]
    texts = {}
    for i in range(80):
        lines = [rng.choice(pool) + (f" {rng.randint(0, 3)}" if rng.random() < 0.6 else "") for _ in range(rng.randint(1, 9))]
        if i % 2:
            lines[len(lines) // 2 : len(lines) // 2] = rng.choice(runs)[rng.randint(0, 3) :]
        texts[i] = "\n".join(lines) + ("\n" if i % 3 == 0 else "")
    split = lambda t: t.split("\n")[:-1] if t.endswith("\n") else t.split("\n")
    seen, gone = {}, collections.defaultdict(set)
    for i, t in sorted(texts.items()):
        lines = split(t)
        for family, c in enumerate(line_chunks.Chunks(pa.array([t]), passages).families()):
            bounds = np.flatnonzero((c.lines > 1) | (c.alone[np.searchsorted(c.inked, c.first)])).tolist()
            whole = [(int(a), int(b)) for a, b in zip(c.first, c.last, strict=True)]
            for at in c.looked_up().tolist():
                a, b = whole[at]
                body = (family, "\n".join(lines[a : b + 1]))
                inked = [k for k, x in enumerate(lines) if WORD.search(x)]
                low = max([whole[k][0] for k in bounds if k < at], default=whole[0][0])
                low = inked[max(0, inked.index(low) - line_chunks.WINDOW)]
                high = min([whole[k][1] for k in bounds if k > at], default=whole[-1][1])
                if body not in seen:
                    seen[body] = (i, a, b, low, high)
                    continue
                j, a0, b0, low0, high0 = seen[body]
                other = split(texts[j])
                x, y = 1, 1
                first, last = a, b
                while a - x >= low and a0 - x >= low0 and lines[a - x] == other[a0 - x]:
                    first = a - x if WORD.search(lines[a - x]) else first
                    x += 1
                while b + y <= high and b0 + y <= high0 and lines[b + y] == other[b0 + y]:
                    last = b + y if WORD.search(lines[b + y]) else last
                    y += 1
                gone[i] |= set(range(first, last + 1))
    got = {r.doc_id: r for r in line_chunks.line_dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3), passages=passages).collect()}
    assert sum(map(len, gone.values())) > 100
    for i, t in texts.items():
        kept = [x for k, x in enumerate(split(t)) if k not in gone[i]]
        want = "\n".join(kept) + ("\n" if kept and t.endswith("\n") else "") if gone[i] else t
        assert (got[i].text, got[i]._removed) == (want, len(gone[i])), i


def test_columns_with_helper_names_stay(spark):
    rows = [(i, f"some words {i % 4} of a text that {i % 3} others have", "ab"[i % 2], i, "x") for i in range(24)]
    cols = "doc_id long, text string, source string, _w long, _gone string"
    df = spark.createDataFrame(rows, cols).withColumnRenamed("_w", "_wsize")
    for out in (mixing.mixed_documents(df), line_chunks.line_dedup(df).drop("_removed"), jaccard.one_of_each(df)):
        assert out.columns == df.columns and all(r._gone == "x" and r._wsize == r.doc_id for r in out.collect())


def test_mix_of_a_few_words(spark):
    df = spark.createDataFrame([(1, "one two three", "a"), (2, "four five six seven", "b")], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.mix(df).collect()}
    assert all(0 < r.taken <= 3 * r.size for r in got.values())


def test_texts_without_words_are_not_selected(spark):
    df = spark.createDataFrame([(1, "words here"), (2, None), (3, ""), (4, " \n ")], "doc_id long, text string")
    got = {r.doc_id: r for r in ordinal.score(df, None).collect()}
    assert [i for i, r in got.items() if r.selected] == [1] and got[2].expected_grade == got[3].tail_prob == got[4].tail_prob == 0


def test_ordinal_probabilities_are_the_models(spark):
    """P(grade >= j) = sigmoid(w.x - t_j) with the weights and features of a plain reading of the text."""
    import pyarrow as pa

    model = ordinal.Ordinal()
    rng = np.random.default_rng(1)
    model.w[: 1 << ordinal.BITS] = -np.abs(rng.normal(0, 0.1, 1 << ordinal.BITS)).astype(np.float32)
    texts = ["Plain words and some MORE words words", "x", "99 bottles!! of ###"]
    tails, _ = ordinal.judged(pa.array(texts), model, 0.5)
    for t, row in zip(texts, tails, strict=True):
        cols = set()
        for w in t.lower().encode().split():
            h = 0
            for k in range(8):
                h = (h + (w[k] if k < len(w) else 0) + 1) * 0x9E3779B97F4A7C15 % 2**64
                if k + 1 in ordinal.PREFIXES:
                    cols.add(int(ordinal.mix(np.array([h], np.uint64))[0] >> np.uint64(64 - ordinal.BITS)))
        score = sum(float(model.w[c]) for c in cols)
        assert np.allclose(row, 1 / (1 + np.exp(model.thresholds() - score)), rtol=1e-4)


def test_warc_of_more_than_one_read(spark):
    """Archives longer than a read, with payloads that don't compress."""
    rng = random.Random(1)
    rows = [(i, "u", "".join(chr(rng.randrange(0x21, 0x2000)) for _ in range(700_000))) for i in range(3)]
    assert sum(len(r[2].encode()) for r in rows) > 3 * warc.READ_BYTES
    got = {r.page_id: r for r in warc.warc_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()}
    assert all(got[i].payload_digest == warc.digest32(h.encode()) and got[i].payload_bytes == len(h.encode()) for i, _, h in rows)


def test_warc_of_an_input_that_changes_its_partitions(spark):
    """Every group of equal payloads has one response, and revisits name its record, however rows are dealt."""
    rows = [(i, "u", f"page {i % 5}") for i in range(40)] + [(0, "u", "page 0")] * 3
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7).withColumn("r", F.rand()).orderBy("r")
    got = warc.warc_round_trip(pages).collect()
    assert collections.Counter(r.payload_digest for r in got if r.record_type == "response").most_common(1)[0][1] == 1
    assert len(got) == 43 and {r.refers_to for r in got if r.record_type == "revisit"} == {0, 1, 2, 3, 4}


def test_pivot_search_ignores_other_columns_and_repeats_queries(spark):
    rng = np.random.default_rng(2)
    v = [(i, [float(x) for x in rng.integers(-9, 9, 4)], i, "x") for i in range(50)]
    df = spark.createDataFrame(v, "vec_id long, v array<double>, score long, rank string")
    queries = df.where("vec_id < 2").unionByName(df.where("vec_id = 0"))
    got = collections.Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in pivot_search.top_k(df, queries, 3).collect())
    for q, times in ((0, 2), (1, 1)):
        best = sorted((-int(np.dot(v[q][1], x)), i) for i, x, *_ in v if i != q)[:3]
        assert all(got[q, k + 1, i, -s] == times for k, (s, i) in enumerate(best))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    clean = [f"{a}{b}" for a in ("river", "stone", "garden", "winter", "letter", "music") for b in "abcdefghij"]
    junk = [f"zzq{a}{b}" for a in "abcdefgh" for b in "xyzw"]
    text = lambda vocabulary, n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared = "\n".join(text(clean, 9) for _ in range(4))
    docs, labels = [], []
    for i in range(900):
        bad = i % 3 == 0
        body = text(junk + clean, 40) if bad else text(clean, 60)
        if not bad and i % 10 == 1:
            body = body + "\n" + shared
        docs.append((i, body, "en", "abc"[i % 3 + (i % 5 == 0)] if i % 3 < 2 else "c", len(body)))
        labels.append((i, int(not bad), 0))
    docs.append((1000, docs[1][1], "en", "a", docs[1][4]))
    docs.append((1002, docs[4][1].rsplit(" ", 1)[0] + " river0 stone1", "en", "a", docs[4][4]))
    docs.append((1001, None, None, None, None))
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels[:600], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_pipeline_with_labels(spark, corpus):
    """Each stage's decisions take effect on what the stage before kept."""
    import corpus_pipeline

    stages, now = {}, spark.read.parquet(f"{corpus}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, corpus)
        stages[name] = rows = now.collect()
        now = spark.createDataFrame(rows, now.schema)
    kept = {r.doc_id for r in stages["quality"]}
    assert len(kept & {i for i in range(900) if i % 3}) > 590 and len(kept & {i for i in range(0, 900, 3)}) < 10 and 1001 not in kept
    assert {r.doc_id for r in stages["lines"]} == kept
    with_shared = [r for r in stages["lines"] if r.text.count("\n") >= 4]
    assert len(with_shared) == 1 and next(r.text for r in stages["lines"] if r.doc_id == 1000) == ""
    near = {r.doc_id for r in stages["near"]}
    assert near == kept - {1002}
    assert {r.doc_id for r in stages["mix"]} <= near
    by = collections.Counter(r.source for r in stages["mix"])
    assert len(by) >= 2
    assert {r.doc_id for r in stages["pack"]} == {r.doc_id for r in stages["mix"]}
    at = collections.Counter()
    for r in stages["pack"]:
        at[r.sequence_id] += r.length
    assert max(at.values()) <= 2048 and sum(v < 2048 for v in at.values()) <= 1

"""Every operator against a plain version of itself, on rows with all the awkward cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from weft.llm import cuckoo, jaccard, line_chunks, lm_score, mixing, ordinal, packing, pivot_search, token_coder, warc
from weft.llm.bpe import default_path

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return [w.lower() for w in WORD.findall((text or "").encode())]


@pytest.fixture(scope="module")
def ids(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    return [t.encode(r[1] or "", add_special_tokens=False).ids for r in rows]


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


def test_token_files(spark, docs, rows, ids, empty):
    got = token_coder.token_round_trip(docs).collect()
    want = sorted(((-1, 0) if r[0] is None else (0, r[0]), r[1] or "", i) for r, i in zip(rows, ids, strict=True))
    assert sorted((r.n_tokens, r.ids_crc32) for r in got) == sorted((len(i) + 1, crc([*i, 2])) for _, _, i in want)
    start = 0
    for r, (key, _, _) in zip(sorted(got, key=lambda r: r.start), want, strict=True):
        assert r.start == start and (-1 if r.doc_id is None else r.doc_id) == (key[1] if key[0] == 0 else -1)
        start += r.n_tokens
    assert token_coder.token_round_trip(empty).count() == 0


def test_coder_rejects_damage():
    data = bytearray(b"".join(token_coder.pack_file([1, None], np.array([5000, 4000]), np.arange(9000, dtype=np.uint32) % 77)))
    docs, n, out = token_coder.unpack_file(bytes(data))
    assert docs == [1, None] and n.tolist() == [5000, 4000] and (out == np.arange(9000) % 77).all()
    data[-9] ^= 4
    with pytest.raises(ValueError):
        token_coder.unpack_file(bytes(data))


@pytest.mark.parametrize("n", [1, 2, 4096, 4097, 30_000])
def test_coder_round_trip(n):
    rng = np.random.default_rng(n)
    for x in (rng.zipf(1.4, n) % 49_000, np.zeros(n), rng.integers(0, 49_408, n), np.arange(n) % 3):
        x = x.astype(np.uint32)
        assert (token_coder.unpack_file(b"".join(token_coder.pack_file([0], np.array([n]), x)))[2] == x).all()


def test_pivot_search(spark):
    rng = np.random.default_rng(0)
    v = [(i, [float(x) for x in rng.normal(0, 0.3, 8)]) for i in range(200)]
    v += [(200, v[40][1]), (240, v[40][1]), (300, None), (320, [1.0, None]), (340, [float("nan")] * 8), (360, [1.0, 2.0]), (380, []), (None, [1.0] * 8), (400, [float("inf")] * 8)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>")
    q = pivot_search.quantised(df)
    got = collections.defaultdict(list)
    for r in pivot_search.top_k(q, q.where("vec_id % 20 = 0"), k=7, pivots=5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    m = {i: np.floor(64 * np.array([*np.float32(x), *[0.0] * (8 - len(x))]).astype(float)).astype(int) for i, x in v if i is not None and x is not None and all(y is not None and math.isfinite(y) for y in x)}
    for i in m:
        if i % 20 == 0:
            assert got[i] == sorted(((j, int(m[i] @ m[j])) for j in m if j != i), key=lambda x: (-x[1], x[0]))[:7]
    assert set(got) == {i for i in m if i % 20 == 0}
    assert pivot_search.top_k(q.where("vec_id < 0"), q).count() == 0


def test_pivot_search_of_unequal_norms(spark):
    """Tight clusters whose norms differ by 20 times: no true neighbour's annulus is skipped."""
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (40, 16))
    centres *= (np.where(np.arange(40) % 2, 10, 0.5) / np.linalg.norm(centres, axis=1))[:, None]
    m = np.floor(64 * (centres[np.arange(4000) % 40] * (1 + rng.normal(0, 0.02, (4000, 16))))).astype(int)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "vec_id long, v array<double>")
    got = collections.defaultdict(list)
    for r in pivot_search.top_k(df, df.where("vec_id < 400")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    for i in range(400):
        scores = m @ m[i]
        assert got[i] == [(j, int(scores[j])) for j in np.lexsort((np.arange(4000), -scores)).tolist() if j != i][:20]


def test_line_chunks(docs, rows, empty):
    got = line_chunks.line_dedup(docs, passages=True).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {*"doc_id text lang source n_chars row size digest key".split(), "_removed"}
    before = collections.Counter((r[0], r[1]) for r in rows)
    assert all(r.text is None for r in got if r.n_chars is None and r.doc_id is not None)
    # what goes had been elsewhere; every line that was anywhere is still somewhere
    lines = lambda texts: {x for t in texts if t for x in t.split("\n")}
    assert lines(t for _, t in before) == lines(r.text for r in got)
    kept = collections.Counter(x for r in got if r.text for x in r.text.split("\n") if len(x.split()) >= 50)
    shared = next(x for r in rows if r[1] and r[1].count("\n") == 2 for x in r[1].split("\n") if len(x.split()) == 70)
    assert kept[shared] == 1
    assert sum(r._removed for r in got) >= 5
    assert line_chunks.line_dedup(empty).count() == 0


def test_line_chunks_find_runs_of_short_lines(spark):
    """Repeated runs of 2 to 40 lines: at least nine in ten go whole, with nothing else; single lines stay."""
    line = lambda i, j: " ".join(f"w{i}x{j}y{k}" for k in range(8))
    other = lambda i, n=5: [line(i, j) for j in range(n)]
    texts, want = [], []
    for i, n in enumerate([*range(2, 41)] * 4):
        run = other(1000 + i, n)
        run.insert(1, "")
        texts += [[*other(10_000 + 10 * i), *run, *other(10_001 + 10 * i)], [*other(10_002 + 10 * i), *run, *other(10_003 + 10 * i)]]
        want += [texts[-2], [*other(10_002 + 10 * i), *other(10_003 + 10 * i)]]
    single = line(5000, 0)
    for i in (5001, 5002):
        texts.append([*other(i), "", single, *other(i + 10)])
        want.append(texts[-1])
    df = spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in line_chunks.line_dedup(df).collect()}
    whole = 0
    for i, t in enumerate(want):
        if len(t) == len(texts[i]):
            assert got[i].text == "\n".join(t) and got[i]._removed == 0
        else:
            whole += got[i].text == "\n".join(t)
            assert got[i].text in ("\n".join(t), "\n".join(texts[i]))
    assert whole >= 0.9 * 39 * 4


def test_line_chunks_move_with_inserted_lines():
    import pyarrow as pa

    lines = [f"line {i * 7919 % 1000} of text" for i in range(200)]
    a = line_chunks.Chunks(pa.array(["\n".join(lines)]))
    b = line_chunks.Chunks(pa.array(["\n".join([*lines[:50], "new", *lines[50:]])]))
    assert len(set(a.hash.tolist()) & set(b.hash.tolist())) >= 0.9 * len(a.hash)
    assert b"\n".join(a.text(i) for i in range(len(a.hash))) == "\n".join(lines).encode() and 1.5 < len(lines) / len(a.hash) < 3


def test_targets():
    assert mixing.targets([("a", 100), ("b", 100), (None, 100)]) == {"a": 187.5, "b": 75.0, None: 37.5}
    got = mixing.targets([("a", 10), ("b", 1000)])
    assert got == {"a": 30.0, "b": 980.0}
    assert mixing.targets([("a", 0), ("b", 5)]) == {"a": 0.0, "b": 5.0}


def test_mixing(docs, rows, empty):
    got = mixing.mix(docs).collect()
    size = {}
    for r in rows:
        size[r[3]] = size.get(r[3], 0) + len(words(r[1]))
    goal = mixing.targets(list(size.items()))
    assert sorted((r.doc_id or -1, r.size, r.source_size, round(r.target, 6)) for r in got) == sorted((r[0] or -1, len(words(r[1])), size[r[3]], round(goal[r[3]], 6)) for r in rows)
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    by = collections.Counter()
    for r in got:
        by[r.source_size, r.target] += r.taken
    for (_, t), n in by.items():
        assert abs(n - t) <= 5 * 16
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs).collect()), key=str)
    mixed = mixing.mixed_documents(docs).collect()
    assert abs(sum(len(words(r.text)) for r in mixed) - sum(r.taken for r in got)) <= 3
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_mixing_meets_targets_of_small_sources(spark, monkeypatch):
    """Sources that are small beside the whole meet their targets, however few slots there are."""
    monkeypatch.setattr(mixing, "SLOTS", 128)
    rows = [(i, " ".join(f"w{i}" for _ in range(100)), "big") for i in range(600)]
    rows += [(1000 + i, " ".join(f"v{i}" for _ in range(25)), "few") for i in range(40)]
    rows += [(2000, "x " * 530, "more"), (3000, "one two three", "tiny")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by = collections.Counter()
    for r in got:
        by[r.source_size, r.target] += r.taken
    assert len(by) == 4
    for (n, t), taken in by.items():
        assert abs(taken - t) <= max(8, n / 1000)


def test_lm_scores(docs, rows, empty):
    got = {}
    for r in lm_score.lm_scores(docs).collect():
        got.setdefault((r.doc_id, r.n_bytes), r)
    tokens = [[*words(r[1]), None] for r in rows]
    train = [zlib.crc32(("null" if r[0] is None else str(r[0])).encode()) % 7 != 2 for r in rows]
    count = collections.Counter(x for t, k in zip(tokens, train, strict=True) if k for x in t)
    n, v = sum(count.values()), len(count)
    for r, t, k in zip(rows, tokens, train, strict=True):
        x = got[r[0], len((r[1] or "").encode())]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (not k, len(t), sum(count[w] > 0 for w in t), n)
        assert math.isclose(x.base_score, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        assert x.score < 0 and math.isclose(x.bits_per_byte * max(1, x.n_bytes), -x.score * math.log2(10), rel_tol=1e-9)
    known = [x for x in got.values() if not x.held_out]
    assert sum(x.score for x in known) > 1.5 * sum(x.base_score for x in known)
    assert lm_score.lm_scores(empty).count() == 0


def test_bits_are_a_distribution():
    """The probabilities of all next bytes add up to 1 whatever was learnt."""
    mixer = lm_score.Mixer("x")
    rng = np.random.default_rng(0)
    mixer._counts = rng.gamma(0.3, 3, (lm_score.ORDERS, 2, 1 << lm_score.SLOT_BITS)).astype("f4")
    mixer.w = rng.normal(0, 0.5, mixer.w.shape)
    data = np.concatenate([np.array([97, 98, c], "u1") for c in range(256)])
    bits = lm_score.Bits(data, np.arange(3, 769, 3))
    p = np.ones(256)
    at = (bits.place == 2).nonzero()[0]
    for j in range(8):
        bit, _, slots = bits.bit(j)
        x, gate = mixer.inputs(bit, slots, j, 0.0)
        q = mixer.refined(mixer.mixed(x, gate), gate)
        p *= np.where(bit == 1, q, 1 - q)[at]
    assert math.isclose(p.sum(), 1, rel_tol=1e-9)


def test_nnls():
    a = np.array([[1.0, 0, 1], [0, 2, 1], [1, 1, 0]])
    assert np.allclose(packing.nnls(a, a @ [3, 0, 2]), [3, 0, 2], atol=1e-8)
    x = packing.nnls(np.array([[1.0], [1.0]]), np.array([-1.0, -2.0]))
    assert (x == 0).all()


def test_packing(docs, rows, ids, empty):
    got = packing.pack(docs).collect()
    want = collections.Counter((r[0], len(i) + 1, crc([*i, 1])) for r, i in zip(rows, ids, strict=True))
    by_seq = collections.defaultdict(list)
    for r in got:
        by_seq[r.sequence_id].append((r.offset, r.length))
    for s in by_seq.values():
        at = 0
        for o, n in sorted(s):
            assert o == at and n > 0
            at += n
        assert at <= 2048
    assert sum(sum(n for _, n in s) < 2048 for s in by_seq.values()) <= 1
    assert sum(r.length for r in got) == sum(n * k for (_, n, _), k in want.items())
    tokens = collections.defaultdict(list)
    for r, i in zip(rows, ids, strict=True):
        tokens[r[0], len(i) + 1].append([*i, 1])
    for r in got:
        assert any(crc(t[r.start : r.start + r.length]) == r.ids_crc32 for t in tokens[r.doc_id, r.doc_tokens])
    assert packing.pack(empty).count() == 0


def test_warc(spark):
    rows = [(1, "http://a/", "x" * 5000), (2, None, "x" * 5000), (3, "http://b/ c\n", ""), (4, "u", None), (None, "u", "x" * 5000), (9, "u", "é\r\n\r\nWARC/1.1\r\n"), (9, "u", "é\r\n\r\nWARC/1.1\r\n"), (0, "u", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", __import__("pyspark").sql.functions.lit(1))
    got = collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.warc_round_trip(pages).collect())
    d = lambda s: warc.digest32(s.encode())
    x, y = "x" * 5000, "é\r\n\r\nWARC/1.1\r\n"
    assert got == collections.Counter([(1, 5000, d(x), "response", None), (2, 5000, d(x), "revisit", 1), (None, 5000, d(x), "revisit", 1), (3, 0, d(""), "response", None), (4, 0, d(""), "revisit", 3), (9, len(y.encode()), d(y), "response", None), (9, len(y.encode()), d(y), "revisit", 9), (0, 1, d("y"), "response", None)])
    assert warc.warc_round_trip(pages.limit(0)).count() == 0


def test_warc_reader_verifies(tmp_path):
    good = warc.record(1, 0, "http://a/", b"payload", None)
    (tmp_path / "a.warc.gz").write_bytes(good * 3)
    assert [r[0] for r in warc.read_records(str(tmp_path / "a.warc.gz"))] == [1, 1, 1]
    (tmp_path / "b.warc.gz").write_bytes(good[:-3])
    with pytest.raises(ValueError):
        list(warc.read_records(str(tmp_path / "b.warc.gz")))
    with pytest.raises(ValueError):
        warc.parse(zlib.decompress(good, 31).replace(b"payload", b"pAyload"))


def shingles(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


@pytest.mark.parametrize(("k", "num", "den"), [(4, 85, 100), (5, 8, 10), (1, 1, 2)])
def test_jaccard(docs, rows, empty, k, num, den):
    sets = [shingles(r[1], k) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and den * both >= num * len(a | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    want = sorted((str(r[0]), len(s), str(least.get(root(i)) if s else r[0])) for i, (r, s) in enumerate(zip(rows, sets, strict=True)))
    got = jaccard.near_groups(docs, k, num, den).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == want
    if k == 4:
        assert jaccard.near_groups(empty).count() == 0
        kept = jaccard.one_of_each(docs, k, num, den).collect()
        left = {root(i) for i, s in enumerate(sets) if s}
        assert len({frozenset(shingles(r.text, k)) for r in kept if words(r.text)}) == len(left)


def test_least_shared():
    """No pair of set sizes that can link shares fewer leading shingles than assumed."""
    for num, den in ((85, 100), (8, 10), (1, 2)):
        for n in range(1, 200):
            for m in range(-(-num * n // den), den * n // num + 1):
                assert jaccard.least_shared(n, num, den) <= min(jaccard.lead(n, num, den), jaccard.lead(m, num, den))


def test_ordinal(spark, docs, rows, empty):
    rng = np.random.default_rng(1)
    vocabulary = [f"word{i}" for i in range(300)]
    train = []
    for i in range(900):
        text = " ".join(rng.choice(vocabulary, 40))
        g = i % 3
        train.append((i, ("!! ".join(text.upper().split()) if g == 0 else text + " horrid stuff" if g == 1 else text), int(g > 0), int(g == 1)))
    df = spark.createDataFrame(train, "doc_id long, text string, quality int, toxic int")
    labels = df.where("doc_id < 600").select("doc_id", "quality", "toxic")
    labels = labels.union(spark.createDataFrame([(None, 1, 0), (5, None, 1), (99_999, 1, None)], labels.schema))
    model = ordinal.train(df, ordinal.graded(labels))
    got = {r.doc_id: r for r in ordinal.score(df, model).collect()}
    right = sum(got[i].selected == (i % 3 == 2) for i in range(600, 900))
    assert right >= 290
    assert model.thresholds()[0] < model.thresholds()[1]
    assert all(0 <= r.tail_prob <= r.expected_grade <= 2 for r in got.values())
    assert ordinal.score(docs, model).count() == len(rows) and ordinal.score(empty, model).count() == 0
    none = ordinal.train(df, ordinal.graded(labels.limit(0)))
    assert none is None and ordinal.score(docs, none).where("selected").count() == sum(bool(words(r[1])) for r in rows)
    assert ordinal.selected(docs, none).count() == sum(bool(words(r[1])) for r in rows)


def test_cuckoo(docs, rows, empty):
    got = cuckoo.exact_dedup(docs).collect()
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    want = []
    for t, members in groups.items():
        keep = max((x for x in members if x is not None), default=None)
        want += [(str(x), str(keep), len(members), hashlib.sha256(t.encode()).hexdigest()) for x in members]
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == sorted(want)
    assert collections.Counter(r.text_sha256 for r in got if r.kept) == collections.Counter({hashlib.sha256(t.encode()).hexdigest(): 1 for t in groups})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert cuckoo.exact_dedup(empty).count() == 0


def test_cuckoo_index():
    index = cuckoo.LiveIndex(4)
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    assert all(index.add(k, 1, (i,)) for i, k in enumerate(keys)) and index.resized > 5
    assert not any(index.add(k, 1, (-1,)) for k in keys)
    assert all(index.find(k) == [k, 1, (i,), 2] for i, k in enumerate(keys))
    for k in keys[::2]:
        assert index.remove(k) and index.remove(k) and not index.remove(k)
    assert all((index.find(k) is None) == (i % 2 == 0) for i, k in enumerate(keys))
    assert index.find(hashlib.sha256(b"other").digest()) is None
    with pytest.raises(ValueError):
        index.add(keys[1], 2, (0,))


def test_cuckoo_index_of_a_stream():
    """Inserts and deletes in any order, against a counter; the filter turns most unknown digests away unseen."""
    rng, index, live = random.Random(9), cuckoo.LiveIndex(2), collections.Counter()
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(300)]
    for _ in range(20_000):
        k = rng.choice(keys)
        if rng.random() < 0.55:
            assert index.add(k, 7, (0,)) == (not live[k])
            live[k] += 1
        else:
            assert index.remove(k) == (live[k] > 0)
            live[k] = max(0, live[k] - 1)
        assert index.live == sum(n > 0 for n in live.values())
    assert {e[0]: e[3] for e in index.entries()} == {k: n for k, n in live.items() if n}
    others = [hashlib.sha256(f"x{i}".encode()).digest() for i in range(2000)]
    assert sum(k in index.filter for k in others) < 20 and all(index.find(k) is None for k in others)


def test_cuckoo_of_many_digests_a_task(docs, rows, monkeypatch):
    monkeypatch.setattr(cuckoo, "HELD", 3)
    held = sum((list(b.to_pylist()) for b in cuckoo._merge.__wrapped__(iter([pa_batch(rows)]))), [])
    assert len(held) > len({r["digest"] for r in held}) > 30 and sum(r["group_size"] for r in held) == len(rows)


def pa_batch(rows):
    import pyarrow as pa

    text = [(r[1] or "").encode() for r in rows]
    cols = [[hashlib.sha256(t).digest() for t in text], [len(t) for t in text], [r[0] for r in rows], list(range(len(rows))), [1] * len(rows)]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, cuckoo.GROUPS.types, strict=True)], schema=cuckoo.GROUPS)


def test_tokens_equal_the_library(rows, ids):
    import pyarrow as pa

    from weft.llm.bpe import loaded

    odd = ["İstanbul ΣΑΣ. é ́x ŉ ſ a.b.c !!! ...|||", "<|STARTOFTEXT|>x <|startoftext|>", "x\x85y \x00\x01z \x0bq", "it's we'll ''s 12 x1y"]
    w = loaded(default_path())
    for texts in ([r[1] for r in rows], odd):
        flat, at = w.encode(pa.array(texts, pa.string()), 2)
        for i, t in enumerate(texts):
            assert flat[at[i] : at[i + 1]].tolist() == [*w.whole.encode(t or "", add_special_tokens=False).ids, 2]


def test_pipeline(spark, rows, tmp_path):
    import corpus_pipeline

    cols = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([r[:5] for r in rows], cols).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, str(tmp_path))
        assert d.columns == [c.split()[0] for c in cols.split(", ")], name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0

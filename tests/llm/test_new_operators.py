"""Operators 11 to 13 against plain versions."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from weft.llm import bwt_merge, curve_clusters, jaccard, lm_score, pivot_search, setm
from weft.llm.textarrays import string_hashes, word_hashes

from .conftest import SCHEMA


def _plain_repeats(rows, length):
    """Per (doc_id, text): bytes, removed, spans, what is kept."""
    docs = sorted({(r[0] is not None, r[0] or 0, r[1] or "") for r in rows})
    seen, out = set(), {}
    for there, i, text in docs:
        raw = text.encode()
        gone = np.zeros(len(raw) + 1, bool)
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            if w in seen:
                gone[s : s + length] = True
            seen.add(w)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], gone]).astype(int)) == 1)
        out[i if there else None, text] = (len(raw), int(gone.sum()), len(edge), bytes(b for b, g in zip(raw, gone, strict=False) if not g))
    return out


def _found_repeats(df):
    return {(r.doc_id, r.text or ""): (r.n_bytes, r.n_removed, r.n_spans, bytes(r._kept)) for r in df.collect()}


def test_repeats_against_all_windows(spark, docs, rows, empty):
    got = bwt_merge.repeats_removed(docs)
    assert got.columns == [*docs.columns, "n_bytes", "n_removed", "n_spans", "_spans", "_kept"]
    assert _found_repeats(got) == _plain_repeats(rows, 100) and got.count() == len(rows)
    assert sum(r.n_removed for r in got.collect()) > 10_000
    for r in got.collect():
        raw, at, left = (r.text or "").encode(), 0, b""
        for s in r._spans:
            left, at = left + raw[at : s.start], s.stop
        assert left + raw[at:] == bytes(r._kept)
    assert bwt_merge.repeats_removed(empty).count() == 0


def test_repeats_of_hot_cores_shards_and_stretches(spark, monkeypatch):
    """Few bytes a shard and a stretch, and cores that are cut into windows: the same result."""
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abc\u00e9") for _ in range(n))
    passage, rows = word(260), []
    for i in range(40):
        rows.append((i, word(rng.randint(0, 90)) + passage[: rng.randint(90, 260)] + word(rng.randint(0, 90)), None, None, None, i, 0, None, None))
    rows += [(50, "ab" * 400, None, None, None, 0, 0, None, None), (51, "x" * 700 + "ab" * 60, None, None, None, 0, 0, None, None), (52, "c" + "ab" * 300, None, None, None, 0, 0, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = _plain_repeats(rows, 100)
    assert _found_repeats(bwt_merge.repeats_removed(df)) == want
    assert _found_repeats(bwt_merge.repeats_removed(df, length=120)) == _plain_repeats(rows, 120)
    own = bwt_merge._suspects, bwt_merge._groups
    for hot in (np.zeros(1 << 13, np.uint8), np.full(1 << 13, 255, np.uint8)):
        monkeypatch.setattr(bwt_merge, "STRETCH", 300)
        monkeypatch.setattr(bwt_merge, "PACKED", 3000)
        monkeypatch.setattr(bwt_merge, "SHARD", 800)
        monkeypatch.setattr(bwt_merge, "SHARDS", 3)
        table = pa.table({"doc": [r[0] for r in rows], "sig": [0] * len(rows), "text": [r[1] for r in rows]})
        met = [b for b in own[0].__wrapped__(iter(table.to_batches()), 100, np.full(1 << 13, 255, np.uint8), hot, 5)]
        t = pa.Table.from_batches(met).sort_by("part")
        gone = {}
        for b in own[1].__wrapped__(iter(t.to_batches(max_chunksize=7)), 100):
            for r in b.to_pylist():
                gone.setdefault(r["doc"], []).append(r)
        for r in rows:
            raw = r[1].encode()
            start, stop = bwt_merge.spans(gone[r[0]], len(raw), 100) if r[0] in gone else ([], [])
            assert (int(sum(stop) - sum(start)), len(start)) == want[r[0], r[1]][1:3]


def test_merged_transforms_order_as_one_sort(monkeypatch):
    """The interleave of many shards gives the intervals that one shard gives, and each interval is one string."""
    rng = np.random.default_rng(2)
    strings = [bytes(rng.integers(97, 99, rng.integers(96, 130)).astype(np.uint8)) for _ in range(120)]
    strings += [strings[i][3:] + b"zz" for i in range(40)]
    raw = np.frombuffer(b"".join(strings), np.uint8)
    size = np.array([len(s) for s in strings])
    at = np.cumsum(size) - size
    for shard in (1 << 20, 2000):
        monkeypatch.setattr(bwt_merge, "SHARD", shard)
        found = np.concatenate(bwt_merge.intervals(raw, at, size, 96))
        by = {}
        for i, s in enumerate(strings):
            for j in range(len(s) - 95):
                by.setdefault(int(found[i, j]), set()).add(s[j : j + 96])
        assert all(len(x) == 1 for x in by.values()) and len(by) == len({s[j : j + 96] for s in strings for j in range(len(s) - 95)})


def _plain_phrases(rows, longest, least, share, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    good = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = {}
    for p, a in good.items():
        inside = any(len(q) > len(p) and q[0] == p[0] and 100 * b >= share * a and any(q[i : i + len(p) - 1] == p[1:] for i in range(1, len(q) - len(p) + 2)) for q, b in good.items())
        if not inside:
            score, _, left, right = min((10**6 * a * a // (f[p[: k + 1]] * f[p[0], *p[k + 1 :]]), k, f[p[: k + 1]], f[p[0], *p[k + 1 :]]) for k in range(1, len(p) - 1))
            out.setdefault(p[0], []).append((-score, -a, " ".join(p[1:]).encode(), left, right))
    return {(lang, i): (p.decode(), -a, x, y, n[lang], -s) for lang, found in out.items() for i, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1)}


def test_phrases_against_all_counts(spark, monkeypatch, empty):
    rng = random.Random(4)
    vocabulary = ["the", "of", "Of", "a", "new", "york", "city", "\u00e9t\u00e9", "x" * 300, "b\u00a0c", "d'e", "-", "z\x0bz"]
    texts = [(" ".join(rng.choices(vocabulary, weights=range(len(vocabulary), 0, -1), k=rng.randint(0, 80))) + rng.choice([". ", "\n", " "]) + "New York City", rng.choice(["en", "fr", None, "und"])) for _ in range(150)]
    texts += [(None, "en"), ("", "de"), (" \t ,;", "de"), ("new york " * 5000, "en"), texts[0], texts[0]]
    df = spark.createDataFrame([(i, t, lang, None, None, i, 0, None, None) for i, (t, lang) in enumerate(texts)], SCHEMA).repartition(3)
    for words, least, share, top in ((3, 10, 50, 2000), (4, 3, 70, 40), (2, 1, 50, 30)):
        got = {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in setm.collocations(df, words, least, share, top).collect()}
        assert got == _plain_phrases(texts, words, least, share, top) and len(got) > 20
    assert setm.collocations(empty).count() == 0
    # many rows of the relation, parts added up in steps, and a bitmap that lets all groups through
    monkeypatch.setattr(setm, "HELD", 20)
    want = {}
    code, pos = np.array([0, 1, 0, 1, 0, 2, 0, 1], np.int32), np.array([0, 1, 2, 3, 0, 1, 0, 1], np.int32)
    relation = setm._relation([(x, pa.array(["a", "b", "c"]), code, pos) for x in ["en", "fr"] * 40])
    made = pa.Table.from_batches(setm._counted.__wrapped__(iter([relation]), [np.full(1 << 13, 255, np.uint8)], 3)).sort_by([("part", "ascending"), ("lang", "ascending")])
    for b in setm._added.__wrapped__(iter(made.to_batches(max_chunksize=5)), 1):
        for r in b.to_pylist():
            want[r["lang"], r["phrase"]] = want.get((r["lang"], r["phrase"]), 0) + r["f"]
    assert want == {(x, p): n for x in ("en", "fr") for p, n in (("a b", 120), ("b a", 40), ("a c", 40))}


def _plain_clusters(rows, k, rounds, dim):
    kept = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"1:{'null' if i is None else i}".encode()).hexdigest()
    centres = [list(v) for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    far = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c, strict=True))
    near = lambda v: min((far(v, c), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(centres)):
            of = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            if of:
                centres[j] = [sum(x) // len(of) for x in zip(*of, strict=True)]
    return [(i, near(v)[1], near(v)[0], hashlib.sha256(",".join(map(str, centres[near(v)[1]])).encode()).hexdigest()) for i, v in kept]


def test_clusters_against_all_distances(spark, monkeypatch):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] * (1 + i % 3) + 0.1 * rng.normal(size=8)).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(60)] + [(None, rows[1][1]), (5, rows[1][1]), (5, rows[1][1]), (900, None), (901, [1.0] * 7), (902, [None] + [1.0] * 7), (903, [float("nan")] * 8), (904, [float("inf")] * 8), (905, [-0.001] * 8)]
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], "vec_id long, embedding array<double>, cluster int, id int").repartition(3)
    monkeypatch.setattr(curve_clusters, "BLOCK", 16)
    order = lambda x: sorted(x, key=str)
    for k, rounds in ((16, 3), (5, 1), (1, 2)):
        got = curve_clusters.clusters(df, k=k, rounds=rounds, dim=8).collect()
        want = _plain_clusters(rows, k, rounds, 8)
        assert order((r.vec_id, r.cluster, r.distance, r.centroid_sha256) for r in got) == order(want)
        assert {r.inertia for r in got} == {sum(w[2] for w in want)}
        assert all(r.cluster_inertia == sum(w[2] for w in want if w[1] == r.cluster) for r in got)
    few = df.where("vec_id < 3")
    assert curve_clusters.clusters(few, dim=8).count() == 3
    assert curve_clusters.clusters(df.limit(0), dim=8).count() == 0
    large = spark.createDataFrame([(i, [float(2**20 + i), -1.0]) for i in range(20)], "vec_id long, embedding array<double>")
    assert order((r.vec_id, r.cluster, r.distance, r.centroid_sha256) for r in curve_clusters.clusters(large, k=4, dim=2).collect()) == order(_plain_clusters([(i, [float(2**20 + i), -1.0]) for i in range(20)], 4, 3, 2))
    with pytest.raises(ArithmeticError):
        curve_clusters.clusters(spark.createDataFrame([(1, [1e9])], "vec_id long, embedding array<double>"), dim=1)


def test_zone_maps_rule_centroids_out():
    """The curve visits every cell once, one step at a time; boxes of its blocks leave few centroids on clustered vectors, never the nearest out."""
    cells = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    walk = cells[np.argsort(curve_clusters.hilbert(cells, 3))]
    assert sorted(curve_clusters.hilbert(cells, 3)) == list(range(512)) and (abs(np.diff(walk, axis=0)).sum(1) == 1).all()
    rng = np.random.default_rng(7)
    centres = rng.integers(-64, 64, (16, 64))
    x = (centres[rng.integers(0, 16, 8000)] + rng.normal(0, 8, (8000, 64))).round()
    x = x[np.argsort(curve_clusters.Curve(x[:4096]).place(x))]
    asked = 0
    for i in range(0, 8000, 64):
        own = x[i : i + 64]
        some = curve_clusters.candidates(own.min(0), own.max(0), centres.astype(float))
        assert set(curve_clusters.nearest(own, centres.astype(float))[0]) <= set(some.tolist())
        asked += len(some)
    assert asked < 0.3 * 125 * 16


def test_words_of_like_polynomial_hashes(spark):
    """Thue-Morse words and their complements, on which polynomials modulo 2**64 agree whatever their base."""
    morse = "".join("ab"[i.bit_count() & 1] for i in range(8192))
    pairs = [(morse[:n], morse[:n].translate(str.maketrans("ab", "ba"))) for n in (1024, 2048, 4096, 8192)]
    flat = [w for p in pairs for w in p]
    h, before = word_hashes(pa.array([" ".join(flat), None, "", "A a"]))
    assert len(set(h.tolist())) == len(flat) + 1 and before.tolist() == [0, 8, 8, 8, 10]
    assert string_hashes(pa.array(flat)).tolist() == h[:8].tolist()
    df = spark.createDataFrame([(i, w, None, None, None, i, 0, None, None) for i, w in enumerate(flat)], SCHEMA)
    assert sorted((r.doc_id, r.component_id) for r in jaccard.near_groups(df, k=4, num=85, den=100).collect()) == [(i, i) for i in range(8)]
    scored = {r.doc_id: r for r in lm_score.lm_scores(df).collect()}
    train = [i for i in range(8) if not scored[i].held_out]
    for i in range(8):
        assert scored[i].n_known == 1 + (i in train)


def test_search_of_large_components(spark):
    """Scores beyond 2**53 are exact integers; beyond 64 bits the search raises."""
    rng = np.random.default_rng(5)
    x = rng.integers(-(2**20), 2**20, (60, 64)) * 16 + rng.integers(0, 2, (60, 64))
    df = spark.createDataFrame([(i, (v / 64).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    q = pivot_search.quantised(df)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in pivot_search.top_k(q, q.where("vec_id % 20 = 0"), 5, pivots=4).collect()}
    for i in (0, 20, 40):
        scores = sorted((-sum(a * b for a, b in zip(x[i].tolist(), x[j].tolist(), strict=True)), j) for j in range(60) if j != i)
        assert [got[i, k + 1] for k in range(5)] == [(j, -s) for s, j in scores[:5]]
    with pytest.raises(ArithmeticError):
        large = pivot_search.quantised(spark.createDataFrame([(1, [1e8]), (2, [1e8])], "vec_id long, embedding array<double>"))
        pivot_search.top_k(large, large)

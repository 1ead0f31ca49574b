"""What operators write, join and hold at a time."""

import os
import random
import time
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from weft.llm import bpe, common, jaccard, lm_score, packing
from weft.llm.common import shared_dir, small_batches


def test_pairs_of_contexts_are_in_no_table(spark):
    """The dictionaries that are written hold tokens alone, and states are written once for each token."""
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randint(0, 300)}" for _ in range(200))) for i in range(200)]
    folder = f"{shared_dir(spark).removeprefix('file:')}/weft"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    got = lm_score.lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(2))
    assert got.agg(F.sum("n_tokens")).first()[0] == 200 * 201
    size = lambda name: sum(os.path.getsize(f"{folder}/{d}/{f}") for d in set(os.listdir(folder)) - before if d.startswith(name) for f in os.listdir(f"{folder}/{d}"))
    assert size("dictionaries-") < 3 * 200 * 201
    units = [d for d in set(os.listdir(folder)) - before if d.startswith("units-")]
    assert spark.read.parquet(f"{folder}/{units[0]}").agg(F.sum(F.length("states"))).first()[0] == 200 * 201


def test_sets_meet_once(spark):
    """Sets of groups with one member meet at their first common shingle alone; no meeting that can link is lost."""
    rng = np.random.default_rng(1)
    rows = []
    for c in range(40):
        n = int(rng.integers(60, 90))
        toks = np.sort(rng.choice(30, int(rng.integers(5, 12)), replace=False))  # the order of all shingles
        rows += [(int(t), c, n, i, c if c < 30 else 30 + c % 3) for i, t in enumerate(toks)]
    num, den = 8, 10
    got = [(r.a, r.grp) for r in jaccard.meetings(spark.createDataFrame(rows, "tok long, cid long, n long, place long, grp long"), num, den).collect()]
    meet, times = set(), 0
    for t, a, n, i, g in rows:
        for other in {x[4] for x in rows if x[0] == t and x[4] < g}:
            m = [x for x in rows if x[0] == t and x[4] == other]
            lo, hi, rest = min(x[2] for x in m), max(x[2] for x in m), max(x[2] - x[3] for x in m)
            if hi * den >= n * num and n * den >= lo * num and min(n - i, rest) * (num + den) >= (n + max(lo, -(-n * num // den))) * num:
                meet.add((a, other))
                times += 1
    assert set(got) == meet
    one = [x for x in got if x[1] < 30]
    assert len(one) == len(set(one)) and len(got) < times


def test_tasks_hold_little_text(spark, monkeypatch, tmp_path):
    """Ids are made of a megabyte of text at a time, and within it Spark hands over few rows."""
    seen = []

    class Words:
        def encode(self, texts, end):
            seen.append(sum(len(x) for x in texts.to_pylist()))
            return np.full(len(texts), end, np.uint32), np.arange(len(texts) + 1)

    monkeypatch.setattr(packing, "loaded", lambda path: Words())
    monkeypatch.setattr(packing.TaskContext, "get", classmethod(lambda cls: type("T", (), {"partitionId": lambda self: 0})()))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(40)), "text": ["x" * 100_000] * 40})
    assert sum(b.num_rows for b in packing._ids(iter([batch]), str(tmp_path), "", 1, 2)) == 40
    assert sum(seen) == 4_000_000 and max(seen) <= 1 << 20
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    with small_batches(spark, 500):
        sizes = spark.range(0, 3000, 1, 1).mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in bs), "n long").collect()
        assert max(r.n for r in sizes) <= 500
    assert spark.conf.get(name) == was


def test_component_steps_have_small_plans(spark, monkeypatch):
    """The driver holds each plan and its updates: the steps' were over 100 lines before."""
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(40)]
    links = chain + [(x, y) for x, y in ((rng.randint(100, 160), rng.randint(100, 160)) for _ in range(50))] + [(200, 201), (200, 202)]
    root = {x: x for link in links for x in link}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    lines, real = [], jaccard.cut

    def noted(df, *how):
        lines.append(len(df._jdf.queryExecution().executedPlan().toString().splitlines()))
        return real(df, *how)

    monkeypatch.setattr(jaccard, "cut", noted)
    got = jaccard.components(spark.createDataFrame(links, "a long, b long").repartition(3)).collect()
    assert sorted((r.node, r.root) for r in got) == sorted((x, r) for x, r in root.items() if x != r)
    assert max(lines) <= 60
    lines.clear()
    assert jaccard.components(spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")).count() == 2
    assert len(lines) == 2


def test_cut_frees_what_was_shuffled(spark):
    """Shuffle files stayed on disk until the driver happened to collect its garbage."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {x for x in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in x}
    before = files()
    assert common.cut(spark.range(1000).repartition(7, "id")).count() == 1000
    for _ in range(100):
        # those of count() hold a few bytes
        if not (left := {x for x in files() - before if os.path.exists(x) and os.path.getsize(x) > 1000}):
            break
        time.sleep(0.1)
    assert not left
    assert spark.conf.get(common.FREE_SHUFFLES) == "false"


def test_runs_of_letters_and_signs_skip_the_whole_encoder():
    w = bpe.Words(bpe.default_path())
    texts = ["word!!! it's WE'LL naïve$$$ x99 (été) a'sb ªº1 İx, 日本! Å. é! can't<|endoftext|>'S", "'re99'VE--Ünï, <|x ß!ǅ"]
    runs = " ".join(texts).split()
    whole, w.whole = w.whole, SimpleNamespace(encode=None)
    for run in runs:
        want = whole.encode(run, add_special_tokens=False).ids
        if "<|" in run or any(ord(c) > 0x24F or c == "İ" for c in run):
            w.whole = whole
        assert list(w._encode(run)) == want, run
        w.whole = SimpleNamespace(encode=None)
    w.whole = whole
    ids, at = w.encode(pa.array(texts), 2)
    assert ids.tolist() == [x for t in texts for x in [*whole.encode(t, add_special_tokens=False).ids, 2]] and at.tolist()[-1] == len(ids)

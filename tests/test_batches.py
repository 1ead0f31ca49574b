import random

import pytest
from pyspark.sql import functions as F

from weft.operators import batching, greedy


def plain(rows, limits):
    used, batch, out = [0] * len(limits), 0, []
    for x in rows:
        x = [v or 0 for v in x]
        if any(u + v > m for u, v, m in zip(used, x, limits, strict=True)):
            used, batch = [0] * len(limits), batch + 1
        used = [u + v for u, v in zip(used, x, strict=True)]
        out.append(batch)
    return out


@pytest.mark.parametrize("block,kind", [(7, "even"), (3, "zeros"), (50, "even"), (5, "long")])
def test_whole_batches_against_a_scan(spark, monkeypatch, block, kind):
    """Many blocks: batches inside a block, over several, and over rows of size 0."""
    monkeypatch.setattr(greedy, "BLOCK_ROWS", block)
    rng = random.Random(block)
    rows = [(rng.randint(0, 9) if kind != "zeros" or rng.random() < 0.3 else 0, rng.choice([None, 0, 1, 2])) for _ in range(160)]
    limits = (400, 60) if kind == "long" else (20, 12)
    df = spark.createDataFrame([(i, *x, "x") for i, x in enumerate(rows)], "id long, nodes int, edges long, batch_name string").repartition(3)
    got = {r.id: r.batch for r in batching.dynamic_batches(df, {"nodes": limits[0], "edges": limits[1]}, ["id"]).collect()}
    assert [got[i] for i in range(len(rows))] == plain(rows, limits)


def test_whole_batches_are_not_broadcast(spark):
    """Sizes that a file packs well look like a small table: the numbers of all rows must not go through the driver."""
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("nodes"))
    out = batching.dynamic_batches(df, {"nodes": 10}, ["id"])
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString() and out.count() == 1000


def test_batches_raise_and_stay_empty(spark):
    df = spark.createDataFrame([(1, 5), (2, 50)], "id long, nodes long")
    with pytest.raises(ValueError, match="nodes"):
        batching.dynamic_batches(df, {"nodes": 10}, ["id"])
    assert batching.dynamic_batches(df.where("id > 5"), {"nodes": 10}, ["id"]).count() == 0

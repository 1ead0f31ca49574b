import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.graph import PropertyGraph
from weft.operators import averages, checks, hyper
from weft.schema import Feature, GraphSchema, SchemaError, SetSchema
from weft.tools import HyperAdjacency


@pytest.fixture
def club(spark):
    people = spark.createDataFrame([(0, i, float(i)) for i in range(4)], "component_id long, node_id long, age double")
    rooms = spark.createDataFrame([(0, 10, 1.0), (0, 11, 2.0)], "component_id long, node_id long, size double")
    meetings = spark.createDataFrame([(0, 1, 0, 1, 10, 2.0), (0, 2, 0, 2, 10, 3.0), (0, 3, 1, 0, 11, 5.0), (0, 4, 9, 0, None, 7.0)], "component_id long, edge_id long, node_0 long, node_1 long, node_2 long, hours double")
    return PropertyGraph.of({"people": people, "rooms": rooms}, {}), HyperAdjacency(meetings, {0: "people", 1: "people", 2: "rooms"})


def test_hyperedges(club):
    """Each tag by itself; ends that are no nodes or null; nodes of no hyperedge."""
    g, h = club
    got = lambda df, *c: sorted(tuple(r[x] for x in c) for r in df.collect())
    assert got(hyper.pool(g, h, 0, feature="hours"), "node_id", "value") == [(0, 5.0), (1, 5.0), (2, 0.0), (3, 0.0)]
    assert got(hyper.pool(g, h, 1, feature="hours", reduce="max_no_inf"), "node_id", "value") == [(0, 7.0), (1, 2.0), (2, 3.0), (3, 0.0)]
    assert got(hyper.pool(g, h, 2, feature="hours", reduce="mean"), "node_id", "value") == [(10, 2.5), (11, 5.0)]
    assert {r.edge_id: r.value for r in hyper.broadcast(g, h, 2, feature="size").collect()} == {1: 1.0, 2: 1.0, 3: 2.0, 4: None}
    assert got(hyper.pool_nodes(g, h, 1, 2, feature="age"), "node_id", "value") == [(10, 3.0), (11, 0.0)]
    assert got(hyper.pool_tags(h, [0, 1, 2], feature="hours"), "tag", "node_id", "value") == [(0, 0, 5.0), (0, 1, 5.0), (0, 9, 7.0), (1, 0, 12.0), (1, 1, 2.0), (1, 2, 3.0), (2, 10, 5.0), (2, 11, 5.0)]
    share = {r.edge_id: r.softmax for r in hyper.softmax(h, 0, feature="hours").collect()}
    assert share[1] == pytest.approx(1 / (1 + math.e)) and share[2] == pytest.approx(math.e / (1 + math.e)) and share[3] == share[4] == 1
    with pytest.raises(ValueError):
        hyper.pool(g, h, 7, feature="hours")


def plain(flags, every, decay):
    v, kept, out = 0.0, 0, []
    for t, x in enumerate(flags, 1):
        v += max(1 - decay, 1 / t) * (x - v)
        kept += not x
        if t % every == 0:
            out.append((t, max(kept - 1, 0), v))
    return out


def close(got, want):
    return [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want], rtol=1e-9)


@pytest.mark.parametrize("block", [7, 1000])
def test_average_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(averages, "BLOCK_ROWS", block)
    flags = [int(i * i % 7 < 3) for i in range(230)]
    df = spark.createDataFrame([(i, None if i == 5 else x) for i, x in enumerate(flags)], "id long, x int").repartition(3)
    flags[5] = 1
    kept, reports = averages.filter_with_average(df, F.col("x") == 0, ["id"], 10, 0.9)
    assert kept.count() == flags.count(0) and close(sorted(map(tuple, reports.collect())), plain(flags, 10, 0.9))
    none, reports = averages.filter_with_average(df.limit(0), F.col("x") == 0, ["id"], 10, 0.9)
    assert none.count() == reports.count() == 0


def test_average_of_a_stream_goes_on_after_a_restart(spark, tmp_path):
    flags = [int(i % 5 == 0) for i in range(60)]
    for part in range(3):
        df = spark.createDataFrame([("a", i, flags[i]) for i in range(20 * part, 20 * part + 20)], "k string, n long, x int").coalesce(1)
        df.write.mode("append").parquet(f"{tmp_path}/in")
        stream = averages.stream_averages(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), F.col("x") == 0, "k", "n", 7, 0.9)
        q = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
        q.awaitTermination(120)
        q.stop()
    got = sorted((r.seen, r.step, r.average) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert close(got, plain(flags, 7, 0.9))


def test_watched_values(spark):
    """Counts of nulls, widths, missing ends and components come with the action; the tables stay as they are."""
    v = spark.createDataFrame([(0, 1, [1.0, 2.0]), (0, 2, [1.0]), (1, 3, None)], "component_id long, node_id long, x array<double>")
    e = spark.createDataFrame([(0, 1, 1, 2), (0, 2, 1, 3), (0, 3, 1, 9), (0, 4, None, 2)], "component_id long, edge_id long, source_id long, target_id long")
    g = PropertyGraph.of({"v": v}, {"e": (e, "v", "v")})
    schema = GraphSchema({"v": SetSchema({"x": Feature("DT_DOUBLE", (2,))})}, {})
    seen, watch = checks.watched(g, schema)
    assert sorted(map(tuple, seen.edges["e"].table.collect()), key=str) == sorted(map(tuple, e.collect()), key=str)
    found = {k[2]: n for k, n in watch.counts(("edges", "e")).items() if n}
    assert found == {"source_id is null": 1, "target is no node": 1, "target is in another component": 1}
    assert seen.nodes["v"].count() == 3
    found = {k[2]: n for k, n in watch.counts(("nodes", "v")).items() if n}
    assert found == {"x is null": 1, "x isn't 2 wide": 1}
    with pytest.raises(SchemaError, match="target is no node"):
        watch.check()
    fine, watch = checks.watched(PropertyGraph.of({"v": v.where("node_id = 1")}, {}), schema)
    fine.nodes["v"].collect()
    watch.check()

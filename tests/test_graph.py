"""Graph operators on small literal graphs with expected values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.graph import PropertyGraph
from weft.operators import batching, layers, message, metrics, readout, structure
from weft.schema import CONTEXT, EDGES, NODES, SOURCE, TARGET, SchemaError, reverse_tag

LOW, HIGH = -3.4028234663852886e38, 3.4028234663852886e38


@pytest.fixture(scope="module")
def efg(spark):
    """Three nodes; e: 0->2, 0->1, 0->2 with 20, 10, 30; f: 0->2 with 40; g: no edges."""
    nodes = spark.createDataFrame([(0,), (1,), (2,)], "node_id long")
    kind = "edge_id long, source_id long, target_id long, x float, v array<double>"
    e = spark.createDataFrame([(0, 0, 2, 20.0, [20.0, 1.0]), (1, 0, 1, 10.0, [10.0, 2.0]), (2, 0, 2, 30.0, [30.0, 3.0])], kind)
    f = spark.createDataFrame([(0, 0, 2, 40.0, [40.0, 4.0])], kind)
    g = spark.createDataFrame([], kind)
    return PropertyGraph.of({"v": nodes}, {n: (x, "v", "v") for n, x in (("e", e), ("f", f), ("g", g))})


@pytest.fixture(scope="module")
def parts(spark):
    """Two components, the second smaller; an empty third."""
    node = lambda rows: spark.createDataFrame(rows, "component_id long, node_id long, x double")
    edge = lambda rows: spark.createDataFrame(rows, "component_id long, edge_id long, source_id long, target_id long, x double")
    nodes = {"a": node([(0, 0, 1.0), (0, 1, 2.0), (1, 2, 4.0)]), "b": node([(0, 0, 3.0), (1, 1, 5.0)]), "c": node([(0, 0, -91.0), (1, 1, -92.0)])}
    edges = {"e": (edge([(0, 0, 0, 0, 10.0), (0, 1, 1, 0, 20.0), (1, 2, 2, 1, 40.0)]), "a", "c"), "f": (edge([(0, 0, 0, 0, 30.0), (1, 1, 1, 1, 50.0)]), "b", "c"), "x": (edge([(0, 0, 0, 0, -99.0)]), "a", "b")}
    return PropertyGraph.of(nodes, edges, spark.createDataFrame([(0, "p"), (1, "q"), (2, "r")], "component_id long, label string"))


def values(df, key="node_id", col="value"):
    return [r[col] for r in df.orderBy(key).collect()]


@pytest.mark.parametrize(
    ("reduce", "one", "three"),
    [
        ("sum", [0, 10, 50], [0, 10, 90]), ("prod", [1, 10, 600], [1, 10, 24000]), ("mean", [0, 10, 25], [0, 10, 30]), ("max", [LOW, 10, 30], [LOW, 10, 40]),
        ("max_no_inf", [0, 10, 30], [0, 10, 40]), ("min", [HIGH, 10, 20], [HIGH, 10, 20]), ("min_no_inf", [0, 10, 20], [0, 10, 20]),
    ],
)
def test_pool(efg, reduce, one, three):
    assert values(message.pool(efg, TARGET, edge_sets="e", reduce=reduce, feature="x")) == one
    assert values(message.pool(efg, TARGET, edge_sets=["e", "f", "g"], reduce=reduce, feature="x")) == three


def test_pool_arrays_and_several_reducers(efg):
    got = values(message.pool(efg, TARGET, edge_sets=["e", "f"], reduce="mean|max_no_inf", feature="v", width=2))
    assert got == [[0, 0, 0, 0], [10, 2, 10, 2], [30, pytest.approx(8 / 3), 40, 4]]
    with pytest.raises(ValueError):
        message.pool(efg, TARGET, edge_sets="e", reduce="sum|max", feature="x")
    with pytest.raises(ValueError):
        message.pool(efg, TARGET, edge_sets="e", reduce="median", feature="x")
    assert message.reduce_names() == ["max", "max_no_inf", "mean", "min", "min_no_inf", "prod", "sum"]


def test_pool_components(parts):
    assert values(message.pool(parts, TARGET, edge_sets="e", reduce="mean", feature="x")) == [15, 40]
    assert values(message.pool(parts, TARGET, edge_sets=["e", "f"], reduce="mean", feature="x")) == [20, 45]
    assert values(message.pool(parts, CONTEXT, node_sets=["a", "b"], reduce="mean", feature="x"), "component_id") == [2.0, 4.5, 0.0]
    assert values(message.pool(parts, CONTEXT, edge_sets="x", reduce="sum", feature="x"), "component_id") == [-99, 0, 0]
    with pytest.raises(ValueError):
        message.pool(parts, TARGET, edge_sets=["e", "x"], reduce="sum", feature="x")


def test_softmax(parts):
    rows = {(r.set, r.item_id): r.softmax for r in message.softmax(parts, TARGET, edge_sets=["e", "f"], feature="x").collect()}
    z = math.exp(-20) + math.exp(-10) + 1
    assert rows["f", 0] == pytest.approx(1 / z) and rows["e", 0] == pytest.approx(math.exp(-20) / z)
    per = message.softmax_nodes_per_component(parts, ["a", "b"], "x").groupBy("component_id").agg(F.sum("softmax").alias("s")).collect()
    assert all(r.s == pytest.approx(1) for r in per) and len(per) == 2


def test_degree_and_neighbors(efg, parts):
    assert values(message.degree(efg, "e", SOURCE), col="degree") == [3, 0, 0]
    assert values(message.pool_neighbors(parts, "e", TARGET, feature="x")) == [3.0, 4.0]
    g = message.with_pooled_neighbors(parts, "e", TARGET, feature="x", reduce="max")
    assert values(g.nodes["c"], col="x") == [2.0, 4.0]
    assert sorted(r.value for r in message.broadcast(parts, CONTEXT, edge_set="e", feature="label").collect()) == ["p", "p", "q"]
    assert reverse_tag(SOURCE) == TARGET
    with pytest.raises(ValueError):
        reverse_tag(CONTEXT)


def test_structure(spark, efg, parts):
    g = structure.mask_edges(efg, "e", F.col("x") > 15, "rest")
    assert g.edges["e"].table.count() == 2 and g.edges["rest"].table.count() == 1
    loops = structure.add_self_loops(efg, "e").edges["e"].table
    assert loops.count() == 6 and loops.where("source_id = target_id and x = 0 and size(v) = 0").count() == 3 and loops.select("edge_id").distinct().count() == 6
    with pytest.raises(ValueError):
        structure.add_self_loops(parts, "e")
    one = structure.remove_parallel_edges(efg, "e").edges["e"].table
    assert sorted((r.source_id, r.target_id, r.edge_id) for r in one.collect()) == [(0, 1, 1), (0, 2, 0)]
    with pytest.raises(Exception, match="no node"):
        structure.first_node(parts, "a", "x").collect()
    small = PropertyGraph(parts.nodes, parts.edges, parts.context().where("component_id < 2"))
    assert values(structure.first_node(small, "a", "x"), "component_id") == [1.0, 4.0]
    with pytest.raises(ValueError):
        structure.first_node(parts, "a", "x", strict=True)
    order = spark.createDataFrame([(0, 0, 1), (0, 1, 0), (1, 2, 0)], "component_id long, node_id long, new_pos long")
    assert values(structure.reorder_nodes(parts, "a", order).nodes["a"], col="pos") == [1, 0, 0]
    with pytest.raises(ValueError):
        structure.reorder_nodes(parts, "a", order.withColumn("new_pos", F.lit(0).cast("long")))
    moved = structure.shuffle_features(parts, NODES, "a", ["x"], 1).nodes["a"]
    assert sorted(r.x for r in moved.collect()) == [1, 2, 4]
    latent = structure.latent_nodes([(efg.edges["e"].table, SOURCE), (efg.edges["e"].table, TARGET)])
    assert [(r.node_id, r.pos) for r in latent.orderBy("pos").collect()] == [(0, 0), (2, 1), (1, 2)]
    assert structure.concat_graphs([parts, parts], "stack").context().count() == 6
    assert structure.concat_graphs([parts, parts], "merge").context().count() == 1


def test_line_graph(spark):
    e = spark.createDataFrame([("ab", "a", "b"), ("bc", "b", "c"), ("ca", "c", "a"), ("ba", "b", "a")], "edge_id string, source_id string, target_id string")
    g = PropertyGraph.homogeneous(e)
    line = lambda **how: {(r.source_id, r.target_id) for r in structure.line_graph(g, **how).edges["edges=>edges"].table.collect()}
    assert line() == {("ab", "bc"), ("ab", "ba"), ("bc", "ca"), ("ca", "ab"), ("ba", "ab")}
    assert line(non_backtracking=True) == {("ab", "bc"), ("bc", "ca"), ("ca", "ab")}
    assert set(structure.line_graph(g, with_original=True).edges) == {"edges=>edges", "original/from/edges", "original/to/edges"}


def test_lookup(spark):
    q = spark.createDataFrame([("a",), ("b",), ("a",), ("z",)], "k string")
    v = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, n int, s string")
    assert sorted((r.k, r.n) for r in structure.lookup(q, v, "k").where("n is not null").collect()) == [("a", 1), ("a", 1), ("b", 2)]
    assert structure.lookup(q, v, "k", defaults=True).where("k = 'z'").first()[1:] == (0, "")
    assert structure.lookup(q.limit(0), v, "k").count() == 0 and structure.lookup(q, v.limit(0), "k").count() == 4
    with pytest.raises(Exception, match="repeats"):
        structure.lookup(q, v.union(v), "k").collect()


def test_index_and_validation(spark, efg):
    bad = efg.with_table(EDGES, "f", efg.edges["f"].table.withColumn("target_id", F.lit(9).cast("long")))
    assert [r.tag for r in bad.dangling("f").collect()] == ["target"]
    with pytest.raises(SchemaError):
        bad.assert_valid()
    with pytest.raises(Exception, match="isn't a node"):
        structure.index_edges(bad, "f").collect()
    efg.assert_valid()
    assert structure.index_edges(efg, "e").count() == 3
    assert efg.features(EDGES, "e") == ["x", "v"]
    with pytest.raises(KeyError):
        efg.remove_features(EDGES, "e", "nothing")
    efg.check(efg.schema())
    with pytest.raises(ValueError):
        efg.homogeneous_names()


def test_readout(spark, parts):
    ro = spark.createDataFrame([(0, 0), (0, 1), (1, 2)], "component_id long, node_id long")
    edge = lambda rows: spark.createDataFrame(rows, "component_id long, edge_id long, source_id long, target_id long")
    g = parts.with_table(NODES, "_readout", ro)
    g = g.with_edges("_readout/seed/1", edge([(0, 0, 1, 0)]), "a", "_readout").with_edges("_readout/seed/2", edge([(0, 0, 0, 1), (1, 0, 1, 2)]), "b", "_readout")
    assert values(readout.structured_readout(g, "seed", "x")) == [2.0, 3.0, 5.0]
    assert readout.check_readout(g, "seed").count() == 0
    assert values(readout.readout_into_feature(g, "seed", "x", "y").nodes["_readout"], col="y") == [2.0, 3.0, 5.0]
    short = g.with_edges("_readout/seed/2", edge([(0, 0, 0, 0)]), "b", "_readout")
    assert {(r.node_id, r.hits) for r in readout.check_readout(short, "seed").collect()} == {(0, 2), (1, 0), (2, 0)}
    shadow = g.with_edges("_readout/edge", edge([(0, 0, 1, 0)]), "_shadow/e", "_readout")
    assert values(readout.structured_readout(shadow, "edge", "x")) == [20.0]
    readout.check_readout_schema(g)
    with pytest.raises(SchemaError):
        readout.structured_readout(g, "other", "x")
    first = readout.add_readout_from_first_node(parts, "seed", "a")
    assert values(readout.structured_readout(first, "seed", "x"), "component_id") == [1.0, 4.0]
    with pytest.raises(ValueError):
        readout.add_readout_from_first_node(first, "seed", "a")
    assert values(readout.context_readout_into_feature(parts, "label").nodes["_readout"], "component_id", "label") == ["p", "q", "r"]


def test_sizes_and_padding(parts):
    c = batching.size_columns(parts)
    got = {r.component_id: (r[c[NODES, "a"]], r[c[EDGES, "e"]]) for r in batching.sizes(parts).collect()}
    assert got == {0: (2, 2), 1: (1, 1), 2: (0, 0)}
    limits = batching.tight_constraints(parts, 2)
    assert limits.components == 3 and limits.nodes["a"] == 5 and limits.edges["e"] == 4
    limits = batching.SizeConstraints(5, {"a": 6, "b": 4, "c": 4}, {"e": 7, "f": 2, "x": 1})
    padded, mask = batching.pad_to_totals(parts, limits)
    assert {n: padded.nodes[n].count() for n in "abc"} == limits.nodes and {n: padded.edges[n].table.count() for n in "efx"} == limits.edges
    assert mask.count() == 5 and mask.where("real").count() == 3
    padded.assert_valid()
    with pytest.raises(ValueError):
        batching.pad_to_totals(parts, batching.SizeConstraints(5, {"a": 1}))
    assert batching.satisfies_total(parts, limits) and not batching.satisfies_total(parts, batching.SizeConstraints(1))
    ok = {r.component_id: r.ok for r in batching.satisfies(parts, batching.SizeConstraints(1, {"a": 1})).collect()}
    assert ok == {0: False, 1: True, 2: True}
    assert batching.FitOrSkip(batching.SizeConstraints(1, {"a": 1}))(parts).nodes["a"].count() == 1
    learnt = batching.learn_constraints(parts, 2, 0.9, 50)
    assert learnt.components == 3 and 2 <= learnt.nodes["a"] <= 5


def test_dynamic_batches(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([3, 3, 3, 5, 1, 1, 6])], "id int, n long")
    got = batching.dynamic_batches(df, {"n": 6}, ["id"])
    assert [r.batch for r in got.orderBy("id").collect()] == [0, 0, 1, 2, 2, 3, 4]
    with pytest.raises(Exception, match="alone"):
        batching.dynamic_batches(df, {"n": 5}, ["id"]).collect()
    kept, seen = batching.filter_observed(df, F.col("n") > 2)
    assert kept.count() == 5 and seen.get == {"seen": 7, "removed": 2}


def test_metrics(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 4))
    df = spark.createDataFrame([(i, r.tolist(), (r * 2).tolist()) for i, r in enumerate(x)], "id int, x array<double>, y array<double>")
    s = np.linalg.svd(x, compute_uv=False)
    got = metrics.svd_metrics(df, "x", 4)
    u = np.linalg.svd(x, full_matrices=False)[0]
    p = s / s.sum() + 1e-12
    assert got["pseudo_condition_number"] == pytest.approx(s[0] / s[-1]) and got["numerical_rank"] == pytest.approx((s**2).sum() / s[0] ** 2)
    assert got["rankme"] == pytest.approx(np.exp(-(p * np.log(p)).sum())) and got["coherence"] == pytest.approx((u**2).sum(1).max() * 50 / 4)
    # fewer rows than columns, a condition of 1e9, and more tasks than meet at once
    few = rng.normal(size=(20, 64))
    s = np.linalg.svd(few, compute_uv=False)
    got = metrics.svd_metrics(spark.createDataFrame([(r.tolist(),) for r in few], "x array<double>").repartition(40), "x", 64)
    assert got["pseudo_condition_number"] == pytest.approx(s[0] / s[-1]) and got["coherence"] == pytest.approx(20 / 20)
    q, _ = np.linalg.qr(rng.normal(size=(200, 5)))
    bad = q * np.array([1e9, 1e5, 10, 2, 1]) @ np.linalg.qr(rng.normal(size=(5, 5)))[0]
    got = metrics.svd_metrics(spark.createDataFrame([(r.tolist(),) for r in bad], "x array<double>").repartition(20), "x", 5)
    assert got["pseudo_condition_number"] == pytest.approx(1e9, rel=1e-4)
    assert metrics.svd_metrics(spark.createDataFrame([([0.0, 0.0],)], "x array<double>"), "x", 2)["pseudo_condition_number"] == 0
    same = spark.createDataFrame([([1.0, 0.0],)] * 9, "x array<double>")
    assert metrics.svd_metrics(same, "x", 2)["pseudo_condition_number"] == np.inf
    assert metrics.svd_metrics(same, "x", 2)["self_clustering"] == pytest.approx(1)
    c = np.corrcoef(x.T)
    assert metrics.barlow_twins_loss(df, "x", "y", 4) == pytest.approx((np.diag(c) - 1).sum() ** 2 + ((c**2).sum() - 4) / 4, rel=1e-6)
    logits = spark.createDataFrame([(1, 2.0), (0, -1.0), (1, -0.5), (0, 0.5), (1, 3.0)], "y int, z double")
    m = metrics.binary_metrics(logits, "y", "z").first()
    assert m.accuracy == pytest.approx(0.6) and m.precision == pytest.approx(2 / 3) and m.auc_roc == pytest.approx(5 / 6) and m.recall_at_precision == pytest.approx(2 / 3)
    many = spark.createDataFrame([(0, [2.0, 1.0]), (1, [3.0, 1.0]), (1, [0.0, 1.0])], "y int, z array<double>")
    head, by = metrics.multiclass_metrics(many, "y", "z")
    assert head.first().accuracy == pytest.approx(2 / 3) and {(r["class"], r.precision, r.recall) for r in by.collect()} == {(0, 0.5, 1.0), (1, 1.0, 0.5)}
    r = metrics.regression_losses(spark.createDataFrame([(1.0, 3.0), (2.0, 2.0)], "y double, p double"), "y", "p").first()
    assert (r.mae, r.mse, r.mape) == (1, 2, 100)


def test_layers(spark):
    nodes = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [4.0])], "node_id long, state array<double>")
    e = spark.createDataFrame([(0, 0, 1, 1.0), (1, 0, 2, 2.0), (2, 1, 2, 3.0)], "edge_id long, source_id long, target_id long, w double")
    g = PropertyGraph.of({"v": nodes}, {"e": (e, "v", "v")})
    one = layers.Dense([[1.0]])
    assert values(layers.gcn_conv(g, "e", one, normalization="none")) == [[0.0], [1.0], [3.0]]
    assert values(layers.gcn_conv(g, "e", one, weight="w", normalization="none", self_loops=True)) == [[1.0], [3.0], [12.0]]
    # in-degrees with loops 1, 2, 3; out-degrees 3, 2, 1
    want = [1 / math.sqrt(3), 1 / math.sqrt(6) + 2 / 2, 1 / 3 + 2 / math.sqrt(6) + 4 / math.sqrt(3)]
    assert [v[0] for v in values(layers.gcn_conv(g, "e", one, self_loops=True))] == pytest.approx(want)
    assert [v[0] for v in values(layers.gcn_conv(g, "e", one, normalization="in"))] == pytest.approx([0, 1, 1.5])
    a = layers.Attention(one, one, one, scaling="none")
    att = values(layers.multi_head_attention(g, "e", a))
    w = np.exp([4.0, 8.0])
    assert att[0] == [0.0] and att[1] == [1.0] and att[2][0] == pytest.approx((w @ [1, 2]) / w.sum())
    gat = values(layers.gat_v2(g, "e", layers.Attention(one, one, vector=[[1.0]])))
    w = np.exp([5.0, 6.0])
    assert gat[2][0] == pytest.approx((w @ [1, 2]) / w.sum())
    sage = layers.sage_next_state(g.nodes["v"], [layers.sage_mean(g, "e", one)], one, normalize=False)
    assert values(sage) == [[1.0], [3.0], [5.5]]
    unit = layers.sage_next_state(g.nodes["v"], [layers.sage_pool(g, "e", one, one)], one, combine="concat")
    assert all(np.linalg.norm(v) == pytest.approx(1) for v in values(unit))
    both = layers.gcn_sage_update(g, ["e"], one, one, reduce="sum")
    assert values(both) == [[1.0], [3.0], [7.0]]
    res = layers.next_state_residual(g.nodes["v"], [layers.simple_conv(g, "e", one)], layers.Dense([[0.0], [1.0]]))
    assert values(res) == [[1.0], [3.0], [7.0]]
    norm = layers.mt_albis_next_state(g.nodes["v"].withColumn("state", F.array(F.lit(1.0), F.lit(3.0))), [], layers.Dense([[1.0, 0.0], [0.0, 1.0]]))
    assert values(norm)[0] == pytest.approx([-1, 1], rel=1e-2)
    up = layers.conv_updates(g, lambda g, n, tag: layers.simple_conv(g, n, one, tag), lambda own, x: layers.next_state_concat(own, x, layers.Dense([[1.0], [1.0]])))
    assert values(up(g).nodes["v"], col="state") == [[1.0], [3.0], [7.0]]
    assert sorted(v[0] for v in values(layers.edge_update(g, "e", layers.Dense([[1.0], [10.0]]), edge=None), "edge_id")) == [21.0, 41.0, 42.0]


def test_streaming(spark, tmp_path):
    from weft.streaming.degrees import windowed_degree

    rows = [(1, 0, "2024-01-01 01:00:00"), (2, 0, "2024-01-01 02:00:00"), (3, 1, "2024-01-01 03:00:00"), (4, 0, "2024-01-03 01:00:00")]
    df = spark.createDataFrame(rows, "edge_id long, source_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(f"{tmp_path}/in")
    q = windowed_degree(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("deg").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("deg").collect())) == sorted(map(tuple, windowed_degree(df).collect()))


def test_types(spark):
    from weft.schema import Feature

    assert Feature("DT_FLOAT", (2, -1)).spark_type() == T.ArrayType(T.ArrayType(T.FloatType()))
    assert Feature.of(T.ArrayType(T.LongType())) == Feature("DT_INT64", (-1,))


def test_schema_text_escapes():
    from weft.schema import parse_text

    assert parse_text(r'a: "\303\274 \x41\n\"q\" \\"')["a"] == ['ü A\n"q" \\']


def test_self_clustering_of_zeros():
    import numpy as np

    from weft.operators.metrics import self_clustering

    assert self_clustering(np.zeros((3, 3)), 5) == 1.0


def test_ordered_rank_over_partitions(spark):
    from weft.operators.structure import dense_index, ordered_rank

    df = spark.range(3000).selectExpr("id % 3 AS component_id", "id * 7919 % 3000 AS node_id").repartition(5)
    assert [r.r for r in ordered_rank(df, ["node_id"], "r").orderBy("node_id").collect()] == list(range(3000))
    a = {(r.component_id, r.node_id): r["index"] for r in dense_index(df, "node_id").collect()}
    b = {(r.component_id, r.node_id): r["index"] for r in dense_index(df, "node_id", few_components=True).collect()}
    assert a == b
    plan = dense_index(df, "node_id", few_components=True)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("BroadcastExchange")[0]


def test_corrupt_edges_and_context(spark):
    """Features of edges and of the context are shuffled too; wildcards and rates by feature."""
    v = spark.createDataFrame([(c, 10 * c + i, i, 100 * c + i, 7 * i) for c in range(20) for i in range(3)], "component_id long, node_id long, x long, y long, z long")
    e = spark.createDataFrame([(c, 10 * c, 10 * c, 10 * c + 1, 1000 + c) for c in range(20)], "component_id long, edge_id long, source_id long, target_id long, w long")
    context = spark.createDataFrame([(c, 50 + c) for c in range(20)], "component_id long, label long")
    g = PropertyGraph.of({"v": v}, {"e": (e, "v", "v")}, context)
    spec = metrics.Corruption({("nodes", "*"): {"y": 1.0, "*": 0.0}}, 1.0)
    out = metrics.corrupt(g, spec, 3)
    pairs = lambda df, *c: sorted(tuple(r[x] for x in c) for r in df.collect())
    assert pairs(out.nodes["v"], "node_id", "x", "z") == pairs(v, "node_id", "x", "z")
    for got, was, key, f in ((out.nodes["v"], v, "node_id", "y"), (out.edges["e"].table, e, "edge_id", "w"), (out.context(), context, "component_id", "label")):
        assert pairs(got, f) == pairs(was, f) and sum(a != b for a, b in zip(pairs(got, key, f), pairs(was, key, f), strict=True)) > 10
    still = metrics.corrupt(g, metrics.Corruption({("edges", "e"): 0.0, ("context", ""): 0.0}, 1.0), 3)
    assert pairs(still.edges["e"].table, "edge_id", "w") == pairs(e, "edge_id", "w") and pairs(still.context(), "component_id", "label") == pairs(context, "component_id", "label")


def test_exact_quantiles_over_partitions(spark):
    """Against numpy: keys of one and of many values, repeats, nulls; no task gathers a key's values."""
    rng = np.random.default_rng(3)
    rows = [("many", float(x)) for x in rng.normal(size=2001)] + [("few", float(x)) for x in rng.integers(0, 4, 900)] + [("one", 5.0), ("one", None), ("none", None)]
    df = spark.createDataFrame(rows, "key string, value double").repartition(5)
    at = [0.0, 0.13, 0.5, 0.77, 1.0]
    out = metrics.exact_quantiles(df, at)
    got = {r.key: r.quantiles for r in out.collect()}
    assert got.pop("none") is None and sorted(got) == ["few", "many", "one"]
    for k, q in got.items():
        assert np.allclose(q, np.quantile([v for key, v in rows if key == k and v is not None], at), rtol=1e-12, atol=1e-12)
    g = PropertyGraph.of({"v": spark.range(9).select(F.col("id").alias("node_id"), F.col("id").alias("x"))}, {})
    assert "percentile" not in metrics.quantile_stats(g, 3, exact=True)._jdf.queryExecution().executedPlan().toString()

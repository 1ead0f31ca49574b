"""Sampling plans: builder, hops, and whole samples."""

import collections

import pytest
from pyspark.sql import functions as F

from weft.functions import ragged
from weft.graph import PropertyGraph
from weft.plans import sample as S
from weft.plans.spec import TOP_K, WEIGHTED, Join, SamplingOp, SamplingSpec, SeedOp, SpecBuilder, spec_tree, topological_order
from weft.schema import GraphSchema, SetSchema


@pytest.fixture(scope="module")
def fruit(spark):
    """Nine nodes, five edges; two nodes have no edges."""
    names = "amanatsu daidai lumia kiyomi komikan mandora tangelo hassaku reikou".split()
    edges = [("amanatsu", "daidai", 0.1), ("amanatsu", "lumia", 0.2), ("kiyomi", "komikan", 0.3), ("mandora", "komikan", 0.4), ("mandora", "tangelo", 0.5)]
    nodes = spark.createDataFrame([(n, n.upper()) for n in names], "node_id string, name string")
    e = spark.createDataFrame([(i, *x) for i, x in enumerate(edges)], "edge_id long, source_id string, target_id string, weight double")
    return PropertyGraph.of({"fruits": nodes}, {"tastelike": (e, "fruits", "fruits")})


def seeds(spark, rows):
    return spark.createDataFrame(rows, "sample_id string, node_id string")


def test_builder_names():
    sets = {"a": SetSchema(), "b": SetSchema()}
    schema = GraphSchema(sets, {"ab": SetSchema(source="a", target="b"), "bb": SetSchema(source="b", target="b"), "_aux": SetSchema(source="a", target="b")})
    b = SpecBuilder(schema)
    s = b.seed("a")
    x, y = s.sample("ab", 3), s.sample("ab", 4)
    x.merge_then_sample([y], "bb", 5)
    spec = b.build()
    assert [op.op_name for op in spec.ops] == ["a->b", "a->b.2", "(ab|ab)->b"] and spec.seed.op_name == "SEED->a"
    assert spec.ops[2].input_ops == ("a->b", "a->b.2") and [op.size for op in spec.ops] == [3, 4, 5]
    with pytest.raises(ValueError):
        s.sample("bb", 1)
    with pytest.raises(ValueError):
        Join([s, x])
    with pytest.raises(ValueError):
        SpecBuilder(schema).seed()
    tree = spec_tree(schema, "a", [2, 3])
    assert [(o.edge_set, o.size) for o in tree.ops] == [("ab", 2), ("bb", 3)]
    with pytest.raises(ValueError):
        topological_order({"a": ["b"], "b": ["a"]})
    with pytest.raises(ValueError):
        SamplingSpec(SeedOp("s", "a"), (SamplingOp("x", ("y",), "ab", 1),)).check_order()


def test_top_k_sample(spark, fruit):
    spec = SpecBuilder(fruit.schema()).seed().sample("tastelike", 2, TOP_K).build()
    g = S.sample(fruit, spec, seeds(spark, [("s1", "amanatsu"), ("s2", "hassaku"), ("s3", None), ("s4", "unknown")]))
    nodes = {(r.component_id, r.node_id): (r.pos, r.name) for r in g.nodes["fruits"].collect()}
    assert nodes == {("s1", "amanatsu"): (0, "AMANATSU"), ("s1", "daidai"): (1, "DAIDAI"), ("s1", "lumia"): (2, "LUMIA"), ("s2", "hassaku"): (0, "HASSAKU"), ("s4", "unknown"): (0, "")}
    assert {(r.source_id, r.target_id, r.weight) for r in g.edges["tastelike"].table.collect()} == {("amanatsu", "daidai", 0.1), ("amanatsu", "lumia", 0.2)}
    assert {r[0] for r in g.context().collect()} == {"s1", "s2", "s3", "s4"}


def test_uniform_draws(spark):
    """Two of three edges, over many samples: distinct in each, all about as often, the same again."""
    e = spark.createDataFrame([(i, "a", t) for i, t in enumerate("bcd")], "edge_id long, source_id string, target_id string")
    g = PropertyGraph.homogeneous(e)
    spec = SpecBuilder(g.schema()).seed().sample("edges", 2).build()
    start = spark.range(3000).select(F.col("id").cast("string").alias("sample_id"), F.lit("a").alias("node_id"))
    got = S.sample_edges(g, spec, start)["edges"].select("sample_id", "target_id").collect()
    assert len(got) == 6000 and len(set(got)) == 6000
    n = collections.Counter(r.target_id for r in got)
    assert all(1850 < n[t] < 2150 for t in "bcd")
    assert set(got) == set(S.sample_edges(g, spec, start.repartition(7))["edges"].select("sample_id", "target_id").collect())
    few = S.sample_edges(g, spec, start.limit(5), seed=9, dedup_frontier=False)["edges"]
    assert few.count() == 10


def test_weighted_draws(spark):
    e = spark.createDataFrame([(0, "a", "b", 9.0), (1, "a", "c", 1.0), (2, "a", "d", 0.0)], "edge_id long, source_id string, target_id string, weight double")
    g = PropertyGraph.homogeneous(e)
    spec = SpecBuilder(g.schema()).seed().sample("edges", 1, WEIGHTED).build()
    start = spark.range(2000).select(F.col("id").cast("string").alias("sample_id"), F.lit("a").alias("node_id"))
    n = collections.Counter(r.target_id for r in S.sample_edges(g, spec, start)["edges"].collect())
    assert n["d"] == 0 and 1700 < n["b"] < 1900


def test_links(spark, fruit):
    links = spark.createDataFrame([("x", "amanatsu", "mandora", 1), ("y", "kiyomi", "kiyomi", 0)], "sample_id string, source string, target string, label int")
    spec = SpecBuilder(fruit.schema()).seed().sample("tastelike", 5).build()
    for target in (None, spec):
        g = S.sample_links(fruit, spec, links, target_spec=target)
        assert {(r.component_id, r.label) for r in g.nodes["_readout"].collect()} == {("x", 1), ("y", 0)}
        assert g.nodes["fruits"].where("component_id = 'x'").count() == 6 and g.nodes["fruits"].where("component_id = 'y'").count() == 2
        g.assert_valid()


def test_ragged(spark):
    rows = spark.createDataFrame([(0, "a", 0, 1.0), (0, "b", 1, 3.0), (0, "a", 2, 3.0), (2, "c", 0, 5.0)], "row_id int, value string, pos long, weight double")
    assert [(r.row_id, r.pos) for r in ragged.top_k(rows, 1).orderBy("row_id").collect()] == [(0, 1), (2, 0)]
    v = ragged.unique(rows)
    assert sorted(map(tuple, v.collect())) == [(0, "a", 0), (0, "b", 1), (2, "c", 0)]
    assert [r["index"] for r in ragged.lookup(rows, v, True).orderBy("row_id", "pos").collect()] == [0, 1, 0, 2]
    with pytest.raises(Exception, match="vocabulary"):
        ragged.lookup(rows, v.where("value <> 'c'")).collect()
    assert ragged.choice(rows, 2, key="pos").count() == 3
    assert spark.range(1).select(ragged.row_ids(F.array(*map(F.lit, [2, 1, 0, 2])))).first()[0] == [0, 0, 1, 3, 3]
    assert sorted(r.pos for r in ragged.shuffle_within(rows).where("row_id = 0").collect()) == [0, 1, 2]


def test_hubs_are_cut_before_the_join(spark):
    """TOP_K keeps a source's edges before the frontier is joined, whatever the number of samples that hold it."""
    from weft.plans.sample import sample_hop
    from weft.plans.spec import SamplingOp

    edges = spark.range(5000).selectExpr("0L AS component_id", "id AS edge_id", "IF(id < 4000, 1L, id) AS source_id", "id AS target_id", "CAST(id % 1000 AS DOUBLE) AS weight")
    frontier = spark.range(50).selectExpr("id AS sample_id", "1L AS node_id")
    got = sample_hop(frontier, edges, SamplingOp("op", ("seed",), "e", 3, "TOP_K"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("row_number")
    assert sorted({r.edge_id for r in got.collect()}) == [999, 1999, 2999] and got.count() == 150


def test_no_strategy_sees_the_future(spark):
    from pyspark.sql import functions as F

    from weft.plans.sample import sample_hop
    from weft.plans.spec import SamplingOp

    edges = spark.createDataFrame([(0, 1, 7, 1, 5, 1.0), (0, 2, 7, 2, 99, 1.0)], "component_id long, edge_id long, source_id long, target_id long, ts long, weight double")
    frontier = spark.createDataFrame([(0, 7, 50)], "sample_id long, node_id long, as_of long")
    for strategy in ("RANDOM_UNIFORM", "RANDOM_WEIGHTED", "TOP_K", "LATEST_K"):
        assert [r.edge_id for r in sample_hop(frontier, edges, SamplingOp("op", ("seed",), "e", 3, strategy)).collect()] == [1], strategy
    assert edges.where(F.col("ts") > 50).count() == 1

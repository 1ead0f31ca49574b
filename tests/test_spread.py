"""Large shuffles are dealt by numbers of rows, not by bytes: the same results, and no task with more than its share."""

import pytest
from pyspark.sql import functions as F

from weft.graph import PropertyGraph
from weft.operators import hyper, layers, structure
from weft.tools import HyperAdjacency

N = 400


@pytest.fixture(autouse=True)
def no_broadcasts(spark):
    """As in joins of large tables."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def most_in_a_task(df):
    # the hash keeps every column, so that no join is planned away
    return max(r.n for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*df.columns))).collect())


@pytest.mark.parametrize("components", [1, 3])
def test_messages_are_dealt_by_rows(spark, monkeypatch, components):
    nodes = spark.range(N).selectExpr("id AS node_id", "array(cast(id AS double)) AS state", "0L AS component_id" if components == 1 else f"id % {components} AS component_id")
    edges = spark.range(2 * N).selectExpr("id AS edge_id", f"id % {N} AS source_id", f"(id * 7 + 3 * (id div {N})) % {N} AS target_id")
    edges = edges.selectExpr("*", "0L AS component_id" if components == 1 else f"source_id % {components} AS component_id")
    if components > 1:  # a column that may be null, as files have, is no constant
        nodes, edges = (df.withColumn("component_id", F.expr("if(component_id < 99, component_id, null)")) for df in (nodes, edges))
    g = PropertyGraph.of({"n": nodes}, {"e": (edges, "n", "n")})

    def new_states():
        return layers.vanilla_mpnn(g, {"e": layers.Dense([[1], [2]])}, {"n": layers.Dense([[1], [1]])}).nodes["n"]

    rows = lambda df: sorted((r.component_id, r.node_id, r.state[0]) for r in df.collect())
    before = rows(new_states())
    monkeypatch.setattr(structure, "TASK_ROWS", 40, raising=False)
    assert rows(new_states()) == before
    assert most_in_a_task(layers.messages(g, "e", "target", receiver_feature="state")) <= 120
    assert most_in_a_task(new_states()) <= 60


def test_groups_are_attached_by_rows(spark, monkeypatch):
    table = spark.range(2 * N).selectExpr("0L AS component_id", "id AS edge_id", f"id % {N} AS node_0", "cast(id % 5 AS double) AS v")
    h = HyperAdjacency(table, {0: "n"})
    rows = lambda df: sorted((r.edge_id, round(r.softmax, 12)) for r in df.collect())
    before = rows(hyper.softmax(h, 0, feature="v"))
    monkeypatch.setattr(structure, "TASK_ROWS", 40, raising=False)
    assert rows(hyper.softmax(h, 0, feature="v")) == before
    assert most_in_a_task(hyper.softmax(h, 0, feature="v")) <= 120

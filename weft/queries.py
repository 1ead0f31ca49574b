"""One query for each graph operator over the TPC-H-like tables, with the SQL that gives the same rows.

Money is pooled as decimals and cast at the end; exponentials are compared as whole numbers of a unit.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft import tpch
from weft.graph import PropertyGraph
from weft.operators import batching, layers, message, metrics, readout, structure
from weft.plans import sample as sampling
from weft.plans.asof import edges_in_force
from weft.plans.positions import position_index
from weft.plans.spec import LATEST, TOP_K, UNIFORM, SpecBuilder, spec_tree
from weft.schema import CONTEXT, EDGES, NODES, SOURCE, TARGET
from weft.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def _double(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


# ---------------------------------------------------------------- pooling

_POOLED = """SELECT c_custkey AS node_id, CAST({agg} AS DOUBLE) AS value FROM customer
    LEFT JOIN (SELECT o_custkey, {inner} AS v FROM orders GROUP BY 1) ON c_custkey = o_custkey"""


def _pool_orders(spark: SparkSession, sf_dir: str, reduce: str) -> DataFrame:
    g = tpch.catalog(spark, sf_dir)
    return _double(message.pool(g, SOURCE, edge_sets="placed", reduce=reduce, feature="weight").select("node_id", "value"), "value")


@query(_POOLED.format(agg="coalesce(v, 0)", inner="sum(CAST(o_totalprice AS DECIMAL(18,2)))"))
def pool_sum(spark, sf_dir):
    return _pool_orders(spark, sf_dir, "sum")


@query(_POOLED.format(agg="coalesce(v, 0)", inner="CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*)"))
def pool_mean(spark, sf_dir):
    return _pool_orders(spark, sf_dir, "mean")


@query(_POOLED.format(agg="coalesce(v, -9999999999999999)", inner="max(CAST(o_totalprice AS DECIMAL(18,2)))"))
def pool_max(spark, sf_dir):
    return _pool_orders(spark, sf_dir, "max")


@query(_POOLED.format(agg="coalesce(v, 9999999999999999)", inner="min(CAST(o_totalprice AS DECIMAL(18,2)))"))
def pool_min(spark, sf_dir):
    return _pool_orders(spark, sf_dir, "min")


@query(_POOLED.format(agg="coalesce(v, 0)", inner="max(CAST(o_totalprice AS DECIMAL(18,2)))"))
def pool_max_no_inf(spark, sf_dir):
    return _pool_orders(spark, sf_dir, "max_no_inf")


@query(_POOLED.format(agg="coalesce(v, 0)", inner="min(CAST(o_totalprice AS DECIMAL(18,2)))"))
def pool_min_no_inf(spark, sf_dir):
    return _pool_orders(spark, sf_dir, "min_no_inf")


@query("""SELECT o_orderkey AS node_id, CAST(coalesce(v, 1) AS DOUBLE) AS value FROM orders
    LEFT JOIN (SELECT l_orderkey, product(CASE WHEN l_quantity > 25 THEN 2 ELSE 1 END) AS v FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""")
def pool_prod(spark, sf_dir):
    """Orders without lineitems get 1; factors are powers of two, so products are exact."""
    g = tpch.catalog(spark, sf_dir)
    e = g.edges["contains"].table.withColumn("factor", F.when(F.col("quantity") > 25, 2.0).otherwise(1.0))
    return message.pool(g.with_table(EDGES, "contains", e), SOURCE, edge_sets="contains", reduce="prod", feature="factor").select("node_id", "value")


@query("""SELECT o_orderkey AS node_id, CAST(coalesce(v, -9223372036854775808) AS BIGINT) AS value FROM orders
    LEFT JOIN (SELECT l_orderkey, max(CAST(l_quantity AS BIGINT)) AS v FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""")
def pool_max_empty_receiver(spark, sf_dir):
    return message.pool(tpch.catalog(spark, sf_dir), SOURCE, edge_sets="contains", reduce="max", feature="quantity").select("node_id", "value")


_TWO_SETS = """WITH e AS (SELECT c_nationkey AS k, CAST(c_acctbal AS DECIMAL(18,2)) AS v FROM customer UNION ALL SELECT s_nationkey, CAST(s_acctbal AS DECIMAL(18,2)) FROM supplier)
    SELECT CAST(n_nationkey AS BIGINT) AS node_id, CAST(coalesce({agg}, {empty}) AS DOUBLE) AS value FROM nation LEFT JOIN e ON n_nationkey = k GROUP BY n_nationkey"""


def _pool_two(spark: SparkSession, sf_dir: str, reduce: str) -> DataFrame:
    g = tpch.catalog(spark, sf_dir)
    return _double(message.pool(g, TARGET, edge_sets=["customer_in", "supplier_in"], reduce=reduce, feature="weight").select("node_id", "value"), "value")


@query(_TWO_SETS.format(agg="CAST(sum(v) AS DOUBLE) / count(v)", empty="0"))
def pool_multi_mean(spark, sf_dir):
    return _pool_two(spark, sf_dir, "mean")


@query(_TWO_SETS.format(agg="sum(v)", empty="0"))
def pool_multi_sum(spark, sf_dir):
    return _pool_two(spark, sf_dir, "sum")


@query(_TWO_SETS.format(agg="max(v)", empty="-9999999999999999"))
def pool_multi_max(spark, sf_dir):
    return _pool_two(spark, sf_dir, "max")


@query(_TWO_SETS.format(agg="min(v)", empty="9999999999999999"))
def pool_multi_min(spark, sf_dir):
    return _pool_two(spark, sf_dir, "min")


@query("""SELECT c_mktsegment AS component_id, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS value FROM customer GROUP BY 1""")
def pool_nodes_to_context(spark, sf_dir):
    return _double(message.pool_nodes_to_context(tpch.sales(spark, sf_dir), "customer", "sum", feature="acctbal"), "value")


@query("""WITH v AS (SELECT c_mktsegment AS k, CAST(c_acctbal AS DECIMAL(18,2)) AS v FROM customer UNION ALL SELECT c_mktsegment, CAST(o_totalprice AS DECIMAL(18,2)) FROM orders JOIN customer ON o_custkey = c_custkey)
    SELECT k AS component_id, CAST(sum(v) AS DOUBLE) / count(*) AS value FROM v GROUP BY k""")
def pool_node_sets_to_context(spark, sf_dir):
    return message.pool_nodes_to_context(tpch.sales(spark, sf_dir), ["customer", "orders"], "mean", feature=["acctbal", "totalprice"])


@query("""SELECT c_mktsegment AS component_id, CAST(max(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def pool_edges_to_context(spark, sf_dir):
    return _double(message.pool_edges_to_context(tpch.sales(spark, sf_dir), "placed", "max", feature="weight"), "value")


@query("""SELECT o_orderkey AS node_id, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)), 0) AS BIGINT) AS s0, CAST(coalesce(sum(l_linenumber), 0) AS BIGINT) AS s1,
    CAST(coalesce(max(CAST(l_quantity AS BIGINT)), 0) AS BIGINT) AS m0, CAST(coalesce(max(l_linenumber), 0) AS BIGINT) AS m1
    FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def pool_several_reducers(spark, sf_dir):
    """sum|max_no_inf of an array feature."""
    g = tpch.catalog(spark, sf_dir)
    li = tpch.read(spark, sf_dir, "lineitem").select(tpch.lineitem_id().alias("edge_id"), F.lit(0).cast("long").alias("component_id"), F.col("l_orderkey").alias("source_id"), F.col("l_partkey").alias("target_id"), F.array(F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long")).alias("x"))
    out = message.pool(g.with_table(EDGES, "contains", li), SOURCE, edge_sets="contains", reduce="sum|max_no_inf", feature="x", width=2)
    return out.select("node_id", *(F.col("value")[i].alias(n) for i, n in enumerate(("s0", "s1", "m0", "m1"))))


@query("""SELECT c_custkey AS node_id, count(o_orderkey) AS degree FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1""")
def degree_out(spark, sf_dir):
    return message.degree(tpch.catalog(spark, sf_dir), "placed", SOURCE).select("node_id", "degree")


@query("""SELECT p_partkey AS node_id, count(l_orderkey) AS degree FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY 1""")
def degree_in(spark, sf_dir):
    return message.degree(tpch.catalog(spark, sf_dir), "contains", TARGET).select("node_id", "degree")


@query("""SELECT o_orderkey AS node_id, CAST(coalesce(sum(CAST(p_retailprice AS DECIMAL(18,2))), 0) AS DOUBLE) AS value
    FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def pool_neighbors(spark, sf_dir):
    return _double(message.pool_neighbors(tpch.catalog(spark, sf_dir), "contains", SOURCE, feature="retailprice").select("node_id", "value"), "value")


@query("""SELECT CAST(n_nationkey AS BIGINT) AS node_id, n_name AS name, count(c_custkey) AS degree, CAST(coalesce(max(CAST(c_acctbal AS DECIMAL(18,2))), 0) AS DOUBLE) AS best
    FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY 1, 2""")
def pool_neighbors_feature(spark, sf_dir):
    """A pooled neighbour feature stored on the nodes."""
    g = message.with_pooled_neighbors(tpch.catalog(spark, sf_dir), "customer_in", TARGET, feature="acctbal", name="best", reduce="max_no_inf")
    d = message.degree(g, "customer_in", TARGET).select("node_id", "degree")
    return g.nodes["nation"].join(d, "node_id").select("node_id", "name", "degree", F.col("best").cast("double").alias("best"))


# ---------------------------------------------------------------- broadcast and lookup


@query("""SELECT o_orderkey AS edge_id, c_custkey AS source_id, CAST(c_acctbal AS DOUBLE) AS value FROM orders JOIN customer ON o_custkey = c_custkey""")
def broadcast_node_to_edges(spark, sf_dir):
    return _double(message.broadcast_node_to_edges(tpch.catalog(spark, sf_dir), "placed", SOURCE, "acctbal").select("edge_id", "source_id", "value"), "value")


@query("""SELECT c_mktsegment AS component_id, c_custkey AS node_id, n AS value FROM customer JOIN (SELECT c_mktsegment AS k, count(*) AS n FROM customer GROUP BY 1) ON k = c_mktsegment""")
def broadcast_context_to_nodes(spark, sf_dir):
    return message.broadcast_context_to_nodes(tpch.sales(spark, sf_dir), "customer", "customers").select("component_id", "node_id", "value")


@query("""SELECT o_orderkey AS edge_id, n AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN (SELECT c_mktsegment AS k, count(*) AS n FROM customer GROUP BY 1) ON k = c_mktsegment""")
def broadcast_context_to_edges(spark, sf_dir):
    return message.broadcast_context_to_edges(tpch.sales(spark, sf_dir), "placed", "customers").select("edge_id", "value")


@query("""SELECT event_id AS key, coalesce(c_mktsegment, '') AS segment FROM events LEFT JOIN customer ON event_id = c_custkey""")
def lookup_join(spark, sf_dir):
    """Features by key; what isn't found gets the type's default."""
    c = tpch.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"))
    return structure.lookup(tpch.read(spark, sf_dir, "events").select(F.col("event_id").alias("key")), c, "key", defaults=True)


@query("""WITH a AS (SELECT c_mktsegment AS sample_id, c_custkey FROM customer), b AS (SELECT DISTINCT c_mktsegment AS sample_id, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F')
    SELECT a.sample_id, o.o_orderkey AS edge_id FROM orders o JOIN a ON o.o_custkey = a.c_custkey JOIN b ON b.sample_id = a.sample_id AND b.o_orderkey = o.o_orderkey""")
def connecting_edges(spark, sf_dir):
    s, g = tpch.sales(spark, sf_dir), tpch.catalog(spark, sf_dir)
    sources = s.nodes["customer"].select(F.col("component_id").alias("sample_id"), "node_id")
    open_ = g.nodes["orders"].where("status = 'F'").select("node_id")
    targets = s.nodes["orders"].join(open_, "node_id", "left_semi").select(F.col("component_id").alias("sample_id"), "node_id")
    return structure.connecting_edges(g, "placed", sources, targets).select("sample_id", "edge_id")


# ---------------------------------------------------------------- softmax


@query("""WITH e AS (SELECT l_orderkey AS k, l_quantity / 10.0 AS v FROM lineitem), m AS (SELECT k, v, max(v) OVER (PARTITION BY k) AS m FROM e)
    SELECT k AS receiver_id, count(*) AS n, CAST(sum(floor(exp(v - m) / s * 10000 + 0.123)) AS BIGINT) AS total
    FROM (SELECT k, v, m, sum(exp(v - m)) OVER (PARTITION BY k) AS s FROM m) GROUP BY 1""")
def softmax_edges_per_node(spark, sf_dir):
    g = tpch.catalog(spark, sf_dir)
    g = g.with_table(EDGES, "contains", g.edges["contains"].table.withColumn("v", F.col("quantity") / 10.0))
    s = message.softmax_edges_per_node(g, "contains", SOURCE, "v")
    return s.groupBy("receiver_id").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("softmax") * 10000 + 0.123)).alias("total"))


@query("""WITH e AS (SELECT c_nationkey AS k, CAST(floor(c_acctbal / 1000) AS DOUBLE) AS v FROM customer UNION ALL SELECT s_nationkey, CAST(floor(s_acctbal / 1000) AS DOUBLE) FROM supplier), m AS (SELECT k, v, max(v) OVER (PARTITION BY k) AS m FROM e)
    SELECT CAST(k AS BIGINT) AS receiver_id, count(*) AS n, CAST(max(floor(exp(v - m) / s * 1000 + 0.123)) AS BIGINT) AS most FROM (SELECT k, v, m, sum(exp(v - m)) OVER (PARTITION BY k) AS s FROM m) GROUP BY 1""")
def softmax_edge_sets_per_node(spark, sf_dir):
    """Jointly over two edge sets."""
    g = tpch.catalog(spark, sf_dir)
    for n in ("customer_in", "supplier_in"):
        g = g.with_table(EDGES, n, g.edges[n].table.withColumn("v", F.floor(F.col("weight").cast("double") / 1000)))
    s = message.softmax(g, TARGET, edge_sets=["customer_in", "supplier_in"], feature="v")
    return s.groupBy("receiver_id").agg(F.count("*").alias("n"), F.max(F.floor(F.col("softmax") * 1000 + 0.123)).alias("most"))


_PER_COMPONENT = """WITH e AS ({rows}), m AS (SELECT k, v, max(v) OVER (PARTITION BY k) AS m FROM e)
    SELECT k AS component_id, count(*) AS n, CAST(max(floor(exp(v - m) / s * 100000 + 0.123)) AS BIGINT) AS most FROM (SELECT k, v, m, sum(exp(v - m)) OVER (PARTITION BY k) AS s FROM m) GROUP BY 1"""


@query(_PER_COMPONENT.format(rows="SELECT c_mktsegment AS k, CAST(floor(c_acctbal / 1000) AS DOUBLE) AS v FROM customer"))
def softmax_nodes_per_component(spark, sf_dir):
    g = tpch.sales(spark, sf_dir)
    g = g.with_table(NODES, "customer", g.nodes["customer"].withColumn("v", F.floor(F.col("acctbal").cast("double") / 1000)))
    s = message.softmax_nodes_per_component(g, "customer", "v")
    return s.groupBy("component_id").agg(F.count("*").alias("n"), F.max(F.floor(F.col("softmax") * 100000 + 0.123)).alias("most"))


@query(_PER_COMPONENT.format(rows="SELECT c_mktsegment AS k, CAST(floor(o_totalprice / 50000) AS DOUBLE) AS v FROM orders JOIN customer ON o_custkey = c_custkey"))
def softmax_edges_per_component(spark, sf_dir):
    g = tpch.sales(spark, sf_dir)
    g = g.with_table(EDGES, "placed", g.edges["placed"].table.withColumn("v", F.floor(F.col("weight").cast("double") / 50000)))
    s = message.softmax_edges_per_component(g, "placed", "v")
    return s.groupBy("component_id").agg(F.count("*").alias("n"), F.max(F.floor(F.col("softmax") * 100000 + 0.123)).alias("most"))


# ---------------------------------------------------------------- structure


@query("""SELECT o_orderkey AS edge_id, o_custkey AS source_id FROM orders WHERE o_totalprice > 100000""")
def mask_edges(spark, sf_dir):
    return structure.mask_edges(tpch.catalog(spark, sf_dir), "placed", F.col("weight") > 100000).edges["placed"].table.select("edge_id", "source_id")


@query("""SELECT o_orderkey AS edge_id, o_custkey AS source_id FROM orders WHERE NOT o_totalprice > 100000""")
def mask_edges_rest(spark, sf_dir):
    return structure.mask_edges(tpch.catalog(spark, sf_dir), "placed", F.col("weight") > 100000, "small").edges["small"].table.select("edge_id", "source_id")


def _nation_pairs(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Nations joined by trade: suppliers' nation to customers' nation, with how often (a graph with parallel ways)."""
    li, s, o, c = (tpch.read(spark, sf_dir, n) for n in ("lineitem", "supplier", "orders", "customer"))
    pairs = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    e = pairs.groupBy(F.col("s_nationkey").cast("long").alias("source_id"), F.col("c_nationkey").cast("long").alias("target_id")).agg(F.count("*").alias("n")).withColumn("edge_id", F.col("source_id") * 100 + F.col("target_id"))
    nodes = tpch.read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("node_id"), F.col("n_name").alias("name"))
    return PropertyGraph.of({"nation": nodes}, {"trade": (e, "nation", "nation")})


_TRADE = """WITH trade AS (SELECT CAST(s_nationkey AS BIGINT) AS s, CAST(c_nationkey AS BIGINT) AS t, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""


@query(_TRADE + """ SELECT s AS source_id, t AS target_id, n FROM trade UNION ALL SELECT CAST(n_nationkey AS BIGINT), CAST(n_nationkey AS BIGINT), 0 FROM nation""")
def add_self_loops(spark, sf_dir):
    return structure.add_self_loops(_nation_pairs(spark, sf_dir), "trade").edges["trade"].table.select("source_id", "target_id", "n")


@query(_TRADE + """ SELECT a.s * 100 + a.t AS source_id, b.s * 100 + b.t AS target_id FROM trade a JOIN trade b ON a.t = b.s""")
def line_graph(spark, sf_dir):
    return structure.line_graph(_nation_pairs(spark, sf_dir)).edges["trade=>trade"].table.select("source_id", "target_id")


@query(_TRADE + """ SELECT a.s * 100 + a.t AS source_id, b.s * 100 + b.t AS target_id, n_name AS name FROM trade a JOIN trade b ON a.t = b.s JOIN nation ON n_nationkey = a.t WHERE a.s <> b.t""")
def line_graph_non_backtracking(spark, sf_dir):
    return structure.line_graph(_nation_pairs(spark, sf_dir), non_backtracking=True, node_features=True).edges["trade=>trade"].table.select("source_id", "target_id", "name")


@query("""SELECT o_orderkey AS source_id, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def line_graph_heterogeneous(spark, sf_dir):
    """placed=>contains: from each order's edge to its lineitems' edges."""
    g = tpch.catalog(spark, sf_dir)
    own = PropertyGraph(g.nodes, {n: g.edges[n] for n in ("placed", "contains")}, g.context_table)
    return structure.line_graph(own).edges["placed=>contains"].table.groupBy("source_id").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey AS source_id, o_orderkey AS target_id FROM orders""")
def line_graph_original(spark, sf_dir):
    g = tpch.catalog(spark, sf_dir)
    own = PropertyGraph(g.nodes, {"placed": g.edges["placed"]}, g.context_table)
    return structure.line_graph(own, with_original=True).edges["original/to/placed"].table.select("source_id", "target_id")


@query("""SELECT component_id, CAST(v AS DOUBLE) AS value FROM (SELECT c_mktsegment AS component_id, c_acctbal AS v, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS r FROM customer) WHERE r = 1""")
def first_node(spark, sf_dir):
    return _double(structure.first_node(tpch.sales(spark, sf_dir), "customer", "acctbal"), "value")


@query("""SELECT c_mktsegment AS component_id, c_custkey AS node_id, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS index FROM customer""")
def dense_index(spark, sf_dir):
    return structure.dense_index(tpch.sales(spark, sf_dir).nodes["customer"], "node_id", few_components=True).select("component_id", "node_id", "index")


@query("""WITH c AS (SELECT c_mktsegment AS k, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS i FROM customer),
    o AS (SELECT c_mktsegment AS k, o_orderkey, o_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_orderkey) - 1 AS j FROM orders JOIN customer ON o_custkey = c_custkey)
    SELECT o.k AS component_id, o_orderkey AS edge_id, i AS source_index, j AS target_index FROM o JOIN c ON o.k = c.k AND o_custkey = c_custkey""")
def index_edges(spark, sf_dir):
    return structure.index_edges(tpch.sales(spark, sf_dir), "placed", few_components=True).select("component_id", "edge_id", "source_index", "target_index")


@query("""SELECT c_mktsegment AS component_id, c_custkey AS node_id, count(*) OVER (PARTITION BY c_mktsegment) - row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS pos FROM customer""")
def reorder_nodes(spark, sf_dir):
    """Nodes in reverse."""
    g = tpch.sales(spark, sf_dir)
    n = g.nodes["customer"].groupBy("component_id").agg(F.count("*").alias("n"))
    order = structure.dense_index(g.nodes["customer"], "node_id").join(n, "component_id").select("component_id", "node_id", (F.col("n") - 1 - F.col("index")).alias("new_pos"))
    return structure.reorder_nodes(g, "customer", order).nodes["customer"].select("component_id", "node_id", "pos")


@query("""SELECT c_mktsegment AS component_id, c_custkey AS node_id, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('7|customer|' || c_mktsegment || '|' || c_custkey)) - 1 AS pos FROM customer""")
def shuffle_nodes(spark, sf_dir):
    return structure.shuffle_nodes(tpch.sales(spark, sf_dir), ["customer"], 7).nodes["customer"].select("component_id", "node_id", "pos")


@query("""WITH f AS (SELECT c_acctbal AS v, row_number() OVER (ORDER BY md5('3|acctbal/from|' || c_mktsegment || '|' || c_custkey)) AS r FROM customer),
    t AS (SELECT c_custkey, row_number() OVER (ORDER BY md5('3|acctbal/to|' || c_mktsegment || '|' || c_custkey)) AS r FROM customer)
    SELECT c_custkey AS node_id, CAST(v AS DOUBLE) AS acctbal FROM t JOIN f USING (r)""")
def shuffle_features(spark, sf_dir):
    return _double(structure.shuffle_features(tpch.sales(spark, sf_dir), NODES, "customer", ["acctbal"], 3).nodes["customer"].select("node_id", "acctbal"), "acctbal")


@query("""SELECT l_orderkey AS source_id, l_partkey AS target_id, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) GROUP BY 1, 2""")
def remove_parallel_edges(spark, sf_dir):
    g = structure.remove_parallel_edges(tpch.catalog(spark, sf_dir), "contains")
    return g.edges["contains"].table.groupBy("source_id", "target_id").agg(F.count("*").alias("n"))


@query("""SELECT user_id AS node_id, min(event_id) AS first_event FROM events GROUP BY 1""")
def unique_nodes(spark, sf_dir):
    e = tpch.read(spark, sf_dir, "events")
    rows = e.select(F.lit(0).cast("long").alias("component_id"), F.col("user_id").alias("node_id"), F.col("event_id").alias("pos"), F.col("event_id").alias("first_event"))
    return structure.unique_nodes(PropertyGraph({"user": rows}, {}), "user").nodes["user"].select("node_id", "first_event")


@query("""WITH a AS (SELECT user_id AS node_id, min(event_id) AS f FROM events GROUP BY 1) SELECT node_id, row_number() OVER (ORDER BY f, node_id) - 1 AS pos FROM a""")
def latent_nodes(spark, sf_dir):
    """Users in order of first appearance."""
    return structure.latent_nodes([(tpch.events_graph(spark, sf_dir).edges["did"].table, SOURCE)], few_components=True).select("node_id", "pos")


@query("""SELECT c_mktsegment AS segment, count(*) AS n FROM (SELECT c_mktsegment FROM customer UNION ALL SELECT c_mktsegment FROM customer) GROUP BY 1""")
def concat_graphs(spark, sf_dir):
    g = tpch.catalog(spark, sf_dir)
    return structure.concat_graphs([g, g], "stack").nodes["customer"].groupBy("segment").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey AS edge_id, 'source' AS tag FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def dangling_edges(spark, sf_dir):
    g = tpch.catalog(spark, sf_dir)
    return g.with_table(NODES, "customer", g.nodes["customer"].where("segment = 'BUILDING'")).dangling("placed").select("edge_id", "tag")


@query("""SELECT p_partkey AS node_id, p_size * 2 AS double_size FROM part""")
def map_features(spark, sf_dir):
    fn = lambda df, name: df.select("component_id", "node_id", (F.col("size") * 2).alias("double_size")) if name == "part" else df
    return tpch.catalog(spark, sf_dir).map_features(nodes=fn).nodes["part"].select("node_id", "double_size")


@query("""SELECT p_partkey AS node_id, p_brand || '!' AS label FROM part""")
def replace_features(spark, sf_dir):
    return tpch.catalog(spark, sf_dir).replace_features(NODES, "part", label=F.concat("brand", F.lit("!"))).nodes["part"].select("node_id", "label")


@query("""SELECT p_partkey AS node_id, p_size AS size FROM part""")
def remove_features(spark, sf_dir):
    return tpch.catalog(spark, sf_dir).remove_features(NODES, "part", "brand", "retailprice").nodes["part"].drop("component_id")


@query("""SELECT p_partkey AS node_id, CAST(p_partkey + p_size AS BIGINT) AS both FROM part""")
def combine_values(spark, sf_dir):
    return tpch.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id"), structure.combine_values("sum", F.col("p_partkey"), F.col("p_size")).alias("both"))


# ---------------------------------------------------------------- sampling


def _schema(spark: SparkSession, sf_dir: str):
    g = tpch.catalog(spark, sf_dir)
    return g, g.schema()


def _seeds(g: PropertyGraph) -> DataFrame:
    return g.nodes["customer"].select(F.col("node_id").alias("sample_id"), "node_id")


@query("""SELECT sample_id, edge_id FROM (SELECT c_custkey AS sample_id, o_orderkey AS edge_id,
    row_number() OVER (PARTITION BY c_custkey ORDER BY md5('1|customer->orders|' || c_custkey || '|' || c_custkey || '|' || o_orderkey)) AS r
    FROM customer JOIN orders ON o_custkey = c_custkey) WHERE r <= 3""")
def sample_uniform(spark, sf_dir):
    g, schema = _schema(spark, sf_dir)
    spec = SpecBuilder(schema).seed("customer", "customer").sample("placed", 3, UNIFORM, "customer->orders").build()
    return sampling.sample_edges(g, spec, _seeds(g), 1)["placed"].select("sample_id", "edge_id")


@query("""WITH e AS (SELECT o_orderkey AS edge_id, o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS p, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
    d AS (SELECT DISTINCT k, n FROM e JOIN customer ON c_custkey = k),
    h AS (SELECT k, n, CAST('0x' || substr(md5('5|draw|' || k || '|' || k || '|' || (n - 3)), 1, 15) AS BIGINT) % (n - 2) AS a,
        CAST('0x' || substr(md5('5|draw|' || k || '|' || k || '|' || (n - 2)), 1, 15) AS BIGINT) % (n - 1) AS b, CAST('0x' || substr(md5('5|draw|' || k || '|' || k || '|' || (n - 1)), 1, 15) AS BIGINT) % n AS c FROM d WHERE n > 3),
    s AS (SELECT k, n, a, CASE WHEN b = a THEN n - 2 ELSE b END AS b, c FROM h), t AS (SELECT k, unnest([a, b, CASE WHEN c IN (a, b) THEN n - 1 ELSE c END]) AS p FROM s)
    SELECT k AS sample_id, edge_id FROM e JOIN t USING (k, p) UNION ALL SELECT k, edge_id FROM e JOIN d USING (k, n) WHERE n <= 3""")
def sample_uniform_by_position(spark, sf_dir):
    """Three orders of each customer by drawn positions."""
    g, schema = _schema(spark, sf_dir)
    spec = SpecBuilder(schema).seed("customer").sample("placed", 3, UNIFORM, "draw").build()
    return sampling.sample_edges(g, spec, _seeds(g), 5, index={"placed": position_index(g.edges["placed"].table)})["placed"].select("sample_id", "edge_id")


@query("""WITH q AS (SELECT event_id AS sample_id, user_id, ts AS as_of FROM events), k AS (SELECT DISTINCT user_id, event_type FROM events),
    v AS (SELECT user_id, event_type, ts, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL)
    SELECT q.sample_id, k.event_type AS target_id, v.event_id AS version, v.value AS weight FROM q JOIN k USING (user_id) ASOF JOIN v ON v.user_id = k.user_id AND v.event_type = k.event_type AND q.as_of >= v.ts
    WHERE v.ts + INTERVAL 2 DAY > q.as_of AND v.event_type <> 'error'""")
def edges_as_of(spark, sf_dir):
    """For every event, its user's edges to types of events as they stood then: the last event of each type, for two days; errors end their edge."""
    e = tpch.read(spark, sf_dir, "events")
    did = e.select(F.col("user_id").alias("source_id"), F.col("event_type").alias("target_id"), F.col("event_id").alias("version"), "ts", F.col("value").alias("weight"), (F.col("ts") + F.expr("INTERVAL 2 DAYS")).alias("until"), (F.col("event_type") == "error").alias("gone"))
    asked = e.select(F.col("event_id").alias("sample_id"), F.col("user_id").alias("source_id"), F.col("ts").alias("as_of"))
    live = edges_in_force(did, asked, key="target_id", tie="version", expires="until", removed="gone")
    return live.select("sample_id", "target_id", "version", "weight")


@query("""WITH e AS (SELECT o_custkey AS k, l_partkey AS p, max(o_orderdate) AS ts FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey, o_orderdate),
    q AS (SELECT o_orderkey AS sample_id, o_custkey AS k, o_orderdate AS as_of FROM orders), d AS (SELECT DISTINCT k, p FROM e),
    s AS (SELECT q.sample_id, d.p, v.ts FROM q JOIN d USING (k) ASOF JOIN e AS v ON v.k = d.k AND v.p = d.p AND q.as_of >= v.ts WHERE v.ts + INTERVAL 365 DAY > q.as_of)
    SELECT sample_id, p AS target_id FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY ts DESC, p) AS r FROM s) WHERE r <= 3""")
def sample_live_edges(spark, sf_dir):
    """For every order, the three parts that its customer ordered last up to then, an order holding for a year."""
    o, li = tpch.read(spark, sf_dir, "orders"), tpch.read(spark, sf_dir, "lineitem")
    bought = o.join(li.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("target_id")), "o_orderkey").select(F.lit(0).cast("long").alias("component_id"), F.col("o_custkey").alias("source_id"), "target_id", F.col("o_orderdate").alias("ts")).distinct()
    bought = bought.withColumns({"edge_id": F.col("target_id"), "until": F.col("ts") + F.expr("INTERVAL 365 DAYS")})
    g = PropertyGraph.of({"customer": o.select(F.col("o_custkey").alias("node_id")).distinct(), "part": li.select(F.col("l_partkey").alias("node_id")).distinct()}, {"bought": (bought, "customer", "part")})
    seeds = o.select(F.col("o_orderkey").alias("sample_id"), F.col("o_custkey").alias("node_id"), F.col("o_orderdate").alias("as_of"))
    spec = SpecBuilder(g.schema()).seed("customer").sample("bought", 3, LATEST).build()
    return sampling.sample_edges(g, spec, seeds, state={"bought": {"expires": "until"}})["bought"].select("sample_id", "target_id")


@query("""SELECT sample_id, edge_id FROM (SELECT c_custkey AS sample_id, o_orderkey AS edge_id, row_number() OVER (PARTITION BY c_custkey ORDER BY CAST(o_totalprice AS DECIMAL(18,2)) DESC, o_orderkey) AS r
    FROM customer JOIN orders ON o_custkey = c_custkey) WHERE r <= 2""")
def sample_top_k(spark, sf_dir):
    g, schema = _schema(spark, sf_dir)
    spec = SpecBuilder(schema).seed("customer").sample("placed", 2, TOP_K).build()
    return sampling.sample_edges(g, spec, _seeds(g))["placed"].select("sample_id", "edge_id")


@query("""SELECT sample_id, edge_id FROM (SELECT c_custkey AS sample_id, o_orderkey AS edge_id, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r
    FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderdate <= TIMESTAMP '1996-06-01') WHERE r <= 2""")
def sample_latest(spark, sf_dir):
    """As of a time: later edges aren't seen."""
    g, schema = _schema(spark, sf_dir)
    spec = SpecBuilder(schema).seed("customer").sample("placed", 2, LATEST).build()
    seeds = _seeds(g).withColumn("as_of", F.lit("1996-06-01").cast("timestamp"))
    return sampling.sample_edges(g, spec, seeds)["placed"].select("sample_id", "edge_id")


@query("""SELECT sample_id, edge_id FROM (SELECT c_custkey AS sample_id, o_orderkey AS edge_id, row_number() OVER (PARTITION BY c_custkey ORDER BY
        ln((CAST(CAST('0x' || substr(md5('0|customer->orders|' || c_custkey || '|' || c_custkey || '|' || o_orderkey), 1, 12) AS BIGINT) AS DOUBLE) + 1) / 281474976710657.0) / o_totalprice DESC, o_orderkey) AS r
    FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 0) WHERE r <= 2""")
def sample_weighted(spark, sf_dir):
    g, schema = _schema(spark, sf_dir)
    spec = SpecBuilder(schema).seed("customer").sample("placed", 2, "RANDOM_WEIGHTED", "customer->orders").build()
    return sampling.sample_edges(g, spec, _seeds(g))["placed"].select("sample_id", "edge_id")


_HOPS = """WITH h1 AS (SELECT * FROM (SELECT c_custkey AS sample_id, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY CAST(o_totalprice AS DECIMAL(18,2)) DESC, o_orderkey) AS r
        FROM customer JOIN orders ON o_custkey = c_custkey) WHERE r <= 2),
    li AS (SELECT l_orderkey, l_partkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS w FROM lineitem GROUP BY 1, 2),
    h2 AS (SELECT * FROM (SELECT sample_id, l_orderkey, l_partkey, row_number() OVER (PARTITION BY sample_id, l_orderkey ORDER BY w DESC, l_partkey) AS r FROM h1 JOIN li ON l_orderkey = o_orderkey) WHERE r <= 2)"""


def _two_hops(spark: SparkSession, sf_dir: str):
    g, schema = _schema(spark, sf_dir)
    e = g.edges["contains"].table.groupBy("component_id", "source_id", "target_id").agg(F.sum("price").alias("weight"))
    e = e.withColumn("edge_id", F.col("source_id") * 1_000_000 + F.col("target_id")).withColumn("pos", F.col("target_id"))
    g = g.with_table(EDGES, "contains", e)
    return g, SpecBuilder(schema).seed("customer").sample(["placed", "contains"], 2, TOP_K).build()


@query(_HOPS + """ SELECT sample_id, l_orderkey AS source_id, l_partkey AS target_id FROM h2""")
def sample_two_hops(spark, sf_dir):
    g, spec = _two_hops(spark, sf_dir)
    return sampling.sample_edges(g, spec, _seeds(g))["contains"].select("sample_id", "source_id", "target_id")


@query(_HOPS + """ SELECT sample_id AS component_id, CAST(1 AS BIGINT) AS customers, coalesce(n, 0) AS orders, coalesce(m, 0) AS parts FROM (SELECT c_custkey AS sample_id FROM customer)
    LEFT JOIN (SELECT sample_id, count(DISTINCT o_orderkey) AS n FROM h1 GROUP BY 1) USING (sample_id) LEFT JOIN (SELECT sample_id, count(DISTINCT l_partkey) AS m FROM h2 GROUP BY 1) USING (sample_id)""")
def sample_subgraphs(spark, sf_dir):
    """Whole samples as graphs: sizes of their node sets."""
    g, spec = _two_hops(spark, sf_dir)
    out = sampling.sample(g, spec, _seeds(g))
    cols = batching.size_columns(out)
    return batching.sizes(out).select("component_id", *(F.col(cols[NODES, n]).alias(a) for n, a in (("customer", "customers"), ("orders", "orders"), ("part", "parts"))))


@query("""WITH l AS (SELECT c_custkey || '/' || o_orderkey AS sample_id, c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey)
    SELECT sample_id AS component_id, c_custkey AS node_id, CAST(c_acctbal AS DOUBLE) AS acctbal FROM l JOIN customer USING (c_custkey)""")
def sample_links(spark, sf_dir):
    """Link samples: the source end by structured readout."""
    g, schema = _schema(spark, sf_dir)
    links = g.edges["placed"].table.join(_seeds(g).select(F.col("node_id").alias("source_id")), "source_id").select(F.concat_ws("/", "source_id", "target_id").alias("sample_id"), F.col("source_id").alias("source"), F.col("target_id").alias("target"))
    source = SpecBuilder(schema).seed("customer").sample("customer_in", 1, TOP_K).build()
    target = SpecBuilder(schema).seed("orders").sample("contains", 2, UNIFORM).build()
    out = sampling.sample_links(g, source, links, target_spec=target)
    ends = out.edges["_readout/source"].table.select("component_id", F.col("source_id").alias("node_id"), F.col("target_id").alias("_r"))
    got = readout.structured_readout(out, "source", "acctbal", "acctbal").withColumnRenamed("node_id", "_r")
    return _double(ends.join(got, ["component_id", "_r"]).select("component_id", "node_id", "acctbal"), "acctbal")


@query("""WITH n AS (SELECT c_custkey AS k, c_nationkey FROM customer),
    o AS (SELECT k, e FROM (SELECT c_custkey AS k, o_orderkey AS e, row_number() OVER (PARTITION BY c_custkey ORDER BY md5('0|customer->orders|' || c_custkey || '|' || c_custkey || '|' || o_orderkey)) AS r
        FROM customer JOIN orders ON o_custkey = c_custkey) WHERE r <= 2),
    l AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem),
    p AS (SELECT k, e FROM (SELECT k, l_orderkey * 1000000 + l_partkey AS e, row_number() OVER (PARTITION BY k, l_orderkey ORDER BY md5('0|placed->part|' || k || '|' || l_orderkey || '|' || (l_orderkey * 1000000 + l_partkey))) AS r
        FROM o JOIN l ON l_orderkey = e) WHERE r <= 2)
    SELECT k AS sample_id, 'customer_in' AS edge_set, k AS edge_id FROM n UNION ALL SELECT k, 'placed', e FROM o UNION ALL SELECT k, 'contains', e FROM p
    UNION ALL SELECT k, 'nation_in', CAST(c_nationkey AS BIGINT) FROM n""")
def sample_tree(spark, sf_dir):
    """All edge sets out of customers, two levels deep."""
    g, schema = _schema(spark, sf_dir)
    one = g.edges["contains"].table.select("component_id", "source_id", "target_id").distinct()
    g = g.with_table(EDGES, "contains", one.withColumn("edge_id", F.col("source_id") * 1_000_000 + F.col("target_id")))
    spec = spec_tree(schema, "customer", [2, 2])
    found = sampling.sample_edges(g, spec, _seeds(g))
    out = None
    for n, df in sorted(found.items()):
        own = df.select("sample_id", F.lit(n).alias("edge_set"), "edge_id")
        out = own if out is None else out.unionByName(own)
    return out


@query("""SELECT k AS row_id, v AS value FROM (SELECT o_custkey AS k, o_orderkey AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY md5('5|' || o_custkey || '|' || o_orderkey)) AS r FROM orders) WHERE r <= 2""")
def ragged_choice(spark, sf_dir):
    from weft.functions.ragged import choice

    return choice(tpch.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("row_id"), F.col("o_orderkey").alias("value")), 2, 5)


@query("""SELECT k AS row_id, v AS value FROM (SELECT o_custkey AS k, o_orderkey AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 2""")
def ragged_top_k(spark, sf_dir):
    from weft.functions.ragged import top_k

    return top_k(tpch.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("row_id"), F.col("o_orderkey").alias("value"), F.col("o_totalprice").alias("weight"), F.col("o_orderkey").alias("pos")), 2).select("row_id", "value")


@query("""SELECT o_custkey AS row_id, o_orderstatus AS value, row_number() OVER (PARTITION BY o_custkey ORDER BY min(o_orderkey)) - 1 AS pos FROM orders GROUP BY 1, 2""")
def ragged_unique(spark, sf_dir):
    from weft.functions.ragged import unique

    return unique(tpch.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("row_id"), F.col("o_orderstatus").alias("value"), F.col("o_orderkey").alias("pos")))


@query("""WITH v AS (SELECT o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY min(o_orderkey)) - 1 AS i FROM orders GROUP BY 1, 2)
    SELECT o_orderkey AS pos, i AS index FROM orders JOIN v USING (o_custkey, o_orderstatus)""")
def ragged_lookup(spark, sf_dir):
    from weft.functions.ragged import lookup, unique

    rows = tpch.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("row_id"), F.col("o_orderstatus").alias("value"), F.col("o_orderkey").alias("pos"))
    return lookup(rows, unique(rows)).select("pos", "index")


# ---------------------------------------------------------------- readout


@query("""SELECT component_id, CAST(v AS DOUBLE) AS value FROM (SELECT c_mktsegment AS component_id, c_acctbal AS v, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS r FROM customer) WHERE r = 1""")
def structured_readout(spark, sf_dir):
    g = readout.add_readout_from_first_node(tpch.sales(spark, sf_dir), "seed", "customer")
    return _double(readout.structured_readout(g, "seed", "acctbal").select("component_id", "value"), "value")


@query("""SELECT component_id, CAST(v AS DOUBLE) AS acctbal FROM (SELECT c_mktsegment AS component_id, c_acctbal AS v, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS r FROM customer) WHERE r = 1""")
def readout_into_feature(spark, sf_dir):
    g = readout.add_readout_from_first_node(tpch.sales(spark, sf_dir), "seed", "customer")
    return _double(readout.readout_into_feature(g, "seed", "acctbal").nodes["_readout"].select("component_id", "acctbal"), "acctbal")


@query("""SELECT c_mktsegment AS component_id, count(*) AS customers FROM customer GROUP BY 1""")
def context_readout(spark, sf_dir):
    return readout.context_readout_into_feature(tpch.sales(spark, sf_dir), "customers").nodes["_readout"].select("component_id", "customers")


@query("""SELECT component_id, CAST(v AS DOUBLE) AS label FROM (SELECT c_mktsegment AS component_id, c_acctbal AS v, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS r FROM customer) WHERE r = 1""")
def root_label(spark, sf_dir):
    return _double(readout.pop_label(tpch.sales(spark, sf_dir), "acctbal", "customer")[1], "label")


@query("""SELECT c_mktsegment AS component_id, count(*) AS label FROM customer GROUP BY 1""")
def context_label(spark, sf_dir):
    return readout.pop_label(tpch.sales(spark, sf_dir), "customers")[1]


# ---------------------------------------------------------------- sizes and statistics


@query("""SELECT c_mktsegment AS component_id, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS orders, count(o_orderkey) AS placed FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1""")
def component_sizes(spark, sf_dir):
    g = tpch.sales(spark, sf_dir)
    c = batching.size_columns(g)
    return batching.sizes(g).select("component_id", F.col(c[NODES, "customer"]).alias("customers"), F.col(c[NODES, "orders"]).alias("orders"), F.col(c[EDGES, "placed"]).alias("placed"))


@query("""SELECT c_mktsegment AS component_id, count(*) <= 300 AS ok FROM customer GROUP BY 1""")
def satisfies_constraints(spark, sf_dir):
    return batching.satisfies(tpch.sales(spark, sf_dir), batching.SizeConstraints(1, {"customer": 300}))


@query("""WITH s AS (SELECT c_mktsegment AS k, count(DISTINCT c_custkey) AS c, count(o_orderkey) AS o FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1)
    SELECT 'components' AS item, CAST(3 AS BIGINT) AS budget UNION ALL SELECT 'customer', CAST(2 * max(c) + 1 AS BIGINT) FROM s UNION ALL SELECT 'orders', CAST(2 * max(o) + 1 AS BIGINT) FROM s UNION ALL SELECT 'placed', CAST(2 * max(o) AS BIGINT) FROM s""")
def tight_constraints(spark, sf_dir):
    limits = batching.tight_constraints(tpch.sales(spark, sf_dir), 2)
    return spark.createDataFrame([("components", limits.components), *limits.nodes.items(), *limits.edges.items()], "item string, budget long")


@query("""WITH RECURSIVE n AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, count(l_orderkey) AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY o_orderkey) AS i FROM n),
    b AS (SELECT o_orderkey, month, lines, i, lines AS used, CAST(0 AS BIGINT) AS batch FROM r WHERE i = 1
        UNION ALL SELECT r.o_orderkey, r.month, r.lines, r.i, CASE WHEN b.used + r.lines > 100 THEN r.lines ELSE b.used + r.lines END, b.batch + CASE WHEN b.used + r.lines > 100 THEN 1 ELSE 0 END
        FROM b JOIN r ON r.month = b.month AND r.i = b.i + 1)
    SELECT o_orderkey, month, lines, batch FROM b""")
def dynamic_batches(spark, sf_dir):
    """Orders with their lineitems, packed under a budget of 100 lineitems, a shard for each month of orders."""
    o, li = tpch.read(spark, sf_dir, "orders"), tpch.read(spark, sf_dir, "lineitem")
    n = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"))
    sized = o.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("month")).join(n, "o_orderkey", "left").fillna(0, ["lines"])
    return batching.dynamic_batches(sized, {"lines": 100}, ["o_orderkey"], "month")


@query("""WITH RECURSIVE n AS (SELECT o_orderkey, count(l_orderkey) AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
    r AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS i, sum(lines) OVER (ORDER BY o_orderkey) AS s FROM n),
    b AS (SELECT i, s - lines + 100 AS t, CAST(0 AS BIGINT) AS batch FROM r WHERE i = 1
        UNION ALL SELECT r.i, r.s - r.lines + 100, y.batch + 1 FROM (SELECT b.batch, min(r.i) AS i FROM b JOIN r ON r.i > b.i AND (r.s > b.t OR r.i >= b.i + 30) GROUP BY b.batch) AS y JOIN r USING (i))
    SELECT r.o_orderkey, r.lines, b.batch FROM r ASOF JOIN b ON r.i >= b.i""")
def dynamic_batches_whole(spark, sf_dir):
    """All orders in one sequence, under budgets of 100 lineitems and of 30 orders a batch."""
    o, li = tpch.read(spark, sf_dir, "orders"), tpch.read(spark, sf_dir, "lineitem")
    n = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"))
    sized = o.select("o_orderkey").join(n, "o_orderkey", "left").fillna(0, ["lines"]).withColumn("orders", F.lit(1).cast("long"))
    return batching.dynamic_batches(sized, {"lines": 100, "orders": 30}, ["o_orderkey"]).select("o_orderkey", "lines", "batch")


@query("""WITH m AS (SELECT max(n) AS n FROM (SELECT count(*) AS n FROM customer GROUP BY c_mktsegment)) SELECT CAST((SELECT count(*) FROM customer) + 10 AS BIGINT) AS nodes, (SELECT count(DISTINCT c_mktsegment) FROM customer) + 1 AS components,
    (SELECT count(DISTINCT c_mktsegment) FROM customer) AS real_ones FROM m""")
def pad_to_totals(spark, sf_dir):
    g = tpch.sales(spark, sf_dir)
    g = PropertyGraph({"customer": g.nodes["customer"]}, {}, g.context())
    n, k = g.nodes["customer"].count(), g.context().count()
    padded, mask = batching.pad_to_totals(g, batching.SizeConstraints(k + 1, {"customer": n + 10}))
    a = padded.nodes["customer"].agg(F.count("*").alias("nodes"))
    return a.crossJoin(mask.agg(F.count("*").alias("components"), F.count(F.when(F.col("real"), 1)).alias("real_ones")))


@query("""SELECT 'l_quantity' AS feature, min(l_quantity) AS min, max(l_quantity) AS max, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / count(*) AS mean FROM lineitem
    UNION ALL SELECT 'l_linenumber', CAST(min(l_linenumber) AS DOUBLE), CAST(max(l_linenumber) AS DOUBLE), CAST(sum(l_linenumber) AS DOUBLE) / count(*) FROM lineitem""")
def basic_stats(spark, sf_dir):
    return metrics.basic_stats(tpch.read(spark, sf_dir, "lineitem"), ["l_quantity", "l_linenumber"])


@query("""SELECT 'nodes/part/size' AS key, CAST(min(p_size) AS DOUBLE) AS min, quantile_cont(CAST(p_size AS DOUBLE), 0.5) AS median, CAST(max(p_size) AS DOUBLE) AS max FROM part
    UNION ALL SELECT 'nodes/part/#size', CAST(count(*) AS DOUBLE), CAST(count(*) AS DOUBLE), CAST(count(*) AS DOUBLE) FROM part""")
def quantile_stats(spark, sf_dir):
    g = tpch.catalog(spark, sf_dir)
    own = PropertyGraph({"part": g.nodes["part"].select("component_id", "node_id", "size")}, {})
    return metrics.quantile_stats(own, 3, exact=True).select("key", "min", "median", "max")


# ---------------------------------------------------------------- metrics

_GUESS = "SELECT l_linenumber AS y, CASE WHEN l_quantity > 40 THEN 1 WHEN l_quantity > 20 THEN 2 ELSE 3 END AS p FROM lineitem"


@query(f"""WITH g AS ({_GUESS}), k AS (SELECT DISTINCT y AS c FROM g UNION SELECT DISTINCT p FROM g)
    SELECT CAST(c AS BIGINT) AS class, coalesce((SELECT CAST(sum(CASE WHEN y = p THEN 1 ELSE 0 END) AS DOUBLE) / count(*) FROM g WHERE p = c), 0.0) AS precision,
    coalesce((SELECT CAST(sum(CASE WHEN y = p THEN 1 ELSE 0 END) AS DOUBLE) / count(*) FROM g WHERE y = c), 0.0) AS recall FROM k""")
def per_class_metrics(spark, sf_dir):
    li = tpch.read(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("y"), F.when(F.col("l_quantity") > 40, 1).when(F.col("l_quantity") > 20, 2).otherwise(3).alias("p"))
    return metrics.per_class(li, "y", "p")


@query("""SELECT CAST(sum(CASE WHEN y = p THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS accuracy, CAST(sum(y * p) AS DOUBLE) / sum(p) AS precision, CAST(sum(y * p) AS DOUBLE) / sum(y) AS recall
    FROM (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS p FROM lineitem)""")
def binary_metrics(spark, sf_dir):
    li = tpch.read(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_quantity") - 25).alias("z"))
    return metrics.binary_metrics(li, "y", "z").select("accuracy", "precision", "recall")


@query("""SELECT CAST(sum(abs(q - n)) AS DOUBLE) / count(*) AS mae, CAST(sum((q - n) * (q - n)) AS DOUBLE) / count(*) AS mse FROM (SELECT CAST(l_quantity AS BIGINT) AS q, CAST(l_linenumber AS BIGINT) AS n FROM lineitem)""")
def regression_losses(spark, sf_dir):
    return metrics.regression_losses(tpch.read(spark, sf_dir, "lineitem"), "l_quantity", "l_linenumber").select("mae", "mse")


@query("""SELECT CAST(sum(greatest(q - n + 1, 0)) AS DOUBLE) AS triplet_loss FROM (SELECT CAST(l_quantity AS BIGINT) AS q, CAST(l_linenumber AS BIGINT) * 5 AS n FROM lineitem)""")
def triplet_loss(spark, sf_dir):
    li = tpch.read(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("q"), (F.col("l_linenumber") * 5).cast("double").alias("n"))
    return metrics.triplet_loss(li, "q", "n").select("triplet_loss")


_INTS = "list_transform(embedding, lambda x: CAST(floor(x * 64) AS DOUBLE))"


@query(f"""SELECT a.vec_id AS component_id, list_dot_product({_INTS.replace('embedding', 'a.embedding')}, {_INTS.replace('embedding', 'b.embedding')}) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def link_scores(spark, sf_dir):
    """Dot products of each vector and the next, as links."""
    e = tpch.read(spark, sf_dir, "embeddings").select(F.col("vec_id"), F.transform("embedding", lambda x: F.floor(x * 64).cast("double")).alias("x"))
    links = e.select(F.col("vec_id").alias("sample_id"), F.col("vec_id").alias("source"), (F.col("vec_id") + 1).alias("target"))
    links = links.join(e.select(F.col("vec_id").alias("target")), "target").select("sample_id", "source", "target")
    both = links.select(F.col("sample_id").alias("component_id"), F.explode(F.array("source", "target")).alias("node_id")).join(e.withColumnRenamed("vec_id", "node_id"), "node_id")
    g = sampling.add_link_readout(PropertyGraph({"v": both}, {}), links, "v", "v")
    return metrics.link_scores(g, "x").select("component_id", "score")


@query()
def svd_metrics(spark, sf_dir):
    got = metrics.svd_metrics(tpch.read(spark, sf_dir, "embeddings"), "embedding", 64)
    return spark.createDataFrame(sorted(got.items()), "metric string, value double")


def _spectrum() -> str:
    """The largest eigenvalue of the gram matrix by squaring it, over its trace at each step; and the gram matrix of unit rows."""
    squares = "".join(
        f"""
        p{k} AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM n{k - 1} AS a JOIN n{k - 1} AS b ON a.j = b.i GROUP BY a.i, b.j), t{k} AS MATERIALIZED (SELECT sum(v) AS t FROM p{k} WHERE i = j), n{k} AS MATERIALIZED (SELECT i, j, v / t AS v FROM p{k}, t{k}),"""
        for k in range(1, 23)
    )
    logs = " + ".join(f"(SELECT ln(t) FROM t{k}) / {2**k}" for k in range(1, 23))
    return f"""WITH x AS MATERIALIZED (SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) t(i)), u AS MATERIALIZED (SELECT vec_id, i, v / sqrt(sum(v * v) OVER (PARTITION BY vec_id)) AS v FROM x),
        g AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.v * b.v) AS v FROM x AS a JOIN x AS b USING (vec_id) GROUP BY a.i, b.i), h AS (SELECT sum(a.v * b.v) AS v FROM u AS a JOIN u AS b USING (vec_id) GROUP BY a.i, b.i),
        t0 AS MATERIALIZED (SELECT sum(v) AS t FROM g WHERE i = j), n0 AS MATERIALIZED (SELECT i, j, v / t AS v FROM g, t0),{squares}
        n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM embeddings), e AS (SELECT n, n + n * (n - 1) / 64 AS e FROM n)
        SELECT 'numerical_rank' AS metric, CAST(floor(1000 / exp({logs}) + 0.123) AS BIGINT) AS thousandths
        UNION ALL SELECT 'self_clustering', CAST(floor(1000 * (any_value(s.s) - any_value(e)) / (any_value(n * n) - any_value(e)) + 0.123) AS BIGINT) FROM e, (SELECT sum(v * v) AS s FROM h) AS s"""


@query(_spectrum())
def spectrum(spark, sf_dir):
    got = metrics.svd_metrics(tpch.read(spark, sf_dir, "embeddings"), "embedding", 64)
    rows = [(m, math.floor(1000 * got[m] + 0.123)) for m in ("numerical_rank", "self_clustering")]
    return spark.createDataFrame(rows, "metric string, thousandths long")


_VIEWS = """WITH x AS (SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) AS a, CASE WHEN i % 2 = 0 THEN 0.5 ELSE 0.9 END * CAST(embedding[i] AS DOUBLE) + 0.25 * CAST(embedding[i % 64 + 1] AS DOUBLE) AS b FROM embeddings, range(1, 65) t(i)),
    m AS (SELECT i, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS va, var_pop(b) AS vb, avg((a - b) * (a - b)) AS d, count(*) AS n FROM x GROUP BY i)"""


@query(_VIEWS + """, k AS (SELECT p.i, q.i AS j, sum((p.a - mp.ma) * (q.a - mq.ma)) / (any_value(mp.n) - 1) AS ca, sum((p.b - mp.mb) * (q.b - mq.mb)) / (any_value(mp.n) - 1) AS cb,
        sum((p.a - mp.ma) * (q.b - mq.mb)) / any_value(mp.n) / sqrt((any_value(mp.va) + 1e-12) * (any_value(mq.vb) + 1e-12)) AS c
        FROM x p JOIN x q USING (vec_id) JOIN m mp ON mp.i = p.i JOIN m mq ON mq.i = q.i GROUP BY p.i, q.i),
    v AS (SELECT 25 * avg(d) + 25 * avg(greatest(0, 1 - sqrt(va + 1e-4))) + 25 * avg(greatest(0, 1 - sqrt(vb + 1e-4))) AS v FROM m),
    o AS (SELECT sum(CASE WHEN i <> j THEN ca * ca + cb * cb ELSE 0 END) / 64 AS o, sum(CASE WHEN i = j THEN (1 - c) * (1 - c) ELSE c * c / 64 END) AS b FROM k)
    SELECT 'vicreg' AS loss, CAST(floor((v + o) * 1000 + 0.123) AS BIGINT) AS thousandths FROM v, o UNION ALL SELECT 'barlow_twins', CAST(floor(b * 1000 + 0.123) AS BIGINT) FROM o""")
def contrastive_losses(spark, sf_dir):
    """The second view mixes each component with the next."""
    x = F.col("embedding")
    view = F.transform(x, lambda v, i: F.when(i % 2 == 1, 0.5).otherwise(0.9) * v.cast("double") + 0.25 * x[(i + 1) % 64].cast("double"))
    e = tpch.read(spark, sf_dir, "embeddings").select("embedding", view.alias("view"))
    got = [("vicreg", metrics.vicreg_loss(e, "embedding", "view", 64)), ("barlow_twins", metrics.barlow_twins_loss(e, "embedding", "view", 64))]
    return spark.createDataFrame(got, "loss string, value double").select("loss", F.floor(F.col("value") * 1000 + 0.123).alias("thousandths"))


@query("""WITH x AS (SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) t(i)), u AS (SELECT vec_id, i, v / sqrt(sum(v * v) OVER (PARTITION BY vec_id)) AS v FROM x),
    g AS (SELECT p.i, q.i AS j, sum(p.v * q.v) AS g FROM u p JOIN u q USING (vec_id) GROUP BY 1, 2), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM embeddings)
    SELECT CAST(floor(((SELECT sum(g * g) FROM g) - (n + n * (n - 1) / 64)) / (n * n - (n + n * (n - 1) / 64)) * 1000000 + 0.123) AS BIGINT) AS millionths FROM n""")
def self_clustering(spark, sf_dir):
    """How far vectors have collapsed, from the gram matrix of unit vectors."""
    g, n = metrics.gram(tpch.read(spark, sf_dir, "embeddings"), "embedding", 64, unit=True)
    return spark.createDataFrame([(metrics.self_clustering(g, n),)], "v double").select(F.floor(F.col("v") * 1_000_000 + 0.123).alias("millionths"))


@query("""SELECT p_partkey AS node_id, CAST(p_size - 10 AS BIGINT) AS size FROM part""")
def subtract_features(spark, sf_dir):
    p = tpch.catalog(spark, sf_dir).nodes["part"].select("node_id", F.col("size").cast("long").alias("size"))
    return metrics.combine_features(p, p.withColumn("size", F.lit(10).cast("long")), ["node_id"], ["size"])


@query("""SELECT p_partkey AS node_id, CAST(3 * p_size AS BIGINT) AS size FROM part""")
def sum_features(spark, sf_dir):
    p = tpch.catalog(spark, sf_dir).nodes["part"].select("node_id", F.col("size").cast("long").alias("size"))
    return metrics.sum_features([p, p, p], ["node_id"], ["size"])


@query("""SELECT p_partkey AS node_id, CAST(k AS INTEGER) AS step, p_size * k / 4.0 AS size FROM part CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS k)""")
def interpolate_features(spark, sf_dir):
    p = tpch.catalog(spark, sf_dir).nodes["part"].select("node_id", F.col("size").cast("double").alias("size"))
    return metrics.interpolate_features(p.withColumn("size", F.lit(0.0)), p, ["node_id"], ["size"], 5)


@query("""SELECT p_partkey AS node_id, 0 AS size FROM part""")
def counterfactual(spark, sf_dir):
    return metrics.counterfactual(tpch.catalog(spark, sf_dir).nodes["part"].select("node_id", "size"), ["size"])


# ---------------------------------------------------------------- layers (weights are given)


def _states(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Integer states, so that sums are exact: orders (1, priority by price), parts (size, 1)."""
    g = tpch.catalog(spark, sf_dir)
    g = g.with_table(NODES, "part", g.nodes["part"].select("component_id", "node_id", F.array(F.col("size").cast("double"), F.lit(1.0)).alias("state")))
    g = g.with_table(NODES, "orders", g.nodes["orders"].select("component_id", "node_id", F.array(F.lit(1.0), F.floor(F.col("totalprice") / 100000).cast("double")).alias("state")))
    e = g.edges["contains"]
    return g.with_table(EDGES, "contains", e.table.select("component_id", "edge_id", "source_id", "target_id", F.array(F.col("quantity").cast("double")).alias("state"), F.col("quantity").cast("double").alias("weight")))


@query("""SELECT p_partkey AS node_id, coalesce(sum(1 + 2 * o + 3 * q), 0.0) AS a, coalesce(sum(greatest(o - q, 0)), 0.0) AS b FROM part LEFT JOIN
    (SELECT l_partkey, CAST(floor(CAST(o_totalprice AS DECIMAL(18,2)) / 100000) AS DOUBLE) AS o, CAST(CAST(l_quantity AS BIGINT) AS DOUBLE) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey) ON l_partkey = p_partkey GROUP BY 1""")
def simple_conv(spark, sf_dir):
    dense = layers.Dense([[1, 0], [2, 1], [3, -1]], activation="relu")
    out = layers.simple_conv(_states(spark, sf_dir), "contains", dense, TARGET, "sum", "state", "state")
    return out.select("node_id", F.col("value")[0].alias("a"), F.col("value")[1].alias("b"))


@query("""WITH e AS (SELECT l_partkey, CAST(floor(CAST(o_totalprice AS DECIMAL(18,2)) / 100000) AS DOUBLE) AS o, CAST(CAST(l_quantity AS BIGINT) AS DOUBLE) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT p_partkey AS node_id, coalesce(sum(q * (1 + o)), 0.0) AS a FROM part LEFT JOIN e ON l_partkey = p_partkey GROUP BY 1""")
def gcn_conv(spark, sf_dir):
    out = layers.gcn_conv(_states(spark, sf_dir), "contains", layers.Dense([[1], [1]]), TARGET, weight="weight", normalization="none")
    return out.select("node_id", F.col("value")[0].alias("a"))


@query(_TRADE + """, i AS (SELECT t AS k, sum(n) + 1.0 AS d FROM trade GROUP BY 1), o AS (SELECT s AS k, sum(n) + 1.0 AS d FROM trade GROUP BY 1),
    k AS (SELECT CAST(n_nationkey AS BIGINT) AS k, coalesce(i.d, 1.0) AS di, coalesce(o.d, 1.0) AS dr FROM nation LEFT JOIN i ON i.k = n_nationkey LEFT JOIN o ON o.k = n_nationkey),
    m AS (SELECT t, s, n / sqrt(a.di) / sqrt(b.dr) AS f FROM trade JOIN k a ON a.k = t JOIN k b ON b.k = s UNION ALL SELECT k, k, 1 / sqrt(di) / sqrt(dr) FROM k)
    SELECT t AS node_id, CAST(floor(sum(f * s) * 1000 + 0.123) AS BIGINT) AS a, CAST(floor(sum(f) * 1000 + 0.123) AS BIGINT) AS b FROM m GROUP BY 1""")
def gcn_conv_normalized(spark, sf_dir):
    g = _nation_pairs(spark, sf_dir)
    g = g.with_table(NODES, "nation", g.nodes["nation"].withColumn("state", F.array(F.col("node_id").cast("double"), F.lit(1.0))))
    out = layers.gcn_conv(g, "trade", layers.Dense([[1, 0], [0, 1]]), TARGET, weight="n", self_loops=True, normalization="in_out")
    return out.select("node_id", *(F.floor(F.col("value")[i] * 1000 + 0.123).alias(c) for i, c in enumerate("ab")))


@query("""WITH e AS (SELECT l_orderkey, p_size FROM lineitem JOIN part ON l_partkey = p_partkey)
    SELECT o_orderkey AS node_id, coalesce(CAST(sum(p_size) AS DOUBLE) / count(p_size), 0.0) * 2 AS a FROM orders LEFT JOIN e ON l_orderkey = o_orderkey GROUP BY 1""")
def sage_mean(spark, sf_dir):
    out = layers.sage_mean(_states(spark, sf_dir), "contains", layers.Dense([[2], [0]]), SOURCE)
    return out.select("node_id", F.col("value")[0].alias("a"))


@query("""SELECT o_orderkey AS node_id, CAST(coalesce(max(greatest(p_size - 20, 0)), 0) AS DOUBLE) * 3 AS a FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def sage_pool(spark, sf_dir):
    out = layers.sage_pool(_states(spark, sf_dir), "contains", layers.Dense([[1], [0]], [-20], "relu"), layers.Dense([[3]]), SOURCE)
    return out.select("node_id", F.col("value")[0].alias("a"))


def _units(df: DataFrame) -> DataFrame:
    return df.select("node_id", F.floor(F.col("value")[0] * 1000 + 0.123).alias("a"))


@query("""WITH e AS (SELECT l_orderkey AS k, p_size / 10.0 AS v, p_size AS s FROM lineitem JOIN part ON l_partkey = p_partkey), m AS (SELECT k, v, s, max(v) OVER (PARTITION BY k) AS m FROM e)
    SELECT o_orderkey AS node_id, CAST(floor(coalesce(sum(exp(v - m) * s) / sum(exp(v - m)), 0) * 1000 + 0.123) AS BIGINT) AS a FROM orders LEFT JOIN m ON k = o_orderkey GROUP BY 1""")
def multi_head_attention(spark, sf_dir):
    """Query 1, key size / 10, value size."""
    a = layers.Attention(layers.Dense([[1], [0]]), layers.Dense([[0.1], [0]]), layers.Dense([[1], [0]]), scaling="none")
    return _units(layers.multi_head_attention(_states(spark, sf_dir), "contains", a, SOURCE))


@query("""WITH e AS (SELECT l_orderkey AS k, 1 + p_size / 10.0 AS v, p_size / 10.0 AS s FROM lineitem JOIN part ON l_partkey = p_partkey), m AS (SELECT k, v, s, max(v) OVER (PARTITION BY k) AS m FROM e)
    SELECT o_orderkey AS node_id, CAST(floor(coalesce(sum(exp(v - m) * s) / sum(exp(v - m)), 0) * 1000 + 0.123) AS BIGINT) AS a FROM orders LEFT JOIN m ON k = o_orderkey GROUP BY 1""")
def gat_v2(spark, sf_dir):
    a = layers.Attention(layers.Dense([[1], [0]]), layers.Dense([[0.1], [0]]), vector=[[1]])
    return _units(layers.gat_v2(_states(spark, sf_dir), "contains", a, SOURCE))


@query("""WITH e AS (SELECT l_orderkey AS k, p_size / 10.0 AS v, 0.5 * p_size + 1 AS s FROM lineitem JOIN part ON l_partkey = p_partkey), m AS (SELECT k, v, s, max(v) OVER (PARTITION BY k) AS m FROM e),
    a AS (SELECT o_orderkey AS k, CAST(floor(CAST(o_totalprice AS DECIMAL(18,2)) / 100000) AS DOUBLE) AS p, coalesce(sum(exp(v - m) * s) / sum(exp(v - m)), 0) AS x FROM orders LEFT JOIN m ON k = o_orderkey GROUP BY 1, 2),
    g AS (SELECT k, p, x * 0.5 * (1 + tanh(0.7978845608028654 * (x + 0.044715 * x * x * x))) AS x FROM a)
    SELECT k AS node_id, CAST(floor((0.5 * x + 0.5) * 1000 + 0.123) AS BIGINT) AS a, CAST(floor((0.5 * x + 0.5 * p) * 1000 + 0.123) AS BIGINT) AS b FROM g""")
def hgt_update(spark, sf_dir):
    g = _states(spark, sf_dir)
    a = layers.Attention(layers.Dense([[1], [0]]), layers.Dense([[0.1], [0]]), layers.Dense([[0.5], [1]]))
    out = layers.hgt_update(g, ["contains"], SOURCE, {"contains": a}, {"contains": [1.0]}, layers.Dense([[1, 1]]), 0.0)
    return out.select("node_id", *(F.floor(F.col("value")[i] * 1000 + 0.123).alias(c) for i, c in enumerate("ab")))


@query("""WITH e AS (SELECT l_orderkey, p_size FROM lineitem JOIN part ON l_partkey = p_partkey)
    SELECT o_orderkey AS node_id, CAST(1 + coalesce(sum(p_size + 1), 0) AS DOUBLE) AS a FROM orders LEFT JOIN e ON l_orderkey = o_orderkey GROUP BY 1""")
def vanilla_mpnn(spark, sf_dir):
    """Messages are the senders' state sum; the next state adds them to the first component."""
    g = layers.vanilla_mpnn(_states(spark, sf_dir), {"contains": layers.Dense([[1], [1], [0], [0]])}, {"orders": layers.Dense([[1], [0], [1]])}, SOURCE)
    return g.nodes["orders"].select("node_id", F.col("state")[0].alias("a"))


# ---------------------------------------------------------------- converters


@query("""WITH n AS (SELECT DISTINCT c_custkey || 'c' AS x FROM customer UNION SELECT DISTINCT 'n' || c_nationkey FROM customer) SELECT count(*) AS nodes, (SELECT count(*) FROM customer) AS edges FROM n""")
def triples_to_graph(spark, sf_dir):
    t = tpch.read(spark, sf_dir, "customer").select(F.concat("c_custkey", F.lit("c")).alias("s"), F.lit("lives_in").alias("p"), F.concat(F.lit("n"), "c_nationkey").alias("o"))
    g = tables.triples_to_graph(t, predicates=["lives_in"])
    return g.nodes["nodes"].agg(F.count("*").alias("nodes")).crossJoin(g.edges["lives_in"].table.agg(F.count("*").alias("edges")))


@query("""WITH c AS (SELECT c_custkey, row_number() OVER (ORDER BY c_mktsegment, c_custkey) - 1 AS i FROM customer), o AS (SELECT o_orderkey, o_custkey, (SELECT count(*) FROM customer) + row_number() OVER (ORDER BY c_mktsegment, o_orderkey) - 1 AS j FROM orders JOIN customer ON o_custkey = c_custkey)
    SELECT o_orderkey AS edge_id, i AS source, j AS target FROM o JOIN c ON o_custkey = c_custkey""")
def to_edge_list(spark, sf_dir):
    return tables.to_edge_list(tpch.sales(spark, sf_dir))[1].select("edge_id", "source", "target")


from weft import queries_models, queries_more, queries_sources, queries_tables, queries_tasks  # noqa: E402, F401  (they add their own)

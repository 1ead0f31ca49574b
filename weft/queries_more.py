"""Queries of hyperedges, averages, checks and attribution. Added to weft.queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from weft import sql, tpch
from weft.graph import PropertyGraph
from weft.operators import averages, checks, hyper, message, metrics
from weft.operators.structure import written
from weft.queries import _HOPS, _two_hops, query
from weft.sources import tables
from weft.sources.scratch import new_path
from weft.tools import HyperAdjacency


def _sold(spark: SparkSession, sf_dir: str) -> tuple[PropertyGraph, HyperAdjacency]:
    """Hyperedges of a lineitem's order, part and supplier."""
    li = tpch.read(spark, sf_dir, "lineitem")
    table = li.select(F.lit(0).cast("long").alias("component_id"), tpch.lineitem_id().alias("edge_id"), F.col("l_orderkey").alias("node_0"), F.col("l_partkey").alias("node_1"), F.col("l_suppkey").alias("node_2"), F.col("l_extendedprice").cast(tpch.MONEY).alias("price"), F.col("l_quantity").cast("long").alias("quantity"))
    return tpch.catalog(spark, sf_dir), HyperAdjacency(table, {0: "orders", 1: "part", 2: "supplier"})


@query("""SELECT 0 AS tag, o_orderkey AS node_id, sum(l_quantity::BIGINT)::BIGINT AS quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 2
    UNION ALL SELECT 1, l_partkey, sum(l_quantity::BIGINT)::BIGINT FROM lineitem GROUP BY 2 UNION ALL SELECT 2, l_suppkey, sum(l_quantity::BIGINT)::BIGINT FROM lineitem GROUP BY 2""")
def hyper_pool_tags(spark, sf_dir):
    """Quantities of lineitems pooled to orders, parts and suppliers by one aggregation."""
    _, h = _sold(spark, sf_dir)
    return hyper.pool_tags(h, [0, 1, 2], feature="quantity", name="quantity").select("tag", "node_id", "quantity")


@query("""SELECT p_partkey AS node_id, coalesce(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE), 0) AS total FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1""")
def hyper_pool(spark, sf_dir):
    """Prices of lineitems pooled to their parts; parts that were never sold have 0."""
    g, h = _sold(spark, sf_dir)
    return hyper.pool(g, h, 1, feature="price", name="total").select("node_id", F.col("total").cast("double").alias("total"))


@query("""SELECT s_suppkey AS node_id, max(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE AS largest FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY 1 HAVING count(o_orderkey) > 0""")
def hyper_pool_nodes(spark, sf_dir):
    """The largest order that any lineitem shares with a supplier."""
    g, h = _sold(spark, sf_dir)
    sold = h.table.select(F.col("node_2").alias("node_id")).distinct()
    return hyper.pool_nodes(g, h, 0, 2, feature="totalprice", reduce="max", name="largest").join(sold, "node_id").select("node_id", F.col("largest").cast("double").alias("largest"))


@query("""WITH s AS (SELECT l_suppkey, exp(l_quantity / 10 - max(l_quantity / 10) OVER (PARTITION BY l_suppkey)) AS e, l_orderkey, l_linenumber, l_partkey FROM lineitem)
    SELECT l_suppkey AS node_id, CAST(floor(1e6 * max(e / t) + 0.123) AS BIGINT) AS largest, count(*) AS n FROM (SELECT *, sum(e) OVER (PARTITION BY l_suppkey) AS t FROM s) GROUP BY 1""")
def hyper_softmax(spark, sf_dir):
    """Softmax of quantities over the lineitems of a supplier: the largest share, in millionths."""
    _, h = _sold(spark, sf_dir)
    h = HyperAdjacency(h.table.withColumn("tenth", F.col("quantity") / 10), h.ends)
    return hyper.softmax(h, 2, feature="tenth").groupBy(F.col("node_2").alias("node_id")).agg(F.floor(F.max("softmax") * 1e6 + 0.123).alias("largest"), F.count("*").alias("n"))


@query("""WITH RECURSIVE r AS (SELECT row_number() OVER (ORDER BY ts, event_id) AS i, CASE WHEN value > 10 THEN 0.0::DOUBLE ELSE 1.0 END AS x FROM events),
    a AS (SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS v, CAST(0 AS BIGINT) AS kept
        UNION ALL SELECT r.i, a.v + greatest(0.01::DOUBLE, 1.0::DOUBLE / r.i) * (r.x - a.v), a.kept + CASE WHEN r.x = 0 THEN 1 ELSE 0 END FROM a JOIN r ON r.i = a.i + 1)
    SELECT i AS seen, greatest(kept - 1, 0) AS step, CAST(floor(1e6 * v + 0.123) AS BIGINT) AS average FROM a WHERE i > 0 AND i % 500 = 0""")
def moving_average(spark, sf_dir):
    """Events by time that pass a filter: the moving average of the share that it removes, in millionths, at every 500th."""
    _, reports = averages.filter_with_average(tpch.read(spark, sf_dir, "events"), F.col("value") > 10, ["ts", "event_id"], 500, 0.99)
    return reports.select("seen", "step", F.floor(F.col("average") * 1e6 + 0.123).alias("average"))


@query("""SELECT 'placed' AS edge_set, 'source is no node' AS violation, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 0
    UNION ALL SELECT 'placed', 'source is in another component', count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 9000
    UNION ALL SELECT 'placed', 'target is no node', 0 UNION ALL SELECT 'placed', 'target is in another component', 0 UNION ALL SELECT 'placed', 'weight is null', 0
    UNION ALL SELECT 'placed', 'ts is null', 0 UNION ALL SELECT 'placed', c || ' is null', 0 FROM (VALUES ('component_id'), ('edge_id'), ('source_id'), ('target_id')) t(c)
    UNION ALL SELECT 'rows', 'pooled', count(*) FROM orders""")
def watched_values(spark, sf_dir):
    """Customers in debt aren't nodes and rich ones are in another component: what orders pooled to customers met on the way."""
    g = tpch.catalog(spark, sf_dir)
    c = g.nodes["customer"].where("acctbal >= 0").withColumn("component_id", F.when(F.col("acctbal") > 9000, 1).otherwise(0).cast("long"))
    g = PropertyGraph({"customer": c, "orders": g.nodes["orders"]}, {"placed": g.edges["placed"]})
    seen, watch = checks.watched(g, PropertyGraph({}, {"placed": g.edges["placed"]}).schema())
    pooled = written(message.degree(seen, "placed", "target"), "watched").count()
    rows = [(name, what, n) for (_, name, what), n in watch.counts(("edges", "placed")).items()]
    return spark.createDataFrame([*rows, ("rows", "pooled", pooled)], "edge_set string, violation string, n long")




# ---------------------------------------------------------------- sampling in SQL


@query(_HOPS + """ SELECT sample_id, l_orderkey AS source_id, l_partkey AS target_id FROM h2""")
def sql_two_hops(spark, sf_dir):
    """sample_two_hops, written in SQL over the graph's views."""
    g, _ = _two_hops(spark, sf_dir)
    # whole cents, which order rows alike: decimals are slow to hand to table functions
    g = replace(g, edges={n: replace(e, table=e.table.withColumn("weight", (F.col("weight") * 100).cast("long"))) if "weight" in e.table.columns else e for n, e in g.edges.items()})
    sql.register(spark)
    g.register_views("two_hops_")
    first = "SELECT c.node_id AS sample_id, e.source_id, e.target_id, e.edge_id, e.weight FROM two_hops_nodes_customer c JOIN two_hops_edges_placed e ON e.source_id = c.node_id"
    hop = "SELECT h.sample_id, e.source_id, e.target_id, e.pos, e.weight FROM (SELECT DISTINCT sample_id, target_id FROM one) h JOIN two_hops_edges_contains e ON e.source_id = h.target_id"
    return spark.sql(f"""WITH one AS (SELECT * FROM top_k(TABLE({first}) PARTITION BY (sample_id, source_id) ORDER BY (weight DESC, edge_id), 2))
        SELECT sample_id, source_id, target_id FROM top_k(TABLE({hop}) PARTITION BY (sample_id, source_id) ORDER BY (weight DESC, pos), 2)""")


@query("""SELECT c_custkey AS sample_id, o_orderkey AS edge_id FROM (SELECT c_custkey, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY md5('7|' || c_custkey || '|' || o_orderkey)) AS r FROM customer JOIN orders ON o_custkey = c_custkey) WHERE r <= 3""")
def sql_draw(spark, sf_dir):
    """Three orders of each customer drawn in SQL."""
    g = tpch.catalog(spark, sf_dir)
    sql.register(spark)
    g.register_views("draw_")
    table = "SELECT c.node_id AS sample_id, e.edge_id FROM draw_nodes_customer c JOIN draw_edges_placed e ON e.source_id = c.node_id"
    return spark.sql(f"SELECT sample_id, edge_id FROM draw(TABLE({table}) PARTITION BY (sample_id), 3, 7, 'sample_id,edge_id')")


@query("""WITH s AS (SELECT o_custkey, o_orderkey, exp(o_totalprice / 1e5 - max(o_totalprice / 1e5) OVER (PARTITION BY o_custkey)) AS e FROM orders)
    SELECT o_orderkey AS edge_id, CAST(floor(1e6 * e / sum(e) OVER (PARTITION BY o_custkey) + 0.123) AS BIGINT) AS millionths FROM s""")
def sql_softmax(spark, sf_dir):
    """Softmax of prices over each customer's orders in SQL, in millionths."""
    g = tpch.catalog(spark, sf_dir)
    g = PropertyGraph({}, {"placed": replace(g.edges["placed"], table=g.edges["placed"].table.withColumn("v", F.col("weight").cast("double") / 1e5))})
    sql.register(spark)
    g.register_views("softmax_")
    return spark.sql("""SELECT e.edge_id, floor(1e6D * exp(e.v - s.top) / s.total + 0.123D) AS millionths FROM softmax_edges_placed e
        JOIN softmax_sums(TABLE(SELECT source_id, v FROM softmax_edges_placed) PARTITION BY (source_id), 'v', 'source_id') s ON s.source_id = e.source_id""")


# ---------------------------------------------------------------- statistics of a whole graph

_VALUES = {
    "nodes/customer/acctbal": ("customer", "c_acctbal"), "nodes/orders/totalprice": ("orders", "o_totalprice"), "nodes/part/retailprice": ("part", "p_retailprice"), "nodes/part/size": ("part", "p_size"), "nodes/supplier/acctbal": ("supplier", "s_acctbal"),
    "edges/placed/weight": ("orders", "o_totalprice"), "edges/contains/quantity": ("lineitem", "l_quantity"), "edges/contains/price": ("lineitem", "l_extendedprice"), "edges/contains/discount": ("lineitem", "l_discount"),
    "edges/customer_in/weight": ("customer", "c_acctbal"), "edges/supplier_in/weight": ("supplier", "s_acctbal"),
}
_SIZES = {"nodes/customer": "customer", "nodes/orders": "orders", "nodes/part": "part", "nodes/supplier": "supplier", "nodes/nation": "nation", "nodes/region": "region", "edges/placed": "orders", "edges/contains": "lineitem", "edges/customer_in": "customer", "edges/supplier_in": "supplier", "edges/nation_in": "nation"}
_STATS = [f"SELECT '{k}' AS key, CAST(CAST({c} AS DECIMAL(18,2)) AS DOUBLE) AS v FROM {t}" for k, (t, c) in _VALUES.items()] + [f"SELECT '{k}/#size', CAST(count(*) AS DOUBLE) FROM {t}" for k, t in _SIZES.items()]


@query(f"""WITH v AS ({" UNION ALL ".join(_STATS)} UNION ALL SELECT 'edges/supplies/#size', CAST(count(*) AS DOUBLE) FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem))
    SELECT key, min(v) AS min, CAST(floor(quantile_cont(v, 0.5) * 1000 + 0.123) AS BIGINT) AS median, max(v) AS max FROM v GROUP BY key""")
def graph_statistics(spark, sf_dir):
    """Least, median and largest value of every numeric feature of the whole catalog, and its sets' sizes."""
    got = metrics.quantile_stats(tpch.catalog(spark, sf_dir), 3, exact=True)
    return got.select("key", "min", F.floor(F.col("median") * 1000 + 0.123).alias("median"), "max")


@query("""SELECT kind, c_mktsegment AS component_id, customers, balance FROM (VALUES ('csv'), ('parquet'), ('tfrecord')) k(kind), (SELECT c_mktsegment, count(*) AS customers, CAST(floor(sum(c_acctbal / 1000)) AS BIGINT) AS balance FROM customer GROUP BY 1)""")
def context_from_files(spark, sf_dir):
    """A context set with a file of its own, in each format: segments with their customers and balance, read back with a graph."""
    g = tpch.sales(spark, sf_dir)
    context = tpch.read(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("component_id")).agg(F.count("*").alias("customers"), F.floor(F.sum(F.col("c_acctbal") / 1000)).alias("balance"))
    own = PropertyGraph({"customer": g.nodes["customer"]}, {}, context)
    out = None
    for kind in ("csv", "parquet", "tfrecord"):
        folder = new_path(spark, "context")
        tables.save_graph(own, folder, kind)
        back, _ = tables.load_graph(spark, folder)
        rows = back.context().select(F.lit(kind).alias("kind"), F.col("component_id").cast("string").alias("component_id"), F.col("customers").cast("long").alias("customers"), F.col("balance").cast("long").alias("balance"))
        out = rows if out is None else out.unionByName(rows)
    return out

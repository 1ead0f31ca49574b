"""Queries of sources, sinks and schemas: tables are written to the shared folder and read back. Added to weft.queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft import schema as schemas
from weft import tools, tpch
from weft.graph import EdgeSet, PropertyGraph
from weft.operators import message
from weft.queries import query
from weft.schema import EDGES, NODES, SOURCE, TARGET, Feature, GraphSchema, SchemaError, SetSchema
from weft.sources import tables, tfrecord
from weft.sources.scratch import new_path


def _rows(spark: SparkSession, rows: list[tuple], kind: str) -> DataFrame:
    return spark.createDataFrame(rows, kind)


def _stored(spark: SparkSession, sf_dir: str, kind: str, shards: int | None = None) -> PropertyGraph:
    """Customers and their orders, written in a format and loaded again."""
    g = tpch.catalog(spark, sf_dir)
    own = PropertyGraph({n: g.nodes[n].drop("ts", "status", "segment") for n in ("customer", "orders")}, {"placed": EdgeSet(g.edges["placed"].table.drop("ts"), "customer", "orders")})
    own = PropertyGraph({n: x.withColumn("node_id", F.col("node_id").cast("string")) for n, x in own.nodes.items()}, {"placed": EdgeSet(own.edges["placed"].table.withColumns({c: F.col(c).cast("string") for c in ("source_id", "target_id", "edge_id")}), "customer", "orders")})
    folder = new_path(spark, kind)
    tables.save_graph(own.map_features(nodes=lambda df, _: df.drop("component_id"), edges=lambda df, _: df.drop("component_id", "edge_id")), folder, kind, shards)
    return tables.load_graph(spark, folder)[0]


_ORDERED = """SELECT c_custkey AS node_id, CAST(sum(floor(o_totalprice)) AS BIGINT) AS total, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1"""


def _ordered(g: PropertyGraph) -> DataFrame:
    e = g.edges["placed"].table.select(F.col("source_id").alias("node_id"), F.floor("weight").alias("w"))
    out = g.nodes["customer"].join(e, "node_id", "left").groupBy(F.col("node_id").cast("long").alias("node_id"))
    return out.agg(F.sum("w").alias("total"), F.count("w").alias("n"))


@query(_ORDERED)
def graph_in_csv(spark, sf_dir):
    """Schema, node and edge tables in CSV, in three files each; read with the schema's types."""
    return _ordered(_stored(spark, sf_dir, "csv", 3))


@query(_ORDERED)
def graph_in_parquet(spark, sf_dir):
    return _ordered(_stored(spark, sf_dir, "parquet"))


@query(_ORDERED.replace("floor(o_totalprice)", "floor(CAST(o_totalprice AS FLOAT))"))
def graph_in_tfrecords(spark, sf_dir):
    """Rows as Examples in checksummed records; floats are single there."""
    return _ordered(_stored(spark, sf_dir, "tfrecord"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS order_pos FROM orders),
    l AS (SELECT l_orderkey, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS line_pos FROM lineitem)
    SELECT o_custkey AS custkey, order_pos, line_pos, l_partkey AS partkey, l_suppkey AS suppkey FROM o JOIN l ON l_orderkey = o_orderkey""")
def ragged_examples(spark, sf_dir):
    """A customer as an Example: of each order, of each lineitem, part and supplier; an array of three levels, written and read back."""
    o, li = tpch.read(spark, sf_dir, "orders"), tpch.read(spark, sf_dir, "lineitem")
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    lines = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.array_sort(F.collect_list(line)), lambda x: F.array(x["l_partkey"], x["l_suppkey"])).alias("lines"))
    order = F.struct("o_orderkey", "lines")
    rows = o.join(lines, "o_orderkey", "left").groupBy(F.col("o_custkey").alias("custkey")).agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["lines"]).alias("orders"))
    folder = new_path(spark, "ragged")
    tfrecord.write_examples(rows, folder)
    back = tfrecord.read_examples(spark, folder, {f.name: f.dataType for f in rows.schema.fields}, split_bytes=1 << 20)
    flat = back.select("custkey", F.posexplode("orders").alias("order_pos", "lines")).select("custkey", "order_pos", F.posexplode("lines").alias("line_pos", "ends"))
    return flat.select("custkey", F.col("order_pos").cast("long").alias("order_pos"), F.col("line_pos").cast("long").alias("line_pos"), F.col("ends")[0].alias("partkey"), F.col("ends")[1].alias("suppkey"))


@query("""SELECT event_id, user_id, event_type FROM events""")
def sharded_csv(spark, sf_dir):
    """A table as events-00000-of-00003.csv and so on, read back by events@3.csv."""
    name = f"{new_path(spark, 'shards')}/events@3.csv"
    tables.write_table(tpch.read(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), name)
    return tables.read_table(spark, name, {"event_id": T.LongType(), "user_id": T.LongType(), "event_type": T.StringType()})


@query("""SELECT event_id, value FROM events""")
def sharded_parquet(spark, sf_dir):
    name = f"{new_path(spark, 'shards')}/events@2.parquet"
    tables.write_table(tpch.read(spark, sf_dir, "events").select("event_id", "value"), name)
    return tables.read_table(spark, name)


@query("""SELECT o_orderkey AS source_id, o_custkey AS target_id FROM orders""")
def reversed_edges(spark, sf_dir):
    """An edge set marked as reversed in the schema is loaded with its ends swapped."""
    o, folder = tpch.read(spark, sf_dir, "orders"), new_path(spark, "reversed")
    o.select(F.col("o_custkey").alias("#source"), F.col("o_orderkey").alias("#target")).write.parquet(f"{folder}/placed.parquet")
    o.select(F.col("o_orderkey").alias("#id")).write.parquet(f"{folder}/orders.parquet")
    tpch.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("#id")).write.parquet(f"{folder}/customer.parquet")
    file = lambda n, **more: SetSchema(metadata={"filename": f"{n}.parquet", **more.pop("metadata", {})}, **more)
    s = GraphSchema({"customer": file("customer"), "orders": file("orders")}, {"by": file("placed", source="orders", target="customer", metadata={"edge_type": "reversed"})})
    schemas.write_schema(s, f"{folder}/schema.pbtxt", spark)
    return tables.load_graph(spark, folder)[0].edges["by"].table.select("source_id", "target_id")


@query("""SELECT c_custkey AS node_id, c_mktsegment AS segment FROM customer""")
def tables_by_sql(spark, sf_dir):
    """A set whose schema names a SQL query instead of a file."""
    tpch.read(spark, sf_dir, "customer").createOrReplaceTempView("weft_customer")
    s = SetSchema({"segment": Feature("DT_STRING")}, metadata={"sql": "SELECT c_custkey AS id, c_mktsegment AS segment FROM weft_customer"})
    return tables.node_table(tables.read_set(spark, s, "")).select("node_id", "segment")


@query("""SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS sample_id, CAST(o_custkey AS VARCHAR) AS node_id FROM orders""")
def seeds_from_file(spark, sf_dir):
    name = f"{new_path(spark, 'seeds')}/seeds@2.csv"
    tables.write_table(tpch.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).distinct(), name)
    return tables.read_seeds(spark, name)


@query("""SELECT 'S' || o_custkey || ':T' || o_orderkey AS sample_id, CAST(o_custkey AS VARCHAR) AS source, CAST(o_orderkey AS VARCHAR) AS target, CASE WHEN o_orderstatus = 'F' THEN CAST(1 AS BIGINT) ELSE 0 END AS label FROM orders""")
def link_seeds_from_file(spark, sf_dir):
    """Link seeds with a label; integers stay integers."""
    name = f"{new_path(spark, 'links')}/links@2.csv"
    o = tpch.read(spark, sf_dir, "orders")
    tables.write_table(o.select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("target"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("label")), name)
    return tables.read_link_seeds(spark, name, {"label": T.LongType()})


@query("""SELECT c_custkey AS sample_id, c_custkey AS node_id FROM customer""")
def seeds_from_graph(spark, sf_dir):
    return tables.all_seeds(tpch.catalog(spark, sf_dir), "customer")


@query("""SELECT 'supplier' AS origin, count(*) AS n FROM supplier UNION ALL SELECT 'part', CAST(round(CAST(floor((SELECT count(*) FROM supplier) / 0.25) AS DOUBLE) * 0.5) AS BIGINT)
    UNION ALL SELECT 'customer', CAST(round(CAST(floor((SELECT count(*) FROM supplier) / 0.25) AS DOUBLE) * 0.25) AS BIGINT)""")
def mixed_datasets(spark, sf_dir):
    """Suppliers once, as a quarter; parts and customers repeated or cut to a half and a quarter."""
    own = lambda t, k: tpch.read(spark, sf_dir, t).select(F.lit(t).alias("origin"), F.col(k).alias("key"))
    got = tables.mix_datasets([(own("supplier", "s_suppkey"), 0.25), (own("part", "p_partkey"), 0.5), (own("customer", "c_custkey"), 0.25)])
    return got.groupBy("origin").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, c_mktsegment FROM customer""")
def shuffled_rows(spark, sf_dir):
    return tables.shuffled(tpch.read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), 3)


@query("""WITH c AS (SELECT c_mktsegment AS k, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS i FROM customer),
    o AS (SELECT k, i, row_number() OVER (PARTITION BY k ORDER BY o_orderkey) - 1 AS j FROM orders JOIN c ON o_custkey = c_custkey),
    n AS (SELECT k, count(*) AS orders, CAST(sum(i) AS BIGINT) AS sources, CAST(sum(j) AS BIGINT) AS targets FROM o GROUP BY k), m AS (SELECT k, count(*) AS customers FROM c GROUP BY k)
    SELECT k AS component_id, customers, orders, sources, targets FROM m JOIN n USING (k)""")
def samples_as_examples(spark, sf_dir):
    """Components encoded as Examples of bounded size, with dense indices of ends, and decoded again."""
    encoded = tfrecord.encode_samples(tpch.sales(spark, sf_dir).remove_features(NODES, "orders", "totalprice").remove_features(EDGES, "placed", "weight"), tfrecord.PIECE)
    longs = T.ArrayType(T.LongType())
    got = tfrecord.decode_samples(encoded, {"nodes/customer.#size": longs, "nodes/orders.#size": longs, "edges/placed.#source": longs, "edges/placed.#target": longs})
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    names = {"nodes_customer_size": "customers", "nodes_orders_size": "orders", "edges_placed_source": "sources", "edges_placed_target": "targets"}
    return got.groupBy("component_id").agg(*(F.sum(total(c)).alias(n) for c, n in names.items()))


@query("""SELECT o_orderkey AS edge_id, CAST(0 AS BIGINT) AS tag FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 0""")
def hyper_edges(spark, sf_dir):
    """Hyperedges of an order, its customer and nation: those whose customer isn't among the nodes."""
    g = tpch.catalog(spark, sf_dir)
    o, c = tpch.read(spark, sf_dir, "orders"), tpch.read(spark, sf_dir, "customer")
    table = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.lit(0).cast("long").alias("component_id"), F.col("o_orderkey").alias("edge_id"), F.col("c_custkey").alias("node_0"), F.col("o_orderkey").alias("node_1"), F.col("c_nationkey").cast("long").alias("node_2"))
    h = tools.HyperAdjacency(table, {0: "customer", 1: "orders", 2: "nation"})
    return h.check(g.with_table(NODES, "customer", g.nodes["customer"].where("acctbal >= 0"))).select("edge_id", F.col("tag").cast("long").alias("tag"))


# ---------------------------------------------------------------- schemas


@query("""SELECT 'nodes' AS node_set, 'edges' AS edge_set, count(DISTINCT x) AS nodes, CAST((SELECT count(*) FROM orders) AS BIGINT) AS edges FROM (SELECT 'c' || o_custkey AS x FROM orders UNION SELECT 'o' || o_orderkey FROM orders)""")
def homogeneous_graph(spark, sf_dir):
    """One node set of the edges' ends."""
    e = tpch.read(spark, sf_dir, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("source_id"), F.concat(F.lit("o"), "o_orderkey").alias("target_id"))
    g = PropertyGraph.homogeneous(e)
    names = g.homogeneous_names()
    return g.nodes["nodes"].agg(F.count("*").alias("nodes")).crossJoin(g.edges["edges"].table.agg(F.count("*").alias("edges"))).select(F.lit(names[0]).alias("node_set"), F.lit(names[1]).alias("edge_set"), "nodes", "edges")


@query("""SELECT r_regionkey AS node_id, r_name AS name FROM region""")
def shown_values(spark, sf_dir):
    """The first rows of a graph's tables as values, as the command line prints them."""
    g = PropertyGraph({"region": tpch.catalog(spark, sf_dir).nodes["region"]}, {})
    rows = tools.graph_to_values(g, 20)["nodes"]["region"]
    return _rows(spark, [(int(r["node_id"]), r["name"]) for r in rows], "node_id int, name string")


# ---------------------------------------------------------------- datasets and checks


@query("""SELECT r_regionkey AS key, CAST(3 AS BIGINT) AS times FROM region""")
def repeated_dataset(spark, sf_dir):
    """A dataset repeated, and shared out between two workers."""
    d = tables.Dataset(lambda s: tpch.read(s, sf_dir, "region").select(F.col("r_regionkey").alias("key")), seed=4, times=3)
    both = d.read(spark, 0, 2).unionByName(d.read(spark, 1, 2))
    return both.groupBy("key").agg(F.count("*").alias("times"))

"""Property graphs over the TPC-H-like tables.

``catalog`` is one component: customers, orders, parts, suppliers, nations and regions, with edge sets placed
(customer to orders), contains (orders to part, parallel edges), supplies (supplier to part, distinct), and
customer_in, supplier_in (to nation) and nation_in (to region). ``sales`` has a component for each market
segment: customers, their orders, and placed. Money is decimal, so that sums don't depend on order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.graph import EdgeSet, PropertyGraph

MONEY = "decimal(18,2)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem_id():
    """A lineitem's number: its key isn't unique, so all of its columns count."""
    return F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")


def catalog(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    c, o, p, s = (read(spark, sf_dir, n) for n in ("customer", "orders", "part", "supplier"))
    n, r, li = (read(spark, sf_dir, x) for x in ("nation", "region", "lineitem"))
    nodes = {
        "customer": c.select(F.col("c_custkey").alias("node_id"), F.col("c_acctbal").cast(MONEY).alias("acctbal"), F.col("c_mktsegment").alias("segment")),
        "orders": o.select(F.col("o_orderkey").alias("node_id"), F.col("o_totalprice").cast(MONEY).alias("totalprice"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("ts")),
        "part": p.select(F.col("p_partkey").alias("node_id"), F.col("p_retailprice").cast(MONEY).alias("retailprice"), F.col("p_size").alias("size"), F.col("p_brand").alias("brand")),
        "supplier": s.select(F.col("s_suppkey").alias("node_id"), F.col("s_acctbal").cast(MONEY).alias("acctbal")),
        "nation": n.select(F.col("n_nationkey").cast("long").alias("node_id"), F.col("n_name").alias("name")),
        "region": r.select(F.col("r_regionkey").cast("long").alias("node_id"), F.col("r_name").alias("name")),
    }
    ends = lambda df, a, b, *more: df.select(F.col(a).cast("long").alias("source_id"), F.col(b).cast("long").alias("target_id"), *more)
    edges = {
        "placed": (ends(o, "o_custkey", "o_orderkey", F.col("o_orderkey").alias("edge_id"), F.col("o_totalprice").cast(MONEY).alias("weight"), F.col("o_orderdate").alias("ts")), "customer", "orders"),
        "contains": (ends(li, "l_orderkey", "l_partkey", lineitem_id().alias("edge_id"), F.col("l_quantity").cast("long").alias("quantity"), F.col("l_extendedprice").cast(MONEY).alias("price"), F.col("l_discount").cast(MONEY).alias("discount")), "orders", "part"),
        "supplies": (ends(li, "l_suppkey", "l_partkey").distinct().withColumn("edge_id", F.col("source_id") * 1_000_000_000 + F.col("target_id")), "supplier", "part"),
        "customer_in": (ends(c, "c_custkey", "c_nationkey", F.col("c_custkey").alias("edge_id"), F.col("c_acctbal").cast(MONEY).alias("weight")), "customer", "nation"),
        "supplier_in": (ends(s, "s_suppkey", "s_nationkey", F.col("s_suppkey").alias("edge_id"), F.col("s_acctbal").cast(MONEY).alias("weight")), "supplier", "nation"),
        "nation_in": (ends(n, "n_nationkey", "n_regionkey", F.col("n_nationkey").cast("long").alias("edge_id")), "nation", "region"),
    }
    return PropertyGraph.of(nodes, edges)


def sales(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    customer = c.select(F.col("c_mktsegment").alias("component_id"), F.col("c_custkey").alias("node_id"), F.col("c_acctbal").cast(MONEY).alias("acctbal"))
    by = c.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("component_id"))
    placed = o.join(by, "o_custkey")
    orders = placed.select("component_id", F.col("o_orderkey").alias("node_id"), F.col("o_totalprice").cast(MONEY).alias("totalprice"))
    edges = placed.select("component_id", F.col("o_orderkey").alias("edge_id"), F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("target_id"), F.col("o_totalprice").cast(MONEY).alias("weight"))
    context = customer.groupBy("component_id").agg(F.count("*").alias("customers"))
    return PropertyGraph({"customer": customer, "orders": orders}, {"placed": EdgeSet(edges, "customer", "orders")}, context)


def events_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Users (a latent node set), event types, and ``did`` edges with times."""
    e = read(spark, sf_dir, "events")
    did = e.select(F.lit(0).cast("long").alias("component_id"), F.col("event_id").alias("edge_id"), F.col("user_id").alias("source_id"), F.col("event_type").alias("target_id"), "ts", F.col("value").alias("weight"))
    return PropertyGraph.of({"user": e.select(F.col("user_id").alias("node_id")).distinct(), "type": e.select(F.col("event_type").alias("node_id")).distinct()}, {"did": (did, "user", "type")})

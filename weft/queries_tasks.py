"""Queries of prediction tasks: each problem at each level, over a component for every customer. Added to weft.queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft import tpch
from weft.graph import EdgeSet, PropertyGraph
from weft.operators import tasks
from weft.queries import query

#: Predictions and labels of orders (t, and l of three classes) and customers (c) in SQL: h is an order's price in 100,000s.
_BASE = """WITH o AS (SELECT o_custkey AS k, o_orderkey, o_totalprice / 100000 AS h, o_orderkey % 3 AS l, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
    g AS (SELECT c_custkey AS k, coalesce(avg(h), 0) AS p, any_value(c_acctbal) / 5000 AS y, any_value(c_custkey) % 3 AS l FROM customer LEFT JOIN o ON k = c_custkey GROUP BY c_custkey),"""
_LEVELS = {
    "graph": "x AS (SELECT p, y, l FROM g)",
    "root": "x AS (SELECT h AS p, CAST(i0 AS DOUBLE) / 4 AS y, l FROM (SELECT *, o_orderkey % 7 AS i0 FROM o WHERE i = 1))",
    "readout": "x AS (SELECT h AS p, CAST(o_orderkey % 7 AS DOUBLE) / 4 AS y, l FROM o)",
}
_SMALL = lambda x: f"CAST(floor(({x}) * 100000 + 0.123) AS BIGINT)"
_REGRESSION = {
    "mae": "avg(abs(y - p))", "mape": "avg(abs((y - p) / greatest(abs(y), 1e-7::DOUBLE))) / 1e6", "mse": "avg((y - p) * (y - p))",
    "msle": "avg((ln(1 + greatest(y, 0)) - ln(1 + greatest(p, 0))) ** 2)", "mse_log_scaled": "avg((y - greatest(p, 0)) ** 2 + (ln(1 + greatest(y, 0)) - ln(1 + greatest(p, 0))) ** 2)",
}


def _regression_sql(level: str) -> str:
    return f"{_BASE} {_LEVELS[level]} " + " UNION ALL ".join(f"SELECT '{m}' AS metric, {_SMALL(x)} AS value FROM x" for m, x in _REGRESSION.items())


def _binary_sql(level: str) -> str:
    """Logits are p - 1.5, labels y > 0.7."""
    return f"""{_BASE} {_LEVELS[level]}, b AS (SELECT CASE WHEN y > 0.7 THEN 1 ELSE 0 END AS y, p - 1.5 AS z FROM x), t AS (SELECT CAST(sum(y) AS DOUBLE) AS yes, CAST(sum(1 - y) AS DOUBLE) AS no FROM b),
        s AS (SELECT z, sum(y) AS p, sum(1 - y) AS n FROM b GROUP BY z), c AS (SELECT *, CAST(sum(p) OVER (ORDER BY z DESC) AS DOUBLE) AS tp, CAST(sum(n) OVER (ORDER BY z DESC) AS DOUBLE) AS fp FROM s),
        h AS (SELECT CAST(sum(y * CAST(z > 0 AS INT)) AS DOUBLE) AS tp, CAST(sum(CAST(z > 0 AS INT)) AS DOUBLE) AS said, avg(CASE WHEN (y = 1) = (z > 0) THEN 1.0 ELSE 0.0 END) AS hit, avg(greatest(z, 0) - z * y + ln(1 + exp(-abs(z)))) AS ce FROM b)
        SELECT 'accuracy' AS metric, {_SMALL("hit")} AS value FROM h UNION ALL SELECT 'precision', {_SMALL("CASE WHEN said > 0 THEN tp / said ELSE 0 END")} FROM h UNION ALL SELECT 'recall', {_SMALL("tp / yes")} FROM h, t UNION ALL SELECT 'cross_entropy', {_SMALL("ce")} FROM h
        UNION ALL SELECT 'auc_roc', {_SMALL("sum(n * (tp - p / 2.0)) / any_value(yes) / any_value(no)")} FROM c, t UNION ALL SELECT 'auc_pr', {_SMALL("sum(p * tp / (tp + fp)) / any_value(yes)")} FROM c, t
        UNION ALL SELECT 'recall_at_precision', {_SMALL("coalesce(max(CASE WHEN tp / (tp + fp) >= 0.8 THEN tp / yes END), 0)")} FROM c, t"""


def _multiclass_sql(level: str) -> str:
    """Logits are 1.5 - p, p / 4 and p - 1.5; labels l."""
    return f"""{_BASE} {_LEVELS[level]}, z AS (SELECT l, [1.5 - p, p / 4, p - 1.5] AS z FROM x), q AS (SELECT l, z, list_position(z, list_max(z)) - 1 AS c FROM z),
        k AS (SELECT DISTINCT l AS c FROM q UNION SELECT DISTINCT c FROM q)
        SELECT 'accuracy' AS metric, {_SMALL("avg(CASE WHEN l = c THEN 1.0 ELSE 0.0 END)")} AS value FROM q
        UNION ALL SELECT 'cross_entropy', {_SMALL("avg(ln(exp(z[1] - list_max(z)) + exp(z[2] - list_max(z)) + exp(z[3] - list_max(z))) + list_max(z) - z[l + 1])")} FROM q
        UNION ALL SELECT 'precision_' || k.c, {_SMALL("coalesce((SELECT avg(CASE WHEN q.l = q.c THEN 1.0 ELSE 0.0 END) FROM q WHERE q.c = k.c), 0)")} FROM k
        UNION ALL SELECT 'recall_' || k.c, {_SMALL("coalesce((SELECT avg(CASE WHEN q.l = q.c THEN 1.0 ELSE 0.0 END) FROM q WHERE q.l = k.c), 0)")} FROM k"""


def _customers(spark: SparkSession, sf_dir: str, some: bool) -> PropertyGraph:
    """A component for every customer (with orders, if ``some``) of its orders, each also a readout node."""
    o, c = tpch.read(spark, sf_dir, "orders"), tpch.read(spark, sf_dir, "customer")
    h = F.col("o_totalprice") / 100000
    logits = lambda p: F.array(1.5 - p, p / 4, p - 1.5)
    nodes = o.select(F.col("o_custkey").alias("component_id"), F.col("o_orderkey").alias("node_id"), h.alias("p"), (h - 1.5).alias("z"), logits(h).alias("zs"), ((F.col("o_orderkey") % 7).cast("double") / 4).alias("y"), ((F.col("o_orderkey") % 7).cast("double") / 4 > 0.7).cast("int").alias("yes"), (F.col("o_orderkey") % 3).alias("l"))
    edges = nodes.select("component_id", F.col("node_id").alias("edge_id"), F.col("node_id").alias("source_id"), F.col("node_id").alias("target_id"))
    y = F.col("c_acctbal") / 5000
    context = c.select(F.col("c_custkey").alias("component_id"), y.alias("y"), (y > 0.7).cast("int").alias("yes"), (F.col("c_custkey") % 3).alias("l"))
    context = context.join(nodes.select("component_id").distinct(), "component_id", "left_semi") if some else context
    return PropertyGraph({"order": nodes, "_readout": nodes.select("component_id", "node_id")}, {"_readout/seed": EdgeSet(edges, "order", "_readout")}, context)


def _evaluated(spark: SparkSession, sf_dir: str, problem: str, level: str) -> DataFrame:
    g = _customers(spark, sf_dir, level == tasks.ROOT)
    prediction, label = {tasks.BINARY: ("z", "yes"), tasks.MULTICLASS: ("zs", "l"), tasks.REGRESSION: ("p", "y")}[problem]
    if level != tasks.GRAPH:
        out = tasks.Task(problem, level, prediction, label, "order", "seed").evaluate(g)
    elif problem == tasks.REGRESSION:
        out = tasks.Task(problem, level, "p", "y", "order").evaluate(g)
    else:
        # customers without orders pool to 0, so logits are made of what is pooled
        both = tasks.Task(problem, level, "p", label, "order").labelled(g)
        p = F.col("prediction")
        both = both.withColumn("prediction", p - 1.5 if problem == tasks.BINARY else F.array(1.5 - p, p / 4, p - 1.5))
        pooled = PropertyGraph({"one": both.select("component_id", F.lit(0).cast("long").alias("node_id"), "prediction", "label")}, {})
        out = tasks.Task(problem, tasks.ROOT, "prediction", "label", "one").evaluate(pooled)
    value = F.when(F.col("metric") == "mape", F.col("value") / 1e8).otherwise(F.col("value"))
    return out.select("metric", F.floor(value * 100_000 + 0.123).alias("value"))


def _add(problem: str, level: str, sql: str) -> None:
    def fn(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _evaluated(spark, sf_dir, problem, level)

    fn.__name__ = f"{level}_{problem}_task"
    query(sql)(fn)


for _level in _LEVELS:
    _add(tasks.REGRESSION, _level, _regression_sql(_level))
    _add(tasks.BINARY, _level, _binary_sql(_level))
    _add(tasks.MULTICLASS, _level, _multiclass_sql(_level))


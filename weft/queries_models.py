"""Queries of sampling variants, ragged rows, sizes, metrics, losses and layers. Added to weft.queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft import tpch
from weft.functions import ragged
from weft.graph import EdgeSet, PropertyGraph
from weft.operators import batching, layers, message, metrics, readout, structure
from weft.plans import sample as sampling
from weft.plans.spec import TOP_K, UNIFORM, SpecBuilder, topological_order
from weft.queries import _double, _schema, _seeds, _states, query
from weft.schema import CONTEXT, EDGES, NODES, SOURCE, TARGET


def _thousandths(c, name: str = "a"):
    return F.floor(c * 1000 + 0.123).alias(name)


# ---------------------------------------------------------------- sampling as of a time, and merged frontiers

_AS_OF = "TIMESTAMP '1996-06-01'"


@query(f"""SELECT sample_id, edge_id FROM (SELECT c_custkey AS sample_id, o_orderkey AS edge_id, row_number() OVER (PARTITION BY c_custkey ORDER BY md5('2|customer->orders|' || c_custkey || '|' || c_custkey || '|' || o_orderkey)) AS r
    FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderdate <= {_AS_OF}) WHERE r <= 3""")
def sample_temporal_uniform(spark, sf_dir):
    """Edges later than a sample's time aren't drawn."""
    g, schema = _schema(spark, sf_dir)
    spec = SpecBuilder(schema).seed("customer").sample("placed", 3, UNIFORM, "customer->orders").build()
    seeds = _seeds(g).withColumn("as_of", F.lit("1996-06-01").cast("timestamp"))
    return sampling.sample_edges(g, spec, seeds, 2)["placed"].select("sample_id", "edge_id")


@query(f"""SELECT sample_id, edge_id FROM (SELECT c_custkey AS sample_id, o_orderkey AS edge_id, row_number() OVER (PARTITION BY c_custkey ORDER BY CAST(o_totalprice AS DECIMAL(18,2)) DESC, o_orderkey) AS r
    FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderdate <= {_AS_OF}) WHERE r <= 2""")
def sample_temporal_top_k(spark, sf_dir):
    g, schema = _schema(spark, sf_dir)
    spec = SpecBuilder(schema).seed("customer").sample("placed", 2, TOP_K).build()
    return sampling.sample_edges(g, spec, _seeds(g).withColumn("as_of", F.lit("1996-06-01").cast("timestamp")))["placed"].select("sample_id", "edge_id")


@query("""WITH n AS (SELECT c_custkey AS k, c_nationkey AS n FROM customer UNION SELECT c_custkey, s_nationkey FROM customer JOIN supplier ON s_suppkey = c_custkey)
    SELECT k AS sample_id, CAST(n AS BIGINT) AS edge_id FROM n""")
def sample_merged_frontiers(spark, sf_dir):
    """Two ways to nations, merged before the next hop: a customer's own, and that of the supplier with its number."""
    g, _ = _schema(spark, sf_dir)
    twin = g.nodes["customer"].join(g.nodes["supplier"].select("node_id"), "node_id").select("component_id", F.col("node_id").alias("source_id"), F.col("node_id").alias("target_id"), F.col("node_id").alias("edge_id"), F.lit(1.0).alias("weight"))
    g = g.with_edges("twin", twin, "customer", "supplier")
    g = g.with_table(EDGES, "nation_in", g.edges["nation_in"].table.withColumn("weight", F.lit(1.0)))
    seed = SpecBuilder(g.schema()).seed("customer")
    spec = seed.sample("customer_in", 1, TOP_K).merge_then_sample([seed.sample(["twin", "supplier_in"], 1, TOP_K)], "nation_in", 5, TOP_K).build()
    return sampling.sample_edges(g, spec, _seeds(g))["nation_in"].select("sample_id", "edge_id")


@query("""SELECT c_custkey AS sample_id, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def sample_whole_neighborhoods(spark, sf_dir):
    """More asked for than there are: all edges."""
    g, schema = _schema(spark, sf_dir)
    spec = SpecBuilder(schema).seed("customer").sample("placed", 1000, UNIFORM).build()
    return sampling.sample_edges(g, spec, _seeds(g))["placed"].groupBy("sample_id").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- ragged rows


@query("""SELECT o_custkey AS row_id, o_orderkey AS value, row_number() OVER (PARTITION BY o_custkey ORDER BY md5('4|' || o_custkey || '|' || o_orderkey)) - 1 AS pos FROM orders""")
def ragged_shuffle(spark, sf_dir):
    rows = tpch.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("row_id"), F.col("o_orderkey").alias("value"), F.col("o_orderkey").alias("pos"))
    return ragged.shuffle_within(rows, 4)


@query("""SELECT n_regionkey AS region, CAST(count(*) AS BIGINT) AS n FROM nation GROUP BY 1""")
def ragged_row_ids(spark, sf_dir):
    """Lengths of rows as a row number for each value."""
    n = tpch.read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count("*").cast("int").alias("n"))
    lengths = n.agg(F.transform(F.array_sort(F.collect_list(F.struct("n_regionkey", "n"))), lambda x: x.n).alias("lengths"))
    return lengths.select(F.explode(ragged.row_ids(F.col("lengths"))).alias("region")).groupBy("region").agg(F.count("*").alias("n"))


@query("""WITH v AS (SELECT o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY min(o_orderkey)) - 1 AS i FROM orders GROUP BY 1, 2),
    f AS (SELECT o_custkey, sum(count(*)) OVER (ORDER BY o_custkey) - count(*) AS f FROM v GROUP BY 1)
    SELECT o_orderkey AS pos, CAST(i + f AS BIGINT) AS index FROM orders JOIN v USING (o_custkey, o_orderstatus) JOIN f USING (o_custkey)""")
def ragged_global_lookup(spark, sf_dir):
    rows = tpch.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("row_id"), F.col("o_orderstatus").alias("value"), F.col("o_orderkey").alias("pos"))
    return ragged.lookup(rows, ragged.unique(rows), True).select("pos", "index")


# ---------------------------------------------------------------- pooling and readout


@query("""WITH e AS (SELECT c_nationkey AS k, CASE WHEN c_acctbal > 9000 THEN 2.0 ELSE 1.0 END AS v FROM customer UNION ALL SELECT s_nationkey, CASE WHEN s_acctbal > 9000 THEN 2.0 ELSE 1.0 END FROM supplier)
    SELECT CAST(n_nationkey AS BIGINT) AS node_id, CAST(coalesce(product(v), 1) AS DOUBLE) AS value FROM nation LEFT JOIN e ON n_nationkey = k GROUP BY n_nationkey""")
def pool_multi_prod(spark, sf_dir):
    g = tpch.catalog(spark, sf_dir)
    for n in ("customer_in", "supplier_in"):
        g = g.with_table(EDGES, n, g.edges[n].table.withColumn("f", F.when(F.col("weight") > 9000, 2.0).otherwise(1.0)))
    return message.pool(g, TARGET, edge_sets=["customer_in", "supplier_in"], reduce="prod", feature="f").select("node_id", "value")


@query("""SELECT CAST(0 AS BIGINT) AS component_id, n_nationkey AS node_id, CAST(count(c_custkey) AS BIGINT) AS hits FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey HAVING count(c_custkey) <> 1""")
def readout_checks(spark, sf_dir):
    """Readout nodes that a key doesn't hit exactly once."""
    g = tpch.catalog(spark, sf_dir)
    g = g.with_table(NODES, "_readout", g.nodes["nation"].select("component_id", "node_id"))
    g = g.with_edges("_readout/who", g.edges["customer_in"].table.drop("weight"), "customer", "_readout")
    readout.check_readout_schema(g)
    return readout.check_readout(g, "who").select("component_id", F.col("node_id").cast("int").alias("node_id"), "hits")


@query("""SELECT o_orderkey AS node_id, CAST(o_totalprice AS DOUBLE) AS value FROM orders""")
def readout_of_edges(spark, sf_dir):
    """Features of edges, through a shadow node set."""
    g = tpch.catalog(spark, sf_dir)
    g = g.with_table(NODES, "_readout", g.nodes["orders"].select("component_id", "node_id"))
    e = g.edges["placed"].table.select("component_id", "edge_id", F.col("edge_id").alias("source_id"), F.col("target_id"))
    g = g.with_edges("_readout/price", e, "_shadow/placed", "_readout")
    return _double(readout.structured_readout(g, "price", "weight").select("node_id", "value"), "value")


# ---------------------------------------------------------------- sizes

_SIZES = "SELECT c_mktsegment AS k, count(DISTINCT c_custkey) AS c, count(o_orderkey) AS o FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1"


@query(f"""WITH s AS ({_SIZES}) SELECT k AS component_id, c AS customers, o AS orders FROM s WHERE o <= (SELECT avg(o) FROM s)""")
def fit_or_skip(spark, sf_dir):
    """Components that a budget doesn't fit are dropped whole."""
    g = tpch.sales(spark, sf_dir)
    mean = g.nodes["orders"].count() / g.context().count()
    kept = batching.FitOrSkip(batching.SizeConstraints(1, {"orders": int(mean)}))(g)
    c = batching.size_columns(kept)
    return batching.sizes(kept).select("component_id", F.col(c[NODES, "customer"]).alias("customers"), F.col(c[NODES, "orders"]).alias("orders"))


@query(f"""WITH s AS ({_SIZES}) SELECT CAST(5 AS BIGINT) AS components, CAST(4 * max(c) + 1 AS BIGINT) AS customer, CAST(4 * max(o) + 1 AS BIGINT) AS orders FROM s""")
def tight_padding(spark, sf_dir):
    limits = batching.Tight(4).limits(tpch.sales(spark, sf_dir))
    return spark.createDataFrame([(limits.components, limits.nodes["customer"], limits.nodes["orders"])], "components long, customer long, orders long")


@query(f"""WITH s AS ({_SIZES}) SELECT true AS fits_largest, true AS below_all, CAST(3 AS BIGINT) AS components FROM s LIMIT 1""")
def learned_constraints(spark, sf_dir):
    """A learned budget of batches of two: not more than twice the largest component, and not less than the smallest."""
    g = tpch.sales(spark, sf_dir)
    limits, c = batching.learn_constraints(g, 2, 0.9, 200, 7), batching.size_columns(g)
    top = batching.sizes(g).agg(F.max(c[NODES, "orders"]).alias("hi"), F.min(c[NODES, "orders"]).alias("lo"))
    n = limits.nodes["orders"]
    return top.select((F.lit(n) >= F.col("lo")).alias("fits_largest"), (F.lit(n) <= 2 * F.col("hi") + 1).alias("below_all"), F.lit(limits.components).cast("long").alias("components"))


@query("""SELECT count(*) AS kept FROM orders WHERE o_totalprice > 100000""")
def filtered_with_summary(spark, sf_dir):
    """Rows that pass a filter, which counts what it sees."""
    kept, _ = batching.filter_observed(tpch.read(spark, sf_dir, "orders"), F.col("o_totalprice") > 100000, "orders")
    return kept.agg(F.count("*").alias("kept"))


@query("""SELECT n + d AS customers, k + e AS components, n <= n + d AND k <= k + e AS fits FROM (SELECT count(*) AS n, count(DISTINCT c_mktsegment) AS k FROM customer), (VALUES (-1), (0), (7)) a(d), (VALUES (-1), (0), (1)) b(e)""")
def fits_in_total(spark, sf_dir):
    """Budgets of customers and components around what there are, and whether the whole graph fits."""
    g = tpch.sales(spark, sf_dir)
    n, k = g.nodes["customer"].count(), g.context().count()
    rows = [(n + d, k + e, batching.satisfies_total(g, batching.SizeConstraints(k + e, {"customer": n + d}))) for d in (-1, 0, 7) for e in (-1, 0, 1)]
    return spark.createDataFrame(rows, "customers long, components long, fits boolean")


# ---------------------------------------------------------------- metrics and losses


@query("""WITH x AS (SELECT CAST(l_quantity AS DOUBLE) AS y, CAST(l_linenumber AS DOUBLE) * 6 AS p FROM lineitem)
    SELECT CAST(floor(avg(abs((y - p) / y)) * 100000 + 0.123) AS BIGINT) AS mape, CAST(floor(avg((ln(1 + y) - ln(1 + p)) ** 2) * 1000000 + 0.123) AS BIGINT) AS msle,
    CAST(floor((avg((y - p) * (y - p)) + avg((ln(y + 1) - ln(p + 1)) ** 2)) * 1000 + 0.123) AS BIGINT) AS mse_log_scaled FROM x""")
def regression_losses_relative(spark, sf_dir):
    li = tpch.read(spark, sf_dir, "lineitem").select("l_quantity", (F.col("l_linenumber") * 6).alias("p"))
    out = metrics.regression_losses(li, "l_quantity", "p")
    return out.select(F.floor(F.col("mape") * 1000 + 0.123).alias("mape"), F.floor(F.col("msle") * 1_000_000 + 0.123).alias("msle"), _thousandths(F.col("mse_log_scaled"), "mse_log_scaled"))


@query("""WITH x AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, CAST(l_quantity - 25 AS DOUBLE) / 10 + CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS z FROM lineitem),
    s AS (SELECT z, sum(y) AS p, sum(1 - y) AS n FROM x GROUP BY z), c AS (SELECT *, sum(p) OVER (ORDER BY z DESC) AS tp, sum(n) OVER (ORDER BY z DESC) AS fp FROM s), t AS (SELECT sum(y) AS yes, sum(1 - y) AS no FROM x)
    SELECT CAST(floor(sum(n * (tp - p / 2.0)) / any_value(yes) / any_value(no) * 1000000 + 0.123) AS BIGINT) AS auc_roc, CAST(floor(sum(p * tp / CAST(tp + fp AS DOUBLE)) / any_value(yes) * 1000000 + 0.123) AS BIGINT) AS auc_pr,
    CAST(floor(coalesce(max(CASE WHEN tp / CAST(tp + fp AS DOUBLE) >= 0.5 THEN tp / CAST(yes AS DOUBLE) END), 0) * 1000000 + 0.123) AS BIGINT) AS recall_at_precision,
    (SELECT CAST(floor(avg(greatest(z, 0) - z * y + ln(1 + exp(-abs(z)))) * 1000000 + 0.123) AS BIGINT) FROM x) AS cross_entropy FROM c, t""")
def binary_curves(spark, sf_dir):
    """Areas under curves, recall at a precision, and cross-entropy from logits."""
    r = (F.col("l_returnflag") == "R").cast("int")
    li = tpch.read(spark, sf_dir, "lineitem").select(r.alias("y"), ((F.col("l_quantity") - 25).cast("double") / 10 + r).alias("z"))
    out = metrics.binary_metrics(li, "y", "z", at_precision=0.5)
    return out.select(*(F.floor(F.col(c) * 1_000_000 + 0.123).alias(c) for c in ("auc_roc", "auc_pr", "recall_at_precision", "cross_entropy")))


_LOGITS = """WITH x AS (SELECT l_linenumber % 3 AS y, [CAST(l_quantity % 7 AS DOUBLE), CAST(l_quantity % 5 AS DOUBLE) + 0.5, CAST(l_linenumber AS DOUBLE)] AS z FROM lineitem),
    p AS (SELECT y, z, list_position(z, list_max(z)) - 1 AS p FROM x)"""


def _logits(spark, sf_dir) -> DataFrame:
    li = tpch.read(spark, sf_dir, "lineitem")
    q = F.col("l_quantity")
    return li.select((F.col("l_linenumber") % 3).alias("y"), F.array((q % 7).cast("double"), (q % 5).cast("double") + 0.5, F.col("l_linenumber").cast("double")).alias("z"))


@query(_LOGITS + """ SELECT CAST(sum(CASE WHEN y = p THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS accuracy,
    CAST(floor(avg(ln(exp(z[1] - list_max(z)) + exp(z[2] - list_max(z)) + exp(z[3] - list_max(z))) + list_max(z) - z[y + 1]) * 1000000 + 0.123) AS BIGINT) AS cross_entropy FROM p""")
def multiclass_metrics(spark, sf_dir):
    head, _ = metrics.multiclass_metrics(_logits(spark, sf_dir), "y", "z")
    return head.select("accuracy", F.floor(F.col("cross_entropy") * 1_000_000 + 0.123).alias("cross_entropy"))


@query(_LOGITS + """, k AS (SELECT DISTINCT y AS c FROM p UNION SELECT DISTINCT p FROM p)
    SELECT CAST(c AS BIGINT) AS class, coalesce((SELECT CAST(sum(CASE WHEN y = p THEN 1 ELSE 0 END) AS DOUBLE) / count(*) FROM p WHERE p = c), 0.0) AS precision,
    coalesce((SELECT CAST(sum(CASE WHEN y = p THEN 1 ELSE 0 END) AS DOUBLE) / count(*) FROM p WHERE y = c), 0.0) AS recall FROM k""")
def multiclass_by_class(spark, sf_dir):
    return metrics.multiclass_metrics(_logits(spark, sf_dir), "y", "z")[1]


_ROOTS = """WITH r AS (SELECT c_mktsegment AS k, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS i FROM customer), t AS (SELECT c_mktsegment AS k, avg(c_acctbal) AS m FROM customer GROUP BY 1)"""


@query(_ROOTS + """ SELECT CAST(floor(avg(abs(c_acctbal - m)) * 1000 + 0.123) AS BIGINT) AS mae, CAST(floor(avg((c_acctbal - m) ** 2) + 0.123) AS BIGINT) AS mse FROM r JOIN t USING (k) WHERE i = 1""")
def root_node_regression(spark, sf_dir):
    """Labels of root nodes against their component's mean, read out and scored."""
    g = tpch.sales(spark, sf_dir)
    g = g.with_table(NODES, "customer", g.nodes["customer"].withColumn("acctbal", F.col("acctbal").cast("double")))
    label = structure.first_node(g, "customer", "acctbal", "label")
    guess = message.pool_nodes_to_context(g, "customer", "mean", feature="acctbal")
    out = metrics.regression_losses(label.join(guess, "component_id"), "label", "value")
    return out.select(_thousandths(F.col("mae"), "mae"), F.floor(F.col("mse") + 0.123).alias("mse"))


@query(_ROOTS + """ SELECT CAST(sum(CASE WHEN (c_acctbal > 0) = (m > 4000) THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS accuracy FROM r JOIN t USING (k) WHERE i = 1""")
def root_node_classification(spark, sf_dir):
    g = tpch.sales(spark, sf_dir)
    g = g.with_table(NODES, "customer", g.nodes["customer"].withColumn("acctbal", F.col("acctbal").cast("double")))
    label = structure.first_node(g, "customer", "acctbal", "label")
    guess = message.pool_nodes_to_context(g, "customer", "mean", feature="acctbal")
    both = label.join(guess, "component_id").select(F.col("label"), (F.col("value") - 4000).alias("logit"))
    return metrics.binary_metrics(both, "label", "logit").select("accuracy")


@query("""WITH t AS (SELECT c_mktsegment AS k, count(*) AS n, CAST(sum(CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS f FROM customer GROUP BY 1)
    SELECT CAST(floor(avg(abs(f - 0.5)) * 1000000 + 0.123) AS BIGINT) AS mae FROM t""")
def graph_regression(spark, sf_dir):
    """A value of each whole graph: nodes pooled to the context."""
    g = tpch.sales(spark, sf_dir)
    g = g.with_table(NODES, "customer", g.nodes["customer"].withColumn("rich", F.when(F.col("acctbal") > 5000, 1.0).otherwise(0.0)))
    got = message.pool_nodes_to_context(g, "customer", "mean", feature="rich").withColumn("label", F.lit(0.5))
    return metrics.regression_losses(got, "label", "value").select(F.floor(F.col("mae") * 1_000_000 + 0.123).alias("mae"))


@query("""WITH e AS (SELECT a.vec_id, list_transform(range(1, 65), lambda i: CAST(a.embedding[i] AS DOUBLE) - b.embedding[i]) AS p, list_transform(range(1, 65), lambda i: CAST(a.embedding[i] AS DOUBLE) - c.embedding[i]) AS n
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 JOIN embeddings c ON c.vec_id = a.vec_id + 2)
    SELECT vec_id, CAST(floor(list_dot_product(p, p) / 64 * 1000000 + 0.123) AS BIGINT) AS positive, CAST(floor(list_dot_product(n, n) / 64 * 1000000 + 0.123) AS BIGINT) AS negative FROM e""")
def triplet_distances(spark, sf_dir):
    e = tpch.read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    other = lambda k, name: e.select((F.col("vec_id") - k).alias("vec_id"), F.col("embedding").alias(name))
    out = metrics.triplet_distances(e.join(other(1, "p"), "vec_id").join(other(2, "n"), "vec_id"), "embedding", "p", "n", 64)
    return out.select("vec_id", F.floor(F.col("d_positive") * 1_000_000 + 0.123).alias("positive"), F.floor(F.col("d_negative") * 1_000_000 + 0.123).alias("negative"))


#: A given matrix: 2 on the diagonal and 0.5 right of it.
_INFOMAX = [[2.0 if i == j else 0.5 if j == i + 1 else 0.0 for j in range(64)] for i in range(64)]
_INFOMAX_SQL = """WITH m AS (SELECT i, 1 / (1 + exp(-avg(CAST(embedding[i] AS DOUBLE)))) AS s FROM embeddings, range(1, 65) t(i) GROUP BY i), v AS (SELECT a.i, 2 * a.s + 0.5 * coalesce(b.s, 0) AS v FROM m AS a LEFT JOIN m AS b ON b.i = a.i + 1),
    z AS (SELECT vec_id, sum(CAST(embedding[i] AS DOUBLE) * v) AS z, sum(CAST(embedding[65 - i] AS DOUBLE) * v) AS r FROM embeddings, v GROUP BY vec_id)"""


@query(_INFOMAX_SQL + """ SELECT vec_id, CAST(floor(z * 1000000 + 0.123) AS BIGINT) AS logit FROM z""")
def infomax_logits(spark, sf_dir):
    """Each row against the sigmoid of the mean row, through a given matrix."""
    e = tpch.read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("x"))
    return metrics.infomax_logits(e, "x", _INFOMAX, 64).select("vec_id", F.floor(F.col("logit") * 1_000_000 + 0.123).alias("logit"))


@query("""SELECT p_partkey AS node_id, CAST(2 * (p_size - 10) AS DOUBLE) AS size FROM part""")
def integrated_gradients(spark, sf_dir):
    """Attributions of a linear model against a baseline."""
    p = tpch.catalog(spark, sf_dir).nodes["part"].select("node_id", F.col("size").cast("double").alias("size"))
    return metrics.integrated_gradients_linear(p, p.withColumn("size", F.lit(10.0)), ["node_id"], {"size": 2.0})


@query("""WITH e AS (SELECT CAST(min(p_size) AS DOUBLE) AS lo, CAST(max(p_size) AS DOUBLE) AS hi FROM part)
    SELECT p_partkey AS node_id, CAST(floor((lo + (hi - lo) * (CAST(CAST('0x' || substr(md5('3|size|0|' || p_partkey), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0)) * 1000 + 0.123) AS BIGINT) AS size FROM part, e""")
def counterfactual_draws(spark, sf_dir):
    """Sizes of parts drawn between the least and the largest, by the parts' keys alone; in thousandths."""
    p = tpch.catalog(spark, sf_dir).nodes["part"].select("component_id", "node_id", F.col("size").cast("double").alias("size"))
    return metrics.counterfactual(p, ["size"], random=True, seed=3).select("node_id", F.floor(F.col("size") * 1000 + 0.123).alias("size"))


_U = "CAST(CAST('0x' || substr(md5('9|0|' || p_partkey), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0"


@query(f"""SELECT p_partkey AS node_id, CASE WHEN {_U} < 0.25 THEN 0.0 ELSE p_size * (1 / 0.75) END AS size FROM part""")
def item_dropout(spark, sf_dir):
    """Whole items are dropped at a rate, drawn by key."""
    p = tpch.catalog(spark, sf_dir).nodes["part"].select("component_id", "node_id", F.col("size").cast("double").alias("size"))
    return layers.item_dropout(p, ["size"], 0.25, ["component_id", "node_id"], 9).select("node_id", "size")


# ---------------------------------------------------------------- layers


@query("""SELECT o_orderkey AS node_id, CAST(greatest(1 + coalesce(sum(p_size), 0) - 100, 0) AS DOUBLE) AS a, CAST(floor(CAST(o_totalprice AS DECIMAL(18,2)) / 100000) AS DOUBLE) AS b
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey GROUP BY o_orderkey, o_totalprice""")
def residual_next_state(spark, sf_dir):
    """relu(dense(state ++ pooled) + state)."""
    g = _states(spark, sf_dir)
    m = layers.simple_conv(g, "contains", layers.Dense([[1], [0]]), SOURCE)
    out = layers.next_state_residual(g.nodes["orders"], [m], layers.Dense([[0, 0], [0, 0], [1, 0]], [-100, 0]))
    return out.select("node_id", *(F.col("value")[i].alias(c) for i, c in enumerate("ab")))


@query("""SELECT o_orderkey AS node_id, CAST(coalesce(sum(p_size), 0) AS DOUBLE) AS a FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def single_input_state(spark, sf_dir):
    """A node set's new state is its only input."""
    conv = lambda g, n, tag: layers.simple_conv(g, n, layers.Dense([[1], [0]]), tag)
    g = _states(spark, sf_dir)
    g = PropertyGraph(g.nodes, {"contains": g.edges["contains"]}, g.context_table)
    out = layers.conv_updates(g, conv, lambda own, inputs: layers.next_state_single(inputs), SOURCE)(g)
    return out.nodes["orders"].select("node_id", F.col("state")[0].alias("a"))


@query("""SELECT o_orderkey AS source_id, count(*) AS n, CAST(sum(l_quantity + 2 * p_size + floor(CAST(o_totalprice AS DECIMAL(18,2)) / 100000)) AS DOUBLE) AS a FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def edge_update(spark, sf_dir):
    """New states of edges from their own and their ends' states."""
    g = _states(spark, sf_dir)
    up = layers.GraphUpdate(edges={"contains": lambda g: layers.edge_update(g, "contains", layers.Dense([[1], [0], [1], [2], [0]]))})
    return up(g).edges["contains"].table.groupBy("source_id").agg(F.count("*").alias("n"), F.sum(F.col("state")[0]).alias("a"))


@query("""SELECT c_mktsegment AS component_id, CAST(1 + 2 * sum(CAST(floor(c_acctbal / 1000) AS BIGINT)) AS DOUBLE) AS a FROM customer GROUP BY 1""")
def context_update(spark, sf_dir):
    """The context's new state from its own and its nodes' pooled states."""
    g = tpch.sales(spark, sf_dir)
    g = g.with_table(NODES, "customer", g.nodes["customer"].select("component_id", "node_id", F.array(F.floor(F.col("acctbal").cast("double") / 1000).cast("double")).alias("state")))
    g = g.with_table(CONTEXT, "", g.context().select("component_id", F.array(F.lit(1.0)).alias("state")))

    def new(g: PropertyGraph) -> DataFrame:
        pooled = message.pool_nodes_to_context(g, "customer", "sum", feature="state", width=1)
        return layers.next_state_concat(g.context(), [pooled], layers.Dense([[1], [2]]), keys=("component_id",))

    return layers.GraphUpdate(context=new)(g).context().select("component_id", F.col("state")[0].alias("a"))


@query("""WITH x AS (SELECT o_orderkey, 1.0 + coalesce(sum(p_size), 0) AS a, CAST(floor(CAST(o_totalprice AS DECIMAL(18,2)) / 100000) AS DOUBLE) AS b FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey GROUP BY o_orderkey, o_totalprice)
    SELECT o_orderkey AS node_id, CAST(floor(a / sqrt(a * a + b * b) * 1000 + 0.123) AS BIGINT) AS a, CAST(floor(b / sqrt(a * a + b * b) * 1000 + 0.123) AS BIGINT) AS b FROM x""")
def sage_next_state(spark, sf_dir):
    """Own state and pooled neighbours, added and scaled to unit length."""
    g = _states(spark, sf_dir)
    m = layers.simple_conv(g, "contains", layers.Dense([[1, 0], [0, 0]]), SOURCE)
    out = layers.sage_next_state(g.nodes["orders"], [m], layers.Dense([[1, 0], [0, 1]]))
    return out.select("node_id", *(_thousandths(F.col("value")[i], c) for i, c in enumerate("ab")))


@query("""SELECT o_orderkey AS node_id, CAST(floor((coalesce(sum(p_size), 0) + 1.0) / (count(l_orderkey) + 1) * 1000 + 0.123) AS BIGINT) AS a FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def gcn_sage_update(spark, sf_dir):
    """The mean of neighbours and the node itself, each mapped first."""
    g = _states(spark, sf_dir)
    out = layers.gcn_sage_update(g, ["contains"], layers.Dense([[1], [0]]), layers.Dense([[1], [0]]), SOURCE)
    return out.select("node_id", _thousandths(F.col("value")[0]))


@query("""WITH x AS (SELECT o_orderkey, greatest(coalesce(sum(p_size), 0), 0) + 1.0 AS a, greatest(0, 1.0) + CAST(floor(CAST(o_totalprice AS DECIMAL(18,2)) / 100000) AS DOUBLE) AS b FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey GROUP BY o_orderkey, o_totalprice),
    m AS (SELECT *, (a + b) / 2 AS m FROM x)
    SELECT o_orderkey AS node_id, CAST(floor((a - m) / sqrt(((a - m) ** 2 + (b - m) ** 2) / 2 + 0.001) * 1000 + 0.123) AS BIGINT) AS a FROM m""")
def mt_albis_next_state(spark, sf_dir):
    """Dense, relu, residual, layer normalization."""
    g = _states(spark, sf_dir)
    m = layers.simple_conv(g, "contains", layers.Dense([[1], [0]]), SOURCE)
    out = layers.mt_albis_next_state(g.nodes["orders"], [m], layers.Dense([[0, 1], [0, 0], [1, 0]]))
    return out.select("node_id", _thousandths(F.col("value")[0]))


_EDGE_ATTENTION = """WITH e AS (SELECT l_orderkey AS k, p_size / 10.0 + CAST(l_quantity AS BIGINT) / 50.0 AS v, p_size AS s FROM lineitem JOIN part ON l_partkey = p_partkey), m AS (SELECT k, v, s, max(v) OVER (PARTITION BY k) AS m FROM e)
    SELECT o_orderkey AS node_id, CAST(floor(coalesce(sum(exp(v - m) * s) / sum(exp(v - m)), 0) * 1000 + 0.123) AS BIGINT) AS a FROM orders LEFT JOIN m ON k = o_orderkey GROUP BY 1"""


@query(_EDGE_ATTENTION)
def attention_with_edges(spark, sf_dir):
    """Keys of senders and edges together; values are of senders alone, mapped after pooling."""
    a = layers.Attention(layers.Dense([[1], [0]]), layers.Dense([[0.1], [0]]), layers.Dense([[1], [0]]), scaling="none", edge=layers.Dense([[0.02]]))
    out = layers.multi_head_attention(_states(spark, sf_dir), "contains", a, SOURCE, edge="state", map_after_pooling=True)
    return out.select("node_id", _thousandths(F.col("value")[0]))


@query("""SELECT c_nationkey AS receiver, count(*) AS n, CAST(sum(CASE WHEN i < 3 THEN 1 ELSE 0 END) AS BIGINT) AS first_three FROM (SELECT c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i FROM customer) GROUP BY 1""")
def sliced_nodes(spark, sf_dir):
    """Slices of features and empty features: an array's first items, and an array of none."""
    n = tpch.catalog(spark, sf_dir).edges["customer_in"].table.groupBy(F.col("target_id").cast("int").alias("receiver")).agg(F.array_sort(F.collect_list("source_id")).alias("x"))
    sliced = n.select("receiver", F.size("x").cast("long").alias("n"), layers.slice_feature(F.col("x"), 0, 3).alias("y"), layers.empty_feature().alias("none"))
    return sliced.select("receiver", "n", (F.size("y") + F.size("none")).cast("long").alias("first_three"))


@query("""SELECT o_orderkey AS node_id, CAST(coalesce(sum(p_size), 0) + 1 AS DOUBLE) AS a FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def mpnn_update(spark, sf_dir):
    """A graph update built of a convolution for each edge set and a next state."""
    g = _states(spark, sf_dir)
    g = PropertyGraph(g.nodes, {"contains": EdgeSet(g.edges["contains"].table, "orders", "part")}, g.context_table)
    conv = lambda g, n, tag: layers.simple_conv(g, n, layers.Dense([[1], [0]]), tag)
    nxt = lambda own, inputs: layers.next_state_concat(own, inputs, layers.Dense([[1], [0], [1]]))
    out = layers.conv_updates(g, conv, nxt, SOURCE, ["orders"])(g)
    return out.nodes["orders"].select("node_id", F.col("state")[0].alias("a"))


# ---------------------------------------------------------------- whole updates, tasks, settings


def _pairs(spark, sf_dir) -> PropertyGraph:
    """Nations by trade, with the state (nation's number / 10, 1)."""
    from weft.queries import _nation_pairs

    g = _nation_pairs(spark, sf_dir)
    return g.with_table(NODES, "nation", g.nodes["nation"].select("component_id", "node_id", F.array(F.col("node_id") / 10.0, F.lit(1.0)).alias("state")))


_PAIRS = """WITH trade AS (SELECT CAST(s_nationkey AS BIGINT) AS s, CAST(c_nationkey AS BIGINT) AS t, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), k AS (SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation)"""


@query(_PAIRS + """, d AS (SELECT k, (SELECT count(*) FROM trade WHERE t = k) + 1.0 AS di, (SELECT count(*) FROM trade WHERE s = k) + 1.0 AS dr FROM k),
    m AS (SELECT t, s / 10.0 AS x, 1 / sqrt(a.di) / sqrt(b.dr) AS f FROM trade JOIN d a ON a.k = t JOIN d b ON b.k = s UNION ALL SELECT k, k / 10.0, 1 / sqrt(di) / sqrt(dr) FROM d)
    SELECT t AS node_id, CAST(floor(sum(f * x) * 1000 + 0.123) AS BIGINT) AS a FROM m GROUP BY 1""")
def gcn_update(spark, sf_dir):
    out = layers.gcn_update(_pairs(spark, sf_dir), layers.Dense([[1], [0]]))
    return out.nodes["nation"].select("node_id", _thousandths(F.col("state")[0]))


_SOFT = """, e AS (SELECT t, s / 10.0 AS x, {logit} AS v FROM trade), m AS (SELECT *, max(v) OVER (PARTITION BY t) AS m FROM e)
    SELECT k AS node_id, CAST(floor(coalesce(sum(exp(v - m) * {value}) / sum(exp(v - m)), 0) * 1000 + 0.123) AS BIGINT) AS a FROM k LEFT JOIN m ON t = k GROUP BY 1"""


@query(_PAIRS + _SOFT.format(logit="CASE WHEN t / 10.0 - s / 10.0 > 0 THEN t / 10.0 - s / 10.0 ELSE 0.2 * (t / 10.0 - s / 10.0) END", value="-x"))
def gat_v2_update(spark, sf_dir):
    a = layers.Attention(layers.Dense([[1], [0]]), layers.Dense([[-1], [0]]), vector=[[1]])
    out = layers.gat_v2_update(_pairs(spark, sf_dir), a)
    return out.nodes["nation"].select("node_id", _thousandths(F.col("state")[0]))


@query(_PAIRS + _SOFT.format(logit="t / 10.0 * s / 10.0", value="x"))
def attention_update(spark, sf_dir):
    a = layers.Attention(layers.Dense([[1], [0]]), layers.Dense([[1], [0]]))
    out = layers.attention_update(_pairs(spark, sf_dir), a)
    return out.nodes["nation"].select("node_id", _thousandths(F.col("state")[0]))


_ORDER_PARTS = """WITH e AS (SELECT l_orderkey AS k, {v} AS v, p_size AS s FROM lineitem JOIN part ON l_partkey = p_partkey), m AS (SELECT k, v, s, max(v) OVER (PARTITION BY k) AS m FROM e)
    SELECT o_orderkey AS node_id, CAST(floor((1 + {c} * coalesce(sum(exp(v - m) * s) / sum(exp(v - m)), 0)) * 1000 + 0.123) AS BIGINT) AS a FROM orders LEFT JOIN m ON k = o_orderkey GROUP BY 1"""


@query(_ORDER_PARTS.format(v="1 + p_size / 10.0", c="0.1"))
def gat_v2_mpnn(spark, sf_dir):
    a = layers.Attention(layers.Dense([[1], [0]]), layers.Dense([[0.1], [0]]), vector=[[1]])
    out = layers.gat_v2_mpnn(_states(spark, sf_dir), {"contains": a}, {"orders": layers.Dense([[1], [0], [1]])}, SOURCE)
    return out.nodes["orders"].select("node_id", _thousandths(F.col("state")[0]))


@query(_ORDER_PARTS.format(v="p_size / 10.0", c="2"))
def attention_mpnn(spark, sf_dir):
    a = layers.Attention(layers.Dense([[1], [0]]), layers.Dense([[0.1], [0]]), layers.Dense([[1], [0]]), scaling="none")
    out = layers.attention_mpnn(_states(spark, sf_dir), {"contains": a}, {"orders": layers.Dense([[1], [0], [2]])}, SOURCE)
    return out.nodes["orders"].select("node_id", _thousandths(F.col("state")[0]))


@query("""SELECT o_orderkey AS node_id, CAST(floor((1 + coalesce(CAST(sum(p_size) AS DOUBLE) / count(p_size), 0)) * 1000 + 0.123) AS BIGINT) AS a FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def sage_update(spark, sf_dir):
    out = layers.sage_update(_states(spark, sf_dir), {"contains": layers.Dense([[1], [0]])}, {"orders": layers.Dense([[1], [0]])}, SOURCE, normalize=False)
    return out.nodes["orders"].select("node_id", _thousandths(F.col("state")[0]))


@query("""SELECT o_orderkey AS node_id, CAST(floor((1 + greatest(coalesce(avg(p_size + 1.0), 0), 0)) * 1000 + 0.123) AS BIGINT) AS a FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def mt_albis_update(spark, sf_dir):
    """Messages of both ends' states, their mean, dense with relu and residual."""
    out = layers.mt_albis_update(_states(spark, sf_dir), {"contains": layers.Dense([[1], [0], [1], [0]])}, {"orders": layers.Dense([[0, 0], [0, 0], [1, 0]])}, SOURCE, normalization="none")
    return out.nodes["orders"].select("node_id", _thousandths(F.col("state")[0]))


_EDGE_POOL = """WITH e AS (SELECT l_orderkey AS k, {v} AS v, CAST(l_quantity AS BIGINT) AS q FROM lineitem), m AS (SELECT k, v, q, max(v) OVER (PARTITION BY k) AS m FROM e)
    SELECT o_orderkey AS node_id, CAST(floor(coalesce(sum(exp(v - m) * q{f}) / sum(exp(v - m)), 0) * 1000 + 0.123) AS BIGINT) AS a FROM orders LEFT JOIN m ON k = o_orderkey GROUP BY 1"""


@query(_EDGE_POOL.format(v="1 + CAST(l_quantity AS BIGINT) / 10.0", f=" / 10.0"))
def gat_v2_edge_pool(spark, sf_dir):
    """Orders attend to their lineitems' own states."""
    a = layers.Attention(layers.Dense([[1], [0]]), layers.Dense([[0.1]]), vector=[[1]])
    out = layers.attention_edge_pool(_states(spark, sf_dir), "contains", a, SOURCE)
    return out.select("node_id", _thousandths(F.col("value")[0]))


@query(_EDGE_POOL.format(v="CAST(l_quantity AS BIGINT) / 10.0", f=""))
def attention_edge_pool(spark, sf_dir):
    a = layers.Attention(layers.Dense([[1], [0]]), layers.Dense([[0.1]]), layers.Dense([[1]]), scaling="none")
    out = layers.attention_edge_pool(_states(spark, sf_dir), "contains", a, SOURCE, kind="dot")
    return out.select("node_id", _thousandths(F.col("value")[0]))


@query("""WITH e AS (SELECT l_orderkey AS k, p_size / 10.0 AS v, 0.5 * p_size + 1 AS s FROM lineitem JOIN part ON l_partkey = p_partkey), m AS (SELECT k, v, s, max(v) OVER (PARTITION BY k) AS m FROM e),
    a AS (SELECT o_orderkey AS k, CAST(floor(CAST(o_totalprice AS DECIMAL(18,2)) / 100000) AS DOUBLE) AS p, coalesce(sum(exp(v - m) * s) / sum(exp(v - m)), 0) AS x FROM orders LEFT JOIN m ON k = o_orderkey GROUP BY 1, 2),
    g AS (SELECT k, 0.5 * (x * 0.5 * (1 + tanh(0.7978845608028654 * (x + 0.044715 * x * x * x)))) + 0.5 AS a, 0.5 * (x * 0.5 * (1 + tanh(0.7978845608028654 * (x + 0.044715 * x * x * x)))) + 0.5 * p AS b FROM a)
    SELECT k AS node_id, CAST(floor((a - (a + b) / 2) / sqrt(((a - b) / 2) ** 2 + 0.001) * 1000 + 0.123) AS BIGINT) AS a FROM g""")
def hgt_update_normalized(spark, sf_dir):
    a = layers.Attention(layers.Dense([[1], [0]]), layers.Dense([[0.1], [0]]), layers.Dense([[0.5], [1]]))
    out = layers.hgt_update(_states(spark, sf_dir), ["contains"], SOURCE, {"contains": a}, {"contains": [1.0]}, layers.Dense([[1, 1]]), 0.0, normalize=True)
    return out.select("node_id", _thousandths(F.col("value")[0]))


@query("""SELECT CAST((SELECT sum(p_size) FROM part) AS BIGINT) AS total, true AS moved, CAST((SELECT sum(CAST(floor(o_totalprice) AS BIGINT)) FROM orders) AS BIGINT) AS untouched""")
def corrupted_features(spark, sf_dir):
    """Features of parts shuffled, those of orders left alone."""
    g = tpch.catalog(spark, sf_dir)
    g = PropertyGraph({"part": g.nodes["part"].select("component_id", "node_id", "size"), "orders": g.nodes["orders"].select("component_id", "node_id", "totalprice")}, {})
    out = metrics.corrupt(g, metrics.Corruption({(NODES, "part"): 1.0, (NODES, "orders"): 0.0}), 5)
    both = out.nodes["part"].join(g.nodes["part"].select("node_id", F.col("size").alias("was")), "node_id").agg(F.sum("size").alias("total"), (F.count(F.when(F.col("size") != F.col("was"), 1)) > F.count("*") / 2).alias("moved"))
    return both.crossJoin(out.nodes["orders"].agg(F.sum(F.floor("totalprice").cast("long")).alias("untouched")))


@query(_INFOMAX_SQL + """, b AS (SELECT z, 1 AS y FROM z UNION ALL SELECT r, 0 FROM z) SELECT CAST(floor(avg(greatest(z, 0) - z * y + ln(1 + exp(-abs(z)))) * 1000000 + 0.123) AS BIGINT) AS loss FROM b""")
def infomax_loss(spark, sf_dir):
    """Clean rows against rows with their components in reverse."""
    e = tpch.read(spark, sf_dir, "embeddings")
    clean, other = e.select(F.col("embedding").alias("x")), e.select(F.reverse("embedding").alias("x"))
    return metrics.infomax_loss(clean, other, "x", _INFOMAX, 64).select(F.floor(F.col("loss") * 1_000_000 + 0.123).alias("loss"))

"""Fixed cases of functions that read no table, as plain statements of their results."""

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests import oracle
from weft import schema as schemas
from weft import tools, tpch
from weft.graph import PropertyGraph
from weft.operators import batching, layers, message
from weft.plans.spec import topological_order
from weft.schema import SOURCE, TARGET, Feature, GraphSchema, SchemaError, SetSchema
from weft.sources import tables, tfrecord
from weft.sources.scratch import new_path

CASES = {}


def query(sql):
    def add(fn):
        CASES[fn.__name__] = (fn, sql)
        return fn

    return add


def _rows(spark, rows, kind):
    return spark.createDataFrame(rows, kind)


_TEXT = """
context { features { key: "score" value { dtype: DT_FLOAT shape { dim { size: 4 } } } } }
node_sets { key: "item" value { description: "Things \\"sold\\"" features { key: "price" value { dtype: DT_DOUBLE } } features { key: "tags" value { dtype: DT_STRING shape { dim { size: -1 } } } } metadata { filename: "item.csv" cardinality: 3 } } }
node_sets { key: "_hidden" value { } }
edge_sets { key: "bought" value { source: "item" target: "item" features { key: "n" value { dtype: DT_INT64 } } metadata { extra { key: "edge_type" value: "reversed" } } } }
"""


def _fails(fn) -> bool:
    try:
        fn()
    except (SchemaError, ValueError):
        return True
    return False


@query("""SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'seed'), (1, 'a'), (2, 'b'), (3, 'both')) t(place, op)""")
def plan_order(spark, sf_dir):
    """Operations so that each comes after its inputs."""
    order = topological_order({"both": ["a", "b"], "seed": [], "a": ["seed"], "b": ["seed"]})
    return spark.createDataFrame(list(enumerate(order)), "place long, op string")


@query("""SELECT * FROM (VALUES ('max'), ('max_no_inf'), ('mean'), ('min'), ('min_no_inf'), ('prod'), ('sum')) t(name)""")
def reducer_names(spark, sf_dir):
    return spark.createDataFrame([(n,) for n in message.reduce_names()], "name string")


@query("""SELECT 'customer' AS node_set, CAST(1 AS BIGINT) AS least UNION ALL SELECT 'orders', 1""")
def one_node_each(spark, sf_dir):
    return spark.createDataFrame(sorted(batching.one_node_per_component(tpch.sales(spark, sf_dir)).items()), "node_set string, least long")


@query("""SELECT * FROM (VALUES ('dense', true), ('attention', true), ('unknown name', false)) t(name, ok)""")
def layer_settings(spark, sf_dir):
    """Layers as plain values and back."""
    dense, a = layers.Dense([[1.0], [2.0]], [0.5], "relu"), layers.Attention(layers.Dense([[1.0]]), layers.Dense([[2.0]]), heads=1)
    rows = [("dense", layers.from_config(layers.Dense, layers.config(dense)) == dense), ("attention", layers.from_config(layers.Attention, layers.config(a)) == a)]
    try:
        layers.from_config(layers.Dense, {"weight": [[1.0]]})
        rows.append(("unknown name", True))
    except ValueError:
        rows.append(("unknown name", False))
    return spark.createDataFrame(rows, "name string, ok boolean")


@query("""SELECT * FROM (VALUES ('a.csv', 'csv', 'a.csv', 'a.csv', CAST(1 AS BIGINT)), ('b@3.csv', 'csv', 'b-?????-of-00003.csv', 'b.csv', 3), ('c.parquet@12', 'parquet', 'c.parquet-?????-of-00012', 'c.parquet', 12),
    ('d-00001-of-00002.tfrecord', 'tfrecord', 'd-00001-of-00002.tfrecord', 'd.tfrecord', 1)) t(filename, kind, pattern, base, shards)""")
def file_names(spark, sf_dir):
    names = ["a.csv", "b@3.csv", "c.parquet@12", "d-00001-of-00002.tfrecord"]
    return _rows(spark, [(n, tables.guess_format(n), tables.expand_shards(n), tables.base_name(n), tables.shard_count(n)) for n in names], "filename string, kind string, pattern string, base string, shards long")


@query("""SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'n0', 'n1', 1.5), (1, 'n1', 'n2', 2.5), (2, 'n0', 'n2', 2.5)) t(edge_id, source_id, target_id, target_value)""")
def homogeneous_arrays(spark, sf_dir):
    """A graph of index arrays."""
    g = tables.edge_lists_from_arrays(spark, [[0, 1, 0], [1, 2, 2]], 3, {"v": [0.5, 1.5, 2.5]}, name="n")
    return message.broadcast(g, TARGET, edge_set="edges", feature="v", name="target_value").select("edge_id", "source_id", "target_id", "target_value")


@query("""SELECT * FROM (VALUES ('writes', CAST(0 AS BIGINT), 'author0', 'paper1'), ('writes', 1, 'author1', 'paper0'), ('cites', 0, 'paper1', 'paper0')) t(edge_set, edge_id, source_id, target_id)""")
def heterogeneous_arrays(spark, sf_dir):
    g = tables.graph_from_arrays(spark, {"author": 2, "paper": 2}, {("author", "writes", "paper"): [[0, 1], [1, 0]], ("paper", "cites", "paper"): [[1], [0]]}, {"paper": {"year": [2001, 2002]}})
    g.assert_valid()
    out = None
    for n, e in g.edges.items():
        own = e.table.select(F.lit(n).alias("edge_set"), "edge_id", "source_id", "target_id")
        out = own if out is None else out.unionByName(own)
    return out


@query("""SELECT * FROM (VALUES ('context/customers', 'int'), ('nodes/customer.acctbal', 'float'), ('nodes/customer.#size', 'int'), ('nodes/orders.totalprice', 'float'), ('nodes/orders.#size', 'int'),
    ('edges/placed.weight', 'float'), ('edges/placed.#size', 'int'), ('edges/placed.#source', 'int'), ('edges/placed.#target', 'int')) t(name, kind)""")
def example_names(spark, sf_dir):
    return _rows(spark, sorted(tfrecord.flat_names(tpch.sales(spark, sf_dir)).items()), "name string, kind string")


@query("""SELECT CAST(100 AS BIGINT) AS nodes, CAST(300 AS BIGINT) AS edges, CAST(0 AS BIGINT) AS dangling, CAST(100 AS BIGINT) AS in_range""")
def random_graph(spark, sf_dir):
    """A random graph for a schema: its sizes, and that its edges end in nodes."""
    s = GraphSchema({"a": SetSchema({"x": Feature("DT_FLOAT"), "tags": Feature("DT_STRING", (-1,))})}, {"e": SetSchema({}, "a", "a")})
    g = tables.random_graph(spark, s, {"a": 100}, {"e": 300}, 5)
    n = g.nodes["a"].agg(F.count("*").alias("nodes"), F.count(F.when((F.col("x") >= 0) & (F.col("x") < 1) & (F.size("tags") <= 8), 1)).alias("in_range"))
    return n.crossJoin(g.edges["e"].table.agg(F.count("*").alias("edges"))).crossJoin(g.dangling("e").agg(F.count("*").alias("dangling")))


@query("""SELECT * FROM (VALUES ('context', '', 'score', 'DT_FLOAT', '4', 'array<float>'), ('nodes', 'item', 'price', 'DT_DOUBLE', '', 'double'), ('nodes', 'item', 'tags', 'DT_STRING', '-1', 'array<string>'), ('edges', 'bought', 'n', 'DT_INT64', '', 'bigint')) t(kind, set, feature, dtype, shape, spark_type)""")
def schema_features(spark, sf_dir):
    """A schema's features, after it was written in text format and read again."""
    name = f"{new_path(spark, 'schema')}/s.pbtxt"
    schemas.write_schema(schemas.parse_schema(_TEXT), name, spark)
    s = schemas.read_schema(name, spark)
    return _rows(spark, [(k, n, f, x.dtype, ",".join(map(str, x.shape)), x.spark_type().simpleString()) for k, n, f, x in s.iter_features()], "kind string, set string, feature string, dtype string, shape string, spark_type string")


@query("""SELECT * FROM (VALUES ('context', '', '', '', '', false), ('nodes', 'item', '', '', 'item.csv', false), ('nodes', '_hidden', '', '', '', false), ('edges', 'bought', 'item', 'item', '', true)) t(kind, set, source, target, filename, reversed)""")
def schema_sets(spark, sf_dir):
    s = schemas.parse_schema(schemas.write_text(schemas.parse_schema(_TEXT)))
    rows = [(k, n, x.source, x.target, x.metadata.get("filename", ""), tables.is_reversed(x)) for k, n, x in s.iter_sets()]
    return _rows(spark, rows, "kind string, set string, source string, target string, filename string, reversed boolean")


@query("""SELECT * FROM (VALUES ('node_id', 'bigint'), ('size', 'int'), ('retailprice', 'double')) t(name, type)""")
def schema_of_graph(spark, sf_dir):
    """The schema that a graph's tables have; decimals are doubles there."""
    g = tpch.catalog(spark, sf_dir)
    own = g.schema().node_sets["part"].features
    return _rows(spark, [("node_id", g.nodes["part"].schema["node_id"].dataType.simpleString()), *((f, own[f].spark_type().simpleString()) for f in ("size", "retailprice"))], "name string, type string")


@query("""SELECT * FROM (VALUES ('as it is', false), ('unknown type', true), ('reserved name', true), ('no such end', true), ('dimension 0', true), ('context feature missing', true), ('required set missing', true), ('required type differs', true), ('any size is fine', false)) t(name, fails)""")
def schema_checks(spark, sf_dir):
    s = schemas.parse_schema(_TEXT)
    item = lambda **f: GraphSchema({"item": SetSchema(f)})
    cases = {
        "as it is": lambda: schemas.validate_schema(s),
        "unknown type": lambda: schemas.validate_schema(item(x=Feature("DT_COMPLEX64"))),
        "reserved name": lambda: schemas.validate_schema(item(node_id=Feature())),
        "no such end": lambda: schemas.validate_schema(GraphSchema({}, {"e": SetSchema({}, "a", "b")})),
        "dimension 0": lambda: schemas.validate_schema(item(x=Feature("DT_FLOAT", (0,)))),
        "context feature missing": lambda: schemas.validate_schema(GraphSchema({"a": SetSchema(context=("x",))})),
        "required set missing": lambda: schemas.check_required_features(GraphSchema({"other": SetSchema()}), s),
        "required type differs": lambda: schemas.check_required_features(item(price=Feature("DT_STRING")), s),
        "any size is fine": lambda: schemas.check_required_features(item(tags=Feature("DT_STRING", (0,))), s),
    }
    return _rows(spark, [(n, _fails(fn)) for n, fn in cases.items()], "name string, fails boolean")


@query("""SELECT * FROM (VALUES ('matches', false), ('other type', true), ('other ends', true), ('missing set', true)) t(name, fails)""")
def graph_against_schema(spark, sf_dir):
    g = tpch.catalog(spark, sf_dir)
    own = lambda nodes=None, edges=None: GraphSchema(nodes or {}, edges or {})
    size = {"part": SetSchema({"size": Feature("DT_INT32")})}
    cases = {
        "matches": own(size, {}),
        "other type": own({"part": SetSchema({"size": Feature("DT_STRING")})}),
        "other ends": own({}, {"placed": SetSchema({}, "orders", "customer")}),
        "missing set": own({"nobody": SetSchema()}),
    }
    return _rows(spark, [(n, _fails(lambda s=s: g.check(s))) for n, s in cases.items()], "name string, fails boolean")


@query("""SELECT * FROM (VALUES ('_readout', '_', false), ('item', NULL, true), ('#x', '#', false)) t(name, prefix, plain)""")
def auxiliary_names(spark, sf_dir):
    return _rows(spark, [(n, schemas.aux_prefix(n), schemas.aux_prefix(n) is None) for n in ("_readout", "item", "#x")], "name string, prefix string, plain boolean")


@query("""SELECT * FROM (VALUES ('source', 'target'), ('target', 'source')) t(tag, other)""")
def other_ends(spark, sf_dir):
    return _rows(spark, [(t, schemas.reverse_tag(t)) for t in (SOURCE, TARGET)], "tag string, other string")


@query("""SELECT * FROM (VALUES ('DT_FLOAT', true), ('DT_STRING', true), ('DT_COMPLEX64', false), ('DT_INVALID', false)) t(dtype, known)""")
def supported_types(spark, sf_dir):
    return _rows(spark, [(t, schemas.is_supported_type(t)) for t in ("DT_FLOAT", "DT_STRING", "DT_COMPLEX64", "DT_INVALID")], "dtype string, known boolean")


@query("""SELECT CAST(p * 100 + i AS BIGINT) AS id, CAST(i * i AS BIGINT) AS square FROM range(4) a(p), range(5) b(i)""")
def generated_rows(spark, sf_dir):
    """A generator's rows, a part in each task."""
    return tables.generated(spark, lambda p: ((p * 100 + i, i * i) for i in range(5)), 4, "id long, square long")


@query("""SELECT * FROM (VALUES ('complete', false), ('no node ids', true), ('unknown node set', true), ('a graph', true), ('a table', false)) t(name, yes)""")
def checked_graphs(spark, sf_dir):
    """Checks of graphs as they are made."""
    from weft import graph as graphs

    g = tpch.catalog(spark, sf_dir)
    placed = g.edges["placed"]
    graphs.enable_validation()
    try:
        rows = [
            ("complete", _fails(lambda: PropertyGraph(g.nodes, {"placed": placed}))),
            ("no node ids", _fails(lambda: PropertyGraph({"x": g.nodes["part"].drop("node_id")}))),
            ("unknown node set", _fails(lambda: PropertyGraph({"customer": g.nodes["customer"]}, {"placed": placed}))),
        ]
    finally:
        graphs.disable_validation()
    return _rows(spark, [*rows, ("a graph", graphs.is_graph(g)), ("a table", graphs.is_graph(g.nodes["part"]))], "name string, yes boolean")


@query("""SELECT CAST(i AS BIGINT) AS component_id, CAST(10 AS BIGINT) AS items, CAST(30 AS BIGINT) AS edges, true AS inside FROM range(6) t(i)""")
def training_examples(spark, sf_dir):
    """Random samples of a schema, written as Examples and decoded."""
    s = GraphSchema({"item": SetSchema({"price": Feature("DT_FLOAT")})}, {"near": SetSchema({}, "item", "item")})
    written = tools.training_data(spark, s, new_path(spark, "training"), 6)
    longs = T.ArrayType(T.LongType())
    got = tfrecord.decode_samples(written, {"nodes/item.#size": longs, "edges/near.#source": longs})
    return got.select("component_id", F.col("nodes_item_size")[0].alias("items"), F.size("edges_near_source").cast("long").alias("edges"), F.forall("edges_near_source", lambda x: (x >= 0) & (x < 10)).alias("inside"))


@query("""SELECT * FROM (VALUES ('all columns', false), ('one is missing', true)) t(name, fails)""")
def hyper_edge_columns(spark, sf_dir):
    spec = tools.HyperAdjacencySpec({0: "customer", 1: "orders"})
    o = tpch.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("node_0"), F.col("o_orderkey").alias("node_1"))
    return _rows(spark, [("all columns", _fails(lambda: spec.check(o))), ("one is missing", _fails(lambda: spec.check(o.drop("node_1"))))], "name string, fails boolean")


@pytest.mark.parametrize("name", sorted(CASES))
def test_case(spark, name):
    fn, sql = CASES[name]
    oracle.check(spark, duckdb.connect(), fn, sql)


def test_top_k_skips_the_rest_of_a_partition():
    from pyspark.sql.udtf import SkipRestOfInputTableException

    from weft.sql import TopK

    seen, one = [], TopK.func()
    with pytest.raises(SkipRestOfInputTableException):
        for x in range(5):
            for row in one.eval((x,), 2):
                seen.append(row)
    assert seen == [(0,), (1,)]

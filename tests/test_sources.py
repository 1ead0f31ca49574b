"""Schemas, tables on disk, TFRecord files and converters."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.graph import PropertyGraph
from weft.schema import Feature, GraphSchema, SchemaError, SetSchema, aux_prefix, check_required_features, parse_schema, validate_schema, write_text
from weft.sources import tables, tfrecord

TEXT = """
# cards
context { features { key: "rank" value { dtype: DT_FLOAT shape { dim { size: 4 } } } } }
node_sets { key: "customer" value { description: "People" metadata { filename: "customer.csv" cardinality: 3 }
  features { key: "name" value: { dtype: DT_STRING } } features { key: "score" value: { dtype: DT_FLOAT } } features { key: "zip" value { dtype: DT_INT64 } } } }
node_sets { key: "card" value { metadata { filename: "card@2.csv" } } }
edge_sets { key: "owns" value { source: "customer" target: "card" metadata { filename: "owns.csv" extra { key: "edge_type" value: "reversed" } } } }
"""


def test_schema_text():
    s = parse_schema(TEXT)
    assert s.context.features["rank"] == Feature("DT_FLOAT", (4,)) and s.edge_sets["owns"].metadata["edge_type"] == "reversed"
    assert parse_schema(write_text(s)) == s
    assert [(k, n) for k, n, _ in s.iter_sets()] == [("context", ""), ("nodes", "customer"), ("nodes", "card"), ("edges", "owns")]
    assert validate_schema(s) == []
    with pytest.raises(SchemaError):
        parse_schema("node_sets { key: 'a'")
    assert aux_prefix("_readout") == "_" and aux_prefix("x") is None


def test_validation():
    bad = [
        GraphSchema({"a": SetSchema({"x": Feature("DT_COMPLEX")})}),
        GraphSchema({"a": SetSchema({"#id": Feature()})}),
        GraphSchema({"a": SetSchema(context=("nothing",))}),
        GraphSchema({"a": SetSchema()}, {"e": SetSchema(source="a", target="b")}),
        GraphSchema({"a": SetSchema()}, {"e": SetSchema(source="a")}),
    ]
    for s in bad:
        with pytest.raises(SchemaError):
            validate_schema(s)
    assert validate_schema(GraphSchema({"a": SetSchema({"x": Feature("DT_FLOAT", (1,))})}))
    need = GraphSchema({"a": SetSchema({"x": Feature("DT_FLOAT", (0,))})})
    check_required_features(need, GraphSchema({"a": SetSchema({"x": Feature("DT_FLOAT", (7,)), "y": Feature()})}))
    with pytest.raises(SchemaError):
        check_required_features(need, GraphSchema({"a": SetSchema({"x": Feature("DT_INT64", (7,))})}))


def test_names():
    assert tables.guess_format("a/b.csv") == "csv" and tables.guess_format("x.tfrecord@3") == "tfrecord"
    with pytest.raises(ValueError):
        tables.guess_format("x.txt")
    assert tables.expand_shards("a.csv@12") == "a.csv-?????-of-00012" and tables.expand_shards("a@2.csv") == "a-?????-of-00002.csv"
    assert tables.base_name("a-00000-of-00003.csv") == "a.csv" == tables.base_name("a@3.csv") and tables.shard_count("a@3") == 3


def test_csv_graph(spark, tmp_path):
    (tmp_path / "g.pbtxt").write_text(TEXT)
    (tmp_path / "customer.csv").write_text('id,name,score,zip,more\n1,"Doe, Jo",0.5,90210,a\n2,X,1.5,1,b\n')
    (tmp_path / "card-00000-of-00002.csv").write_text("id\n17\n")
    (tmp_path / "card-00001-of-00002.csv").write_text("id\n18\n")
    (tmp_path / "owns.csv").write_text("target,source\n1,17\n2,99\n")
    g, schema = tables.load_graph(spark, str(tmp_path))
    row = g.nodes["customer"].where("node_id = '1'").first()
    assert (row.name, row.score, row.zip, row.more) == ("Doe, Jo", 0.5, 90210, "a")
    assert {(r.source_id, r.target_id) for r in g.edges["owns"].table.collect()} == {("1", "17"), ("2", "99")}
    assert [(r.target_id, r.tag) for r in g.dangling("owns").collect()] == [("99", "target")]
    assert g.nodes["card"].count() == 2 and tables.read_seeds(spark, f"{tmp_path}/customer.csv").count() == 2
    assert g.context_table is None and schema.context is not None
    links = tables.read_link_seeds(spark, f"{tmp_path}/owns.csv")
    assert {r.sample_id for r in links.collect()} == {"S17:T1", "S99:T2"}


@pytest.mark.parametrize("kind", ["parquet", "csv", "tfrecord"])
def test_round_trip(spark, tmp_path, kind):
    nodes = spark.createDataFrame([("a", 1, 2.5), ("b", None, -1.0)], "node_id string, n long, x float").fillna(0)
    edges = spark.createDataFrame([("a", "b", "w")], "source_id string, target_id string, name string")
    g = PropertyGraph.of({"v": nodes.withColumn("component_id", F.lit(0).cast("long"))}, {"e": (edges, "v", "v")})
    tables.save_graph(g, str(tmp_path), kind)
    back, _ = tables.load_graph(spark, str(tmp_path))
    assert sorted((r.node_id, r.n, r.x) for r in back.nodes["v"].collect()) == [("a", 1, 2.5), ("b", 0, -1.0)]
    assert [(r.source_id, r.target_id, r["name"]) for r in back.edges["e"].table.collect()] == [("a", "b", "w")]


def test_examples(spark, tmp_path):
    ex = {"i": [1, -2, 1 << 40], "f": [0.5, -3.0], "b": [b"x", b"\x00\xff"], "none": []}
    assert tfrecord.decode_example(tfrecord.encode_example(ex)) == {**ex}
    assert tfrecord.crc32c(b"123456789") == 0xE3069283
    raw = tfrecord.frame(b"one") + tfrecord.frame(b"")
    assert list(tfrecord.unframe(raw)) == [b"one", b""]
    for damaged in (raw[:-1], raw[:13] + b"X" + raw[14:]):
        with pytest.raises(ValueError):
            list(tfrecord.unframe(damaged))
    df = spark.createDataFrame([(1, "é", [1.5, 2.5], [[1, 2], [], [3]]), (2, None, [], [])], "n long, s string, x array<float>, r array<array<long>>")
    tfrecord.write_examples(df, f"{tmp_path}/t.tfrecord")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    got = sorted(map(tuple, tfrecord.read_examples(spark, f"{tmp_path}/t.tfrecord", {**kinds, "missing": T.LongType()}).collect()))
    assert got == [(1, "é", [1.5, 2.5], [[1, 2], [], [3]], 0), (2, "", [], [], 0)]


def test_encode_samples(spark):
    nodes = spark.createDataFrame([("s", "a", 0, "A"), ("s", "b", 1, "B")], "component_id string, node_id string, pos long, name string")
    edges = spark.createDataFrame([("s", 0, "a", "b", 0.5)], "component_id string, edge_id long, source_id string, target_id string, weight float")
    g = PropertyGraph.of({"v": nodes}, {"e": (edges, "v", "v")}, spark.createDataFrame([("s", 7), ("empty", 8)], "component_id string, y long"))
    got = {r.component_id: tfrecord.decode_example(bytes(r.example)) for r in tfrecord.encode_samples(g).collect()}
    assert got["s"] == {"context/y": [7], "nodes/v.#size": [2], "nodes/v.name": [b"A", b"B"], "edges/e.#size": [1], "edges/e.weight": [0.5], "edges/e.#source": [0], "edges/e.#target": [1]}
    assert got["empty"]["nodes/v.#size"] == [0]


def test_encode_samples_in_pieces(spark):
    """No Example holds more than a piece of a set; lists end to end are those of the whole component."""
    nodes = spark.range(57).select(F.when(F.col("id") < 50, "big").otherwise("s").alias("component_id"), F.col("id").alias("node_id"), (F.col("id") % 7).alias("x"))
    ends = spark.range(83).select(F.lit("big").alias("component_id"), F.col("id").alias("edge_id"), (F.col("id") % 50).alias("source_id"), (F.col("id") * 3 % 50).alias("target_id"))
    g = PropertyGraph.of({"v": nodes.repartition(3)}, {"e": (ends, "v", "v")}, spark.createDataFrame([("big", 7), ("s", 8), ("empty", 9)], "component_id string, y long"))
    read = lambda df: [(r.component_id, tfrecord.decode_example(bytes(r.example))) for r in df.collect()]
    whole, got = dict(read(tfrecord.encode_samples(g))), {}
    pieces = read(tfrecord.encode_samples(g, 10))
    assert sorted(k for k, _ in pieces) == ["big"] * 9 + ["empty", "s"]
    for k, x in pieces:
        assert all(len(v) <= 10 for v in x.values())
        for name, v in x.items():
            got.setdefault(k, {}).setdefault(name, []).extend(v)
    assert {k: {n: sorted(v) for n, v in x.items() if v} for k, x in got.items()} == {k: {n: sorted(v) for n, v in x.items() if v} for k, x in whole.items()}
    pairs = lambda x: sorted(zip(x["edges/e.#source"], x["edges/e.#target"]))
    assert pairs(got["big"]) == pairs(whole["big"])


def test_converters(spark):
    t = spark.createDataFrame([("x", "likes", "y", 0), ("y", "likes", "z", 1), ("x", "knows", "z", 2)], "s string, p string, o string, n long")
    g = tables.triples_to_graph(t, order=F.col("n"))
    assert sorted(g.edges) == ["knows", "likes"] and [r.node_id for r in g.nodes["nodes"].orderBy("pos").collect()] == ["x", "y", "z"]
    schema = GraphSchema({"a": SetSchema({"x": Feature("DT_FLOAT", (3,)), "r": Feature("DT_INT64", (-1,)), "s": Feature("DT_STRING")}), "b": SetSchema()}, {"e": SetSchema(source="a", target="b")})
    r = tables.random_graph(spark, schema, {"a": 20, "b": 5}, {"e": 40})
    r.assert_valid()
    assert r.nodes["a"].where("size(x) = 3 and size(r) <= 8 and length(s) = 8").count() == 20
    arrays = tables.edge_lists_from_arrays(spark, [[0, 1], [1, 1]], 2, {"x": [5, 6]})
    assert arrays.edges["edges"].table.count() == 2
    a, b = spark.range(100), spark.range(1000, 1010)
    mixed = tables.mix_datasets([(a, 0.5), (b, 0.5)])
    assert mixed.count() == 200 and mixed.where("id >= 1000").groupBy("id").count().where("count = 10").count() == 10

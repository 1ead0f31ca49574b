from weft import tools
from weft.graph import PropertyGraph
from weft.plans.spec import TOP_K


def test_plan_text():
    spec = tools.parse_plan("""seed_op { op_name: "s" node_set_name: "a" }
        sampling_ops { op_name: "x" input_op_names: ["s"] edge_set_name: "ab" sample_size: 4 strategy: TOP_K }
        sampling_ops { op_name: "y" input_op_names: "s" input_op_names: "x" edge_set_name: "aa" sample_size: 2 }""")
    assert [(o.op_name, o.input_ops, o.size) for o in spec.ops] == [("x", ("s",), 4), ("y", ("s", "x"), 2)] and spec.ops[0].strategy == TOP_K


def test_values_and_names(spark, tmp_path):
    nodes = spark.createDataFrame([(0, 1), (0, 2)], "component_id long, node_id long")
    g = PropertyGraph.of({"v": nodes}, {})
    assert tools.graph_to_values(g)["nodes"]["v"] == [{"component_id": 0, "node_id": 1}, {"component_id": 0, "node_id": 2}]
    (tmp_path / "m-0").mkdir()
    assert tools.next_dir(f"{tmp_path}/m") == f"{tmp_path}/m-1"
    hyper = tools.HyperAdjacency(spark.createDataFrame([(0, 0, 1, 2, 9)], "component_id long, edge_id long, node_0 long, node_1 long, node_2 long"), {0: "v", 1: "v", 2: "v"})
    assert [(r.node_id, r.tag) for r in hyper.check(g).collect()] == [(9, 2)]


def test_validate(tmp_path):
    (tmp_path / "s.pbtxt").write_text('node_sets { key: "a" value { features { key: "x" value { dtype: DT_FLOAT } } } }')
    assert tools.main(["validate", str(tmp_path / "s.pbtxt")]) == 0 and tools.main(["sample"]) == 2

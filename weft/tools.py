"""Command-line tools: check a schema, sample a graph, print and make data.

    python -m weft.tools validate schema.pbtxt
    python -m weft.tools sample graph_dir plan.pbtxt seeds.csv out_dir
    python -m weft.tools random schema.pbtxt out_dir nodes edges
    python -m weft.tools show graph_dir rows
"""

from __future__ import annotations

import os
import re
import sys
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.graph import PropertyGraph
from weft.plans.sample import sample
from weft.plans.spec import UNIFORM, SamplingOp, SamplingSpec, SeedOp
from weft.schema import CONTEXT, GraphSchema, parse_text, read_schema, validate_schema
from weft.sources import tables, tfrecord


def parse_plan(text: str) -> SamplingSpec:
    """A sampling plan in text format: seed_op { op_name node_set_name }, sampling_ops { op_name input_op_names edge_set_name sample_size strategy }."""
    m = parse_text(text)
    seed = m["seed_op"][-1]
    ops = [SamplingOp(x["op_name"][-1], tuple(x.get("input_op_names", [])), x["edge_set_name"][-1], int(x["sample_size"][-1]), x.get("strategy", [UNIFORM])[-1]) for x in m.get("sampling_ops", [])]
    spec = SamplingSpec(SeedOp(seed["op_name"][-1], seed["node_set_name"][-1]), tuple(ops))
    spec.check_order()
    return spec


def graph_to_values(graph: PropertyGraph, rows: int = 20) -> dict:
    """The first rows of every table, as nested dicts: {kind: {set: [row, ...]}}."""
    out: dict[str, dict[str, list]] = {}
    for kind, name, df in graph.iter_sets():
        out.setdefault(kind, {})[name] = [r.asDict(recursive=True) for r in df.limit(rows).collect()]
    return out


def next_dir(base: str, start: int = 0) -> str:
    """The first ``base-<n>`` that doesn't exist."""
    while os.path.exists(f"{base}-{start}"):
        start += 1
    return f"{base}-{start}"


@dataclass(frozen=True)
class HyperAdjacency:
    """Edges with any number of ends: ``node_<tag>`` columns, each naming a node of one set."""

    table: DataFrame
    ends: dict[int, str]

    def column(self, tag: int) -> Column:
        return F.col(f"node_{tag}")

    def incidence(self, tag: int) -> DataFrame:
        """(component_id, edge_id, node_id) of one tag: a hyperedge as ordinary incidences."""
        return self.table.select("component_id", "edge_id", self.column(tag).alias("node_id"))

    def check(self, graph: PropertyGraph) -> DataFrame:
        """Incidences whose node is missing, with their tag."""
        out = None
        for tag, name in self.ends.items():
            own = self.incidence(tag).join(graph.nodes[name].select("component_id", "node_id"), ["component_id", "node_id"], "left_anti").withColumn("tag", F.lit(tag))
            out = own if out is None else out.unionByName(own)
        return out


def to_networkx(graph: PropertyGraph):
    """A small graph as a networkx multigraph on the driver: nodes are (set, id), edges carry their set and features."""
    import networkx as nx

    out = nx.MultiDiGraph()
    for name, df in graph.nodes.items():
        for r in tables.local_rows(df):
            out.add_node((name, r.pop("node_id")), **r)
    for name, e in graph.edges.items():
        for r in tables.local_rows(e.table):
            out.add_edge((e.source, r.pop("source_id")), (e.target, r.pop("target_id")), edge_set=name, **r)
    return out


def training_data(spark: SparkSession, schema: GraphSchema, path: str, samples: int, nodes: int = 10, edges: int = 30, seed: int = 0) -> DataFrame:
    """Random samples of a schema as Examples in files: (component_id, example), as written."""
    g = tables.random_graph(spark, schema, dict.fromkeys(schema.node_sets, nodes * samples), dict.fromkeys(schema.edge_sets, 0), seed)
    part = F.expr(f"node_id div {nodes}")
    own = {n: x.withColumn("component_id", part) for n, x in g.nodes.items()}
    ends = lambda c: (F.pmod(F.xxhash64(F.lit(seed), F.lit(c), "edge_id"), F.lit(nodes)) + F.col("component_id") * nodes).alias(c)
    ids = spark.range(edges * samples).select(F.col("id").alias("edge_id"), F.expr(f"id div {edges}").alias("component_id"))
    sets = {n: (ids.select("component_id", "edge_id", ends("source_id"), ends("target_id")), e.source, e.target) for n, e in schema.edge_sets.items()}
    encoded = tfrecord.encode_samples(PropertyGraph.of(own, sets))
    encoded.write.parquet(path)
    return spark.read.parquet(path)


@dataclass(frozen=True)
class HyperAdjacencySpec:
    """Which node set each tag of a hyperedge names."""

    ends: dict[int, str]

    def check(self, table: DataFrame) -> None:
        if missing := [f"node_{t}" for t in self.ends if f"node_{t}" not in table.columns]:
            raise ValueError(f"no columns {missing}")


def main(args: list[str]) -> int:
    if len(args) == 2 and args[0] == "validate":
        for w in validate_schema(read_schema(args[1])):
            print("warning:", w)
        return 0
    spark = SparkSession.builder.appName("weft").getOrCreate()
    if len(args) == 5 and args[0] == "sample":
        graph, _ = tables.load_graph(spark, args[1])
        spec = parse_plan(tables.read_text(spark, args[2]))
        tables.save_graph(sample(graph, spec, tables.read_seeds(spark, args[3])), args[4])
    elif len(args) == 5 and args[0] == "random":
        schema = read_schema(args[1])
        tables.save_graph(tables.random_graph(spark, schema, dict.fromkeys(schema.node_sets, int(args[3])), dict.fromkeys(schema.edge_sets, int(args[4]))), args[2])
    elif len(args) == 3 and args[0] == "show":
        graph, _ = tables.load_graph(spark, args[1])
        for kind, sets in graph_to_values(graph, int(args[2])).items():
            for name, rows in sets.items():
                print(re.sub("/$", "", f"{kind}/{name}") if kind != CONTEXT else kind, *rows, sep="\n  ")
    else:
        print(__doc__)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

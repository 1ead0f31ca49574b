"""Readout: values of distinguished items, named by auxiliary edges into a ``_readout`` node set.

An edge set ``_readout/<key>`` or ``_readout/<key>/<suffix>`` points from nodes to ``_readout`` nodes; one
whose source is ``_shadow/<E>`` stands for edges of E, with their edge ids as its source ids. Several edge
sets of one key are a union. Each readout node must be hit exactly once by a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.graph import PropertyGraph, position
from weft.schema import EDGES, NODES, SchemaError

READOUT, SHADOW = "_readout", "_shadow/"


def readout_map(graph: PropertyGraph, key: str, readout: str = READOUT) -> dict[str, tuple[str, str]]:
    """(kind, set) that each edge set of the key reads from."""
    out = {}
    for name, e in graph.edges.items():
        if name == f"{readout}/{key}" or name.startswith(f"{readout}/{key}/"):
            if e.target != readout:
                raise SchemaError(f"{name} must end in {readout}")
            if e.source.startswith(SHADOW):
                if e.source[len(SHADOW) :] not in graph.edges:
                    raise SchemaError(f"{name} reads from an unknown edge set")
                out[name] = (EDGES, e.source[len(SHADOW) :])
            else:
                if e.source not in graph.nodes:
                    raise SchemaError(f"{name} reads from an unknown node set")
                out[name] = (NODES, e.source)
    if not out:
        raise SchemaError(f"no edge set {readout}/{key}")
    return out


def check_readout_schema(graph: PropertyGraph, keys: list[str] | None = None, readout: str = READOUT) -> None:
    """Raise unless the sets that readout needs are there, for the given or all keys."""
    if readout not in graph.nodes:
        raise SchemaError(f"no node set {readout}")
    for key in keys or {n.split("/")[1] for n in graph.edges if n.startswith(readout + "/")}:
        readout_map(graph, key, readout)


def check_readout(graph: PropertyGraph, key: str, readout: str = READOUT) -> DataFrame:
    """Readout nodes that the key doesn't hit exactly once, with the number of hits: empty if all is well."""
    hits = None
    for name in readout_map(graph, key, readout):
        own = graph.edges[name].table.select("component_id", F.col("target_id").alias("node_id"))
        hits = own if hits is None else hits.unionByName(own)
    n = hits.groupBy("component_id", "node_id").agg(F.count("*").alias("hits"))
    nodes = graph.nodes[readout].select("component_id", "node_id", F.lit(True).alias("known"))
    return nodes.join(n, ["component_id", "node_id"], "full").where("hits is null or known is null or hits <> 1").select("component_id", "node_id", F.coalesce("hits", F.lit(0)).alias("hits"))


def structured_readout(graph: PropertyGraph, key: str, feature: str, name: str = "value", readout: str = READOUT) -> DataFrame:
    """(component_id, node_id, value) for each readout node of the key."""
    out = None
    for edge_set, (kind, source) in readout_map(graph, key, readout).items():
        item = "node_id" if kind == NODES else "edge_id"
        values = graph.table(kind, source).select("component_id", F.col(item).alias("source_id"), F.col(feature).alias(name))
        e = graph.edges[edge_set].table.select("component_id", "source_id", F.col("target_id").alias("node_id"))
        own = e.join(values, ["component_id", "source_id"]).select("component_id", "node_id", name)
        out = own if out is None else out.unionByName(own)
    return out


def readout_into_feature(graph: PropertyGraph, key: str, feature: str, new: str | None = None, overwrite: bool = False, remove: bool = False, readout: str = READOUT) -> PropertyGraph:
    """structured_readout() as a feature of the readout nodes; ``remove`` takes it away from where it was."""
    new = new or feature
    nodes = graph.nodes[readout]
    if new in nodes.columns:
        if not overwrite:
            raise ValueError(f"{readout} has {new} already")
        nodes = nodes.drop(new)
    got = structured_readout(graph, key, feature, new, readout)
    out = graph.with_table(NODES, readout, nodes.join(got, ["component_id", "node_id"], "left"))
    for kind, source in dict.fromkeys(readout_map(graph, key, readout).values()) if remove else ():
        out = out.remove_features(kind, source, feature)
    return out


def context_readout_into_feature(graph: PropertyGraph, feature: str, new: str | None = None, readout: str = READOUT) -> PropertyGraph:
    """A context feature on the readout nodes; without a readout node set, one node is made for each component."""
    nodes = graph.nodes.get(readout)
    if nodes is None:
        nodes = graph.context().select("component_id", F.lit(0).cast("long").alias("node_id"))
    value = graph.context().select("component_id", F.col(feature).alias(new or feature))
    return graph.with_table(NODES, readout, nodes.join(value, "component_id", "left"))


def add_readout_from_first_node(graph: PropertyGraph, key: str, node_set: str, readout: str = READOUT) -> PropertyGraph:
    """A readout node for each component, and an edge to it from the component's first node."""
    name = f"{readout}/{key}"
    if name in graph.edges:
        raise ValueError(f"{name} exists already")
    nodes = graph.nodes[node_set]
    first = nodes.groupBy("component_id").agg(F.min_by("node_id", F.struct(position(nodes, "node_id"), "node_id")).alias("source_id"))
    zero = F.lit(0).cast("long")
    out = graph
    if readout not in graph.nodes:
        out = out.with_table(NODES, readout, graph.context().select("component_id", zero.alias("node_id")))
    return out.with_edges(name, first.select("component_id", zero.alias("edge_id"), "source_id", zero.alias("target_id")), node_set, readout)


def pop_label(graph: PropertyGraph, feature: str, node_set: str | None = None) -> tuple[PropertyGraph, DataFrame]:
    """Take a feature away as the label: of the context, or of each component's first node."""
    if node_set is None:
        label = graph.context().select("component_id", F.col(feature).alias("label"))
        return graph.remove_features("context", "", feature), label
    nodes = graph.nodes[node_set]
    w = Window.partitionBy("component_id").orderBy(position(nodes, "node_id"), "node_id")
    label = nodes.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("component_id", F.col(feature).alias("label"))
    return graph.remove_features(NODES, node_set, feature), label

"""Message passing over hyperedges: broadcast, pooling and softmax at any tag of an incidence, not only source and target."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.graph import EdgeSet, PropertyGraph
from weft.operators import message
from weft.operators.structure import attach_groups
from weft.schema import TARGET
from weft.tools import HyperAdjacency

_EDGES = "_hyperedges"


def at_tag(graph: PropertyGraph, hyper: HyperAdjacency, tag: int) -> PropertyGraph:
    """The graph with an edge set whose target is the hyperedges' end at a tag, and whose source is the hyperedge itself."""
    if tag not in hyper.ends:
        raise ValueError(f"no tag {tag}; there are {sorted(hyper.ends)}")
    ends = [f"node_{t}" for t in hyper.ends]
    table = hyper.table.select(*(c for c in hyper.table.columns if c not in ends), F.col("edge_id").alias("source_id"), hyper.column(tag).alias("target_id"))
    return replace(graph, edges={**graph.edges, _EDGES: EdgeSet(table, _EDGES, hyper.ends[tag])})


def pool(graph: PropertyGraph, hyper: HyperAdjacency, tag: int, *, feature: str, reduce: str = "sum", width: int | None = None, name: str = "value") -> DataFrame:
    """(component_id, node_id, value): a feature of hyperedges pooled to the nodes at a tag; nodes without any get the reducer's empty value."""
    return message.pool(at_tag(graph, hyper, tag), TARGET, edge_sets=_EDGES, reduce=reduce, feature=feature, width=width, name=name)


def broadcast(graph: PropertyGraph, hyper: HyperAdjacency, tag: int, *, feature: str, name: str = "value") -> DataFrame:
    """Hyperedges with the value of their node at a tag; null where that isn't a node."""
    values = graph.nodes[hyper.ends[tag]].select("component_id", F.col("node_id").alias(f"node_{tag}"), F.col(feature).alias(name))
    return hyper.table.join(values, ["component_id", f"node_{tag}"], "left")


def pool_nodes(graph: PropertyGraph, hyper: HyperAdjacency, from_tag: int, to_tag: int, *, feature: str, reduce: str = "sum", width: int | None = None, name: str = "value") -> DataFrame:
    """A feature of the nodes at one tag pooled over shared hyperedges to those at another."""
    given = replace(hyper, table=broadcast(graph, hyper, from_tag, feature=feature, name="_value"))
    return pool(graph, given, to_tag, feature="_value", reduce=reduce, width=width, name=name)


def pool_tags(hyper: HyperAdjacency, tags: Sequence[int], *, feature: str, reduce: str = "sum", name: str = "value") -> DataFrame:
    """(component_id, tag, node_id, value): one feature pooled to the ends at several tags by one aggregation; ids need one type."""
    incidences = F.explode(F.array(*(F.struct(F.lit(t).alias("tag"), hyper.column(t).alias("node_id")) for t in tags))).alias("_end")
    rows = hyper.table.select("component_id", incidences, F.col(feature).alias("_value")).select("component_id", "_end.*", "_value").where("node_id is not null")
    return rows.groupBy("component_id", "tag", "node_id").agg(message.REDUCERS[reduce].agg(F.col("_value")).alias(name))


def softmax(hyper: HyperAdjacency, tag: int, *, feature: str, name: str = "softmax") -> DataFrame:
    """Hyperedges with exp(v - max) / sum over those that share their node at a tag.

    Largest values and sums are aggregated; those of nodes with a thousandth of all hyperedges or more are
    broadcast, so a node that most hyperedges share is no task's.
    """
    key = F.struct("component_id", f"node_{tag}").alias("_key")
    rows = hyper.table.select("*", key, F.col(feature).cast("double").alias("_v"))
    n = hyper.table.count()
    top = rows.groupBy("_key").agg(F.max("_v").alias("_top"), F.count("*").alias("_n"))
    shifted = attach_groups(rows, top, "_key", "_n", n).withColumn("_e", F.exp(F.col("_v") - F.col("_top"))).drop("_n")
    total = shifted.groupBy("_key").agg(F.sum("_e").alias("_sum"), F.count("*").alias("_n"))
    return attach_groups(shifted, total, "_key", "_n", n).select(*hyper.table.columns, (F.col("_e") / F.col("_sum")).alias(name))

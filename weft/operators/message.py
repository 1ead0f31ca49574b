"""Broadcast, pool, softmax and degree: values between edges, their ends and components.

Broadcasting is an N:1 join. Pooling aggregates first and then left-joins all receivers, so that each
receiver appears once, those without input with the reducer's identity. Several sets are pooled as if
they were one table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.graph import PropertyGraph, end_column
from weft.schema import CONTEXT, EDGES, NODES, SOURCE, TARGET, reverse_tag

FLOAT_MAX = 3.4028234663852886e38
#: Largest values of the types; the smallest float is minus its largest, that of integers one further.
_MOST = {"tinyint": 127, "smallint": 32767, "int": 2**31 - 1, "bigint": 2**63 - 1, "float": FLOAT_MAX, "double": 1.7976931348623157e308}


def _extreme(kind: T.DataType, low: bool) -> Column:
    name = kind.simpleString()
    if name.startswith("decimal"):
        return F.lit(("-" if low else "") + "9" * (kind.precision - kind.scale)).cast(kind)
    most = _MOST[name]
    return F.lit((-most if isinstance(most, float) else -most - 1) if low else most).cast(kind)


@dataclass(frozen=True)
class Reducer:
    """An aggregate of a column, and its value over nothing by the column's type."""

    agg: Callable[[Column], Column]
    empty: Callable[[T.DataType], Column]


def _zero(_: T.DataType) -> Column:
    return F.lit(0)


def _mean(c: Column) -> Column:
    return F.sum(c).cast("double") / F.count(c)


REDUCERS: dict[str, Reducer] = {
    "sum": Reducer(F.sum, _zero),
    "prod": Reducer(F.product, lambda _: F.lit(1)),
    "mean": Reducer(_mean, _zero),
    "max": Reducer(F.max, lambda t: _extreme(t, True)),
    "min": Reducer(F.min, lambda t: _extreme(t, False)),
    "max_no_inf": Reducer(F.max, _zero),
    "min_no_inf": Reducer(F.min, _zero),
    "_count": Reducer(F.count, _zero),
}


def register_reducer(name: str, reducer: Reducer) -> None:
    REDUCERS[name] = reducer


def reduce_names() -> list[str]:
    return sorted(n for n in REDUCERS if not n.startswith("_"))


def _aggregate(name: str, c: Column, kind: T.DataType, width: int | None) -> Column:
    """The aggregate of a scalar column, or element by element of arrays of a known width."""
    r = REDUCERS[name]
    own = kind.elementType if isinstance(kind, T.ArrayType) else kind

    def one(x: Column) -> Column:
        out = r.agg(x)
        if name.endswith("_no_inf"):  # an extreme of the type counts as nothing
            out = F.when(out != _extreme(own, name.startswith("max")), out)
        return out

    if not isinstance(kind, T.ArrayType):
        return one(c)
    if width is None:
        raise ValueError("arrays are pooled with their width")
    return F.array(*(one(c[i]) for i in range(width)))


def _empty(name: str, kind: T.DataType, width: int | None) -> Column:
    own = kind.elementType if isinstance(kind, T.ArrayType) else kind
    value = REDUCERS[name].empty(own)
    return F.array(*[value] * width) if isinstance(kind, T.ArrayType) else value


def _or(value: Column) -> Callable[[Column], Column]:
    return lambda x: F.coalesce(x, value)


def _names(x: str | Sequence[str] | None) -> list[str]:
    return [] if x is None else [x] if isinstance(x, str) else list(x)


def receivers(graph: PropertyGraph, tag: str, edge_sets: list[str]) -> str:
    """The node set at one end of all the edge sets."""
    found = {graph.edges[e].end(tag) for e in edge_sets}
    if len(found) != 1:
        raise ValueError(f"edge sets {edge_sets} don't share the node set at {tag}: {sorted(found)}")
    return found.pop()


def _values(graph: PropertyGraph, tag: str, edge_sets: list[str], node_sets: list[str], feature: str | Sequence[str]) -> tuple[DataFrame, list[str]]:
    """(keys, value) of all sets as one table."""
    if bool(edge_sets) == bool(node_sets):
        raise ValueError("either edge sets or node sets")
    if node_sets and tag != CONTEXT:
        raise ValueError("nodes are pooled to the context only")
    names = edge_sets or node_sets
    features = [feature] * len(names) if isinstance(feature, str) else list(feature)
    if len(features) != len(names):
        raise ValueError("one feature for each set")
    keys = ["component_id"] if tag == CONTEXT else ["component_id", "node_id"]
    out = None
    for n, f in zip(names, features, strict=True):
        df = graph.table(EDGES if edge_sets else NODES, n)
        own = df.select("component_id", *([F.col(end_column(tag)).alias("node_id")] if tag != CONTEXT else []), F.col(f).alias("value"))
        out = own if out is None else out.unionByName(own)
    return out, keys


def pool(graph: PropertyGraph, tag: str, *, edge_sets=None, node_sets=None, reduce: str = "sum", feature: str | Sequence[str], width: int | None = None, name: str = "value") -> DataFrame:
    """Pool a feature of edges to the nodes at an end, or of edges or nodes to components.

    ``a|b`` concatenates the results of several reducers, for array features of a given width.
    """
    edge_sets, node_sets = _names(edge_sets), _names(node_sets)
    values, keys = _values(graph, tag, edge_sets, node_sets, feature)
    kind = values.schema["value"].dataType
    ways = reduce.split("|")
    unknown = [w for w in ways if w not in REDUCERS]
    if unknown:
        raise ValueError(f"no reducer {unknown}")
    if len(ways) > 1 and not isinstance(kind, T.ArrayType):
        raise ValueError("several reducers need an array feature")
    pooled = values.groupBy(*keys).agg(*(_aggregate(w, F.col("value"), kind, width).alias(f"_{i}") for i, w in enumerate(ways)))
    to = graph.context().select("component_id") if tag == CONTEXT else graph.nodes[receivers(graph, tag, edge_sets)].select(*keys)
    joined = to.join(pooled, keys, "left")
    if isinstance(kind, T.ArrayType):
        parts = [F.coalesce(F.transform(f"_{i}", _or(REDUCERS[w].empty(kind.elementType))), _empty(w, kind, width)) for i, w in enumerate(ways)]
        out = F.concat(*parts) if len(parts) > 1 else parts[0]
    else:
        out = F.coalesce(F.col("_0"), _empty(ways[0], kind, None))
    return joined.select(*keys, out.alias(name))


def pool_edges_to_node(graph: PropertyGraph, edge_sets, tag: str, reduce: str = "sum", **how) -> DataFrame:
    return pool(graph, tag, edge_sets=edge_sets, reduce=reduce, **how)


def pool_nodes_to_context(graph: PropertyGraph, node_sets, reduce: str = "sum", **how) -> DataFrame:
    return pool(graph, CONTEXT, node_sets=node_sets, reduce=reduce, **how)


def pool_edges_to_context(graph: PropertyGraph, edge_sets, reduce: str = "sum", **how) -> DataFrame:
    return pool(graph, CONTEXT, edge_sets=edge_sets, reduce=reduce, **how)


def broadcast(graph: PropertyGraph, tag: str, *, edge_set: str | None = None, node_set: str | None = None, feature: str, name: str = "value") -> DataFrame:
    """A node's value on each of its edges, or a component's value on its nodes or edges."""
    if (edge_set is None) == (node_set is None):
        raise ValueError("either an edge set or a node set")
    if tag == CONTEXT:
        to = graph.table(EDGES if edge_set else NODES, edge_set or node_set)
        return to.join(graph.context().select("component_id", F.col(feature).alias(name)), "component_id", "left")
    if node_set is not None:
        raise ValueError("nodes get values from the context only")
    e = graph.edges[edge_set]
    values = graph.nodes[e.end(tag)].select("component_id", F.col("node_id").alias(end_column(tag)), F.col(feature).alias(name))
    return e.table.join(values, ["component_id", end_column(tag)], "left")


def broadcast_node_to_edges(graph: PropertyGraph, edge_set: str, tag: str, feature: str, name: str = "value") -> DataFrame:
    return broadcast(graph, tag, edge_set=edge_set, feature=feature, name=name)


def broadcast_context_to_nodes(graph: PropertyGraph, node_set: str, feature: str, name: str = "value") -> DataFrame:
    return broadcast(graph, CONTEXT, node_set=node_set, feature=feature, name=name)


def broadcast_context_to_edges(graph: PropertyGraph, edge_set: str, feature: str, name: str = "value") -> DataFrame:
    return broadcast(graph, CONTEXT, edge_set=edge_set, feature=feature, name=name)


def degree(graph: PropertyGraph, edge_set: str, tag: str, name: str = "degree") -> DataFrame:
    """Edges at each node, 0 where there are none."""
    e = graph.edges[edge_set]
    n = e.table.groupBy("component_id", F.col(end_column(tag)).alias("node_id")).agg(F.count("*").alias(name))
    nodes = graph.nodes[e.end(tag)].select("component_id", "node_id")
    return nodes.join(n, ["component_id", "node_id"], "left").withColumn(name, F.coalesce(name, F.lit(0)))


def pool_neighbors(graph: PropertyGraph, edge_sets, to_tag: str, *, feature: str, reduce: str = "sum", from_tag: str | None = None, width: int | None = None, name: str = "value") -> DataFrame:
    """Pool the feature of the nodes at the other end."""
    from_tag = from_tag or reverse_tag(to_tag)
    sets = _names(edge_sets)
    own = graph
    for s in sets:
        own = own.with_table(EDGES, s, broadcast(graph, from_tag, edge_set=s, feature=feature, name="_value").select("component_id", "edge_id", "source_id", "target_id", "_value"))
    return pool(own, to_tag, edge_sets=sets, reduce=reduce, feature="_value", width=width, name=name)


def with_pooled_neighbors(graph: PropertyGraph, edge_sets, to_tag: str, *, feature: str, name: str | None = None, **how) -> PropertyGraph:
    """pool_neighbors() as a feature of the receiving node set."""
    to, name = receivers(graph, to_tag, _names(edge_sets)), name or feature
    got = pool_neighbors(graph, edge_sets, to_tag, feature=feature, name="_pooled", **how)
    nodes = graph.nodes[to]
    return graph.with_table(NODES, to, nodes.drop(name).join(got, ["component_id", "node_id"], "left").withColumnRenamed("_pooled", name))


def softmax(graph: PropertyGraph, tag: str, *, edge_sets=None, node_sets=None, feature: str | Sequence[str], name: str = "softmax", few_components: bool = False) -> DataFrame:
    """exp(v - max) / sum over what shares a receiver, jointly over all the sets; rows carry ``set`` and the item's id.

    For a caller that knows of few components, ``few_components`` broadcasts their sums.
    """
    edge_sets, node_sets = _names(edge_sets), _names(node_sets)
    names = edge_sets or node_sets
    features = [feature] * len(names) if isinstance(feature, str) else list(feature)
    out = None
    for n, f in zip(names, features, strict=True):
        df = graph.table(EDGES if edge_sets else NODES, n)
        item = F.col("edge_id" if edge_sets else "node_id").alias("item_id")
        key = [F.col(end_column(tag)).alias("receiver_id")] if tag != CONTEXT else []
        own = df.select("component_id", *key, F.lit(n).alias("set"), item, F.col(f).cast("double").alias("value"))
        out = own if out is None else out.unionByName(own)
    if tag != CONTEXT:
        receivers(graph, tag, edge_sets)
    if tag == CONTEXT:  # a component may be the whole graph: largest values and sums are aggregated, not windowed
        top = out.groupBy("component_id").agg(F.max("value").alias("_top"))
        shifted = out.join(F.broadcast(top) if few_components else top, "component_id").withColumn("_e", F.exp(F.col("value") - F.col("_top")))
        total = shifted.groupBy("component_id").agg(F.sum("_e").alias("_sum"))
        return shifted.join(F.broadcast(total) if few_components else total, "component_id").withColumn(name, F.col("_e") / F.col("_sum")).drop("_e", "_top", "_sum")
    w = Window.partitionBy("component_id", "receiver_id")
    shifted = out.withColumn("_e", F.exp(F.col("value") - F.max("value").over(w)))
    return shifted.withColumn(name, F.col("_e") / F.sum("_e").over(w)).drop("_e")


def softmax_edges_per_node(graph: PropertyGraph, edge_sets, tag: str, feature, name: str = "softmax") -> DataFrame:
    return softmax(graph, tag, edge_sets=edge_sets, feature=feature, name=name)


def softmax_edges_per_component(graph: PropertyGraph, edge_sets, feature, name: str = "softmax") -> DataFrame:
    return softmax(graph, CONTEXT, edge_sets=edge_sets, feature=feature, name=name)


def softmax_nodes_per_component(graph: PropertyGraph, node_sets, feature, name: str = "softmax") -> DataFrame:
    return softmax(graph, CONTEXT, node_sets=node_sets, feature=feature, name=name)


__all__ = ["REDUCERS", "SOURCE", "TARGET", "Reducer", "broadcast", "degree", "pool", "pool_neighbors", "softmax"]

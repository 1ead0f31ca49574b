"""Run sampling plans: each hop is an equi-join of the frontier with the edges and a ranking window.

Draws are keyed by md5 of seed, op, sample, source and edge, so they are the same under any plan,
partitioning or retry. A frontier is the distinct nodes of its inputs by default; with
``dedup_frontier=False`` a node that is reached twice is sampled twice, independently. What ranks alike in
every sample (TOP_K, and LATEST_K without a time) is cut to the op's size once a source, before the frontier
is joined, and Spark plans that rank limit as a group limit on both sides of the exchange; so hubs are pruned
before any shuffle. Random draws, and draws as of a time, rank after the join, but uniform draws from edge sets
that have a position index (weft.plans.positions): those draw positions first and join only the edges drawn.

As of a time, edges later than it don't count; for edge sets named in ``state`` the version of each edge in
force then does (weft.plans.asof).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.graph import EdgeSet, PropertyGraph, default_value, position
from weft.operators.structure import keyed_random
from weft.plans.asof import edges_in_force
from weft.plans.positions import PositionIndex, draw
from weft.plans.spec import LATEST, TOP_K, UNIFORM, WEIGHTED, SamplingOp, SamplingSpec


def draw_order(strategy: str, seed: int, op: str, edges: DataFrame, weight: str, time: str, occurrence: bool) -> list[Column]:
    """How a hop ranks the edges of one source."""
    key = keyed_random(seed, F.lit(op), "sample_id", "source_id", "edge_id", *(["_n"] if occurrence else []))
    if strategy == UNIFORM:
        return [key, F.col("edge_id")]
    if strategy == TOP_K:
        return [F.col(weight).desc(), position(edges, "edge_id"), F.col("edge_id")]
    if strategy == LATEST:
        return [F.col(time).desc(), position(edges, "edge_id"), F.col("edge_id")]
    if strategy == WEIGHTED:  # Efraimidis and Spirakis: the largest ln(u) / weight
        u = (F.conv(F.substring(key, 1, 12), 16, 10).cast("double") + 1) / F.lit(2.0**48 + 1)
        return [(F.log(u) / F.col(weight)).desc(), F.col("edge_id")]
    raise ValueError(f"no strategy {strategy}")


def sample_hop(frontier: DataFrame, edges: DataFrame, op: SamplingOp, seed: int = 0, weight: str = "weight", time: str = "ts", occurrence: bool = False, index: PositionIndex | None = None, state: dict | None = None) -> DataFrame:
    """At most ``op.size`` edges of every (sample_id, node_id) of the frontier; edges with sample_id.

    Where the frontier has ``as_of``, only edges no later than that count, whatever the strategy. Weighted draws
    leave out weights that aren't positive. ``index`` serves uniform draws without a time; ``state`` holds the
    arguments of edges_in_force for frontiers with one.
    """
    e, timed = edges.drop("component_id"), "as_of" in frontier.columns
    if op.strategy == UNIFORM and index and not timed:
        return draw(frontier, index, op.size, seed, op.op_name, occurrence)
    if op.strategy in (TOP_K, LATEST) and not timed:
        w = Window.partitionBy("source_id").orderBy(*draw_order(op.strategy, seed, op.op_name, e, weight, time, occurrence))
        e = e.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= op.size).drop("_rank")
        return frontier.withColumnRenamed("node_id", "source_id").join(e, "source_id").drop("_n")
    near = frontier.withColumnRenamed("node_id", "source_id")
    if timed and state is not None:
        near = edges_in_force(e, near, time=time, **state)
    else:
        near = near.join(e, "source_id")
    if op.strategy == WEIGHTED:
        near = near.where(F.col(weight) > 0)
    if timed and state is None:
        near = near.where(F.col(time) <= F.col("as_of"))
    by = ["sample_id", "source_id", *(["_n"] if occurrence else [])]
    w = Window.partitionBy(*by).orderBy(*draw_order(op.strategy, seed, op.op_name, e, weight, time, occurrence))
    return near.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= op.size).drop("_rank", "_n")


def sample_edges(graph: PropertyGraph, spec: SamplingSpec, seeds: DataFrame, seed: int = 0, dedup_frontier: bool = True, weight: str = "weight", time: str = "ts", checkpoint: bool = False, index: dict[str, PositionIndex] | None = None, state: dict[str, dict] | None = None) -> dict[str, DataFrame]:
    """Sampled edges of each edge set: (sample_id, edge columns), one row for each distinct edge of a sample.

    ``seeds`` is (sample_id, node_id), with ``as_of`` for temporal plans. ``checkpoint`` writes each hop to
    the session's checkpoint folder, for plans of many hops. ``index`` and ``state`` are by edge set, as in sample_hop.
    """
    spec.check_order()
    extra = ["as_of"] if "as_of" in seeds.columns else []
    frontiers = {spec.seed.op_name: seeds.select("sample_id", "node_id", *extra)}
    found: dict[str, list[DataFrame]] = {}
    for op in spec.ops:
        front = frontiers[op.input_ops[0]]
        for i in op.input_ops[1:]:
            front = front.unionByName(frontiers[i])
        if dedup_frontier:
            front = front.distinct()
        else:
            front = front.withColumn("_n", F.row_number().over(Window.partitionBy("sample_id", "node_id").orderBy("node_id")))
        hop = sample_hop(front, graph.edges[op.edge_set].table, op, seed, weight, time, not dedup_frontier, (index or {}).get(op.edge_set), (state or {}).get(op.edge_set))
        if checkpoint:
            hop = hop.checkpoint()
        found.setdefault(op.edge_set, []).append(hop.drop("as_of"))
        frontiers[op.op_name] = hop.select("sample_id", F.col("target_id").alias("node_id"), *extra)
    out = {}
    for name, parts in found.items():
        df = parts[0]
        for p in parts[1:]:
            df = df.unionByName(p)
        out[name] = df.dropDuplicates(["sample_id", "edge_id"])
    return out


def sample(graph: PropertyGraph, spec: SamplingSpec, seeds: DataFrame, seed: int = 0, remove_parallel: bool = True, **how) -> PropertyGraph:
    """Samples as a graph with a component for each sample.

    Seeds are nodes even without edges and come first; nodes without a row in their node table get default
    features; samples without seeds stay as empty components (rows of ``seeds`` with a null node_id).
    """
    from weft.operators.structure import remove_parallel_edges

    edges = sample_edges(graph, spec, seeds.where("node_id is not null"), seed, **how)
    reached: dict[str, DataFrame] = {}

    def add(name: str, df: DataFrame) -> None:
        reached[name] = reached[name].unionByName(df) if name in reached else df

    starts = seeds.where("node_id is not null").select("sample_id", "node_id", F.lit(0).alias("_depth"))
    add(spec.seed.node_set, starts)
    sets = {}
    for name, df in edges.items():
        e = graph.edges[name]
        add(e.source, df.select("sample_id", F.col("source_id").alias("node_id"), F.lit(1).alias("_depth")))
        add(e.target, df.select("sample_id", F.col("target_id").alias("node_id"), F.lit(1).alias("_depth")))
        sets[name] = EdgeSet(df.withColumnRenamed("sample_id", "component_id"), e.source, e.target)
    nodes = {}
    for name, df in reached.items():
        first = df.groupBy("sample_id", "node_id").agg(F.min("_depth").alias("_depth"))
        w = Window.partitionBy("sample_id").orderBy("_depth", "node_id")
        numbered = first.select(F.col("sample_id").alias("component_id"), "node_id", (F.row_number().over(w) - 1).cast("long").alias("pos"))
        nodes[name] = with_features(numbered, graph.nodes.get(name))
    context = seeds.select(F.col("sample_id").alias("component_id")).distinct()
    out = PropertyGraph(nodes, sets, context)
    for name in sets if remove_parallel else ():
        out = remove_parallel_edges(out, name)
    return out


def with_features(nodes: DataFrame, table: DataFrame | None) -> DataFrame:
    """Features of nodes by id; what the table lacks gets 0, false or the empty string."""
    if table is None:
        return nodes
    features = [c for c in table.columns if c not in ("component_id", "node_id", "pos")]
    out = nodes.join(table.select("node_id", *features), "node_id", "left")
    kinds = {f.name: f.dataType for f in table.schema.fields}
    return out.select(*nodes.columns, *(F.coalesce(F.col(c), default_value(kinds[c])).alias(c) for c in features))


def sample_links(graph: PropertyGraph, spec: SamplingSpec, links: DataFrame, seed: int = 0, target_spec: SamplingSpec | None = None, **how) -> PropertyGraph:
    """Samples around links (sample_id, source, target, features): both ends are seeds, and a ``_readout`` node names them.

    With a ``target_spec`` the ends are sampled by a plan each and the samples merged.
    """
    from weft.operators.structure import concat_graphs, remove_parallel_edges, unique_nodes

    ends = lambda c: links.select("sample_id", F.col(c).alias("node_id"))
    if target_spec is None:
        out = sample(graph, spec, ends("source").unionByName(ends("target")).distinct(), seed, **how)
        to = spec.seed.node_set
    else:
        out = concat_graphs([sample(graph, spec, ends("source"), seed, **how), sample(graph, target_spec, ends("target"), seed, **how)])
        for n in out.nodes:
            out = unique_nodes(out, n)
        for n in out.edges:
            out = remove_parallel_edges(out, n)
        to = target_spec.seed.node_set
    return add_link_readout(out, links, spec.seed.node_set, to)


def add_link_readout(graph: PropertyGraph, links: DataFrame, source_set: str, target_set: str) -> PropertyGraph:
    """A ``_readout`` node for each link, with its features, and edges ``_readout/source`` and ``_readout/target`` to it."""
    features = [c for c in links.columns if c not in ("sample_id", "source", "target")]
    rows = links.select(F.col("sample_id").alias("component_id"), F.lit(0).cast("long").alias("node_id"), "source", "target", *features)
    out = graph.with_table("nodes", "_readout", rows.select("component_id", "node_id", *features))
    for tag, to in (("source", source_set), ("target", target_set)):
        e = rows.select("component_id", F.lit(0).cast("long").alias("edge_id"), F.col(tag).alias("source_id"), F.col("node_id").alias("target_id"))
        out = out.with_edges(f"_readout/{tag}", e, to, "_readout")
    return out

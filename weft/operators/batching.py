"""Size budgets: counts by component, constraints, padding to exact totals, and packing graphs into batches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.graph import EdgeSet, PropertyGraph, default_value
from weft.operators.greedy import greedy_batches
from weft.schema import aux_prefix


@dataclass(frozen=True)
class SizeConstraints:
    """At most (or, for padding, exactly) so many components, nodes and edges; at least so many nodes a component."""

    components: int
    nodes: dict[str, int] = field(default_factory=dict)
    edges: dict[str, int] = field(default_factory=dict)
    least_nodes: dict[str, int] = field(default_factory=dict)


@dataclass(frozen=True)
class DefaultValues:
    """What padding gets as features: (kind, set) -> {feature: value}; others are 0, false or empty."""

    values: dict[tuple[str, str], dict[str, object]] = field(default_factory=dict)


def size_columns(graph: PropertyGraph) -> dict[tuple[str, str], str]:
    return {("nodes", n): f"nodes_{i}" for i, n in enumerate(graph.nodes)} | {("edges", n): f"edges_{i}" for i, n in enumerate(graph.edges)}


def sizes(graph: PropertyGraph, key: str = "component_id") -> DataFrame:
    """Nodes and edges of every set for each component (0 where it has none), in one row: columns by size_columns()."""
    cols = size_columns(graph)
    rows = graph.context().select(key, F.lit(None).cast("string").alias("_set"))
    for (kind, name), c in cols.items():
        rows = rows.unionByName(graph.table(kind, name).select(key, F.lit(c).alias("_set")))
    counts = rows.groupBy(key).agg(F.max(F.col("_set").isNull()).alias("_known"), *(F.count(F.when(F.col("_set") == c, 1)).alias(c) for c in cols.values()))
    return counts.where("_known").drop("_known")


def satisfies(graph: PropertyGraph, limits: SizeConstraints) -> DataFrame:
    """(component_id, ok): whether each component fits the budget by itself."""
    ok: Column = F.lit(limits.components >= 1)
    for (kind, name), c in size_columns(graph).items():
        most = (limits.nodes if kind == "nodes" else limits.edges).get(name)
        if most is not None:
            ok = ok & (F.col(c) <= most)
    return sizes(graph).select("component_id", ok.alias("ok"))


def satisfies_total(graph: PropertyGraph, limits: SizeConstraints) -> bool:
    """Whether the whole graph, as it is, fits with room for padding."""
    try:
        assert_satisfies_total(graph, limits)
    except ValueError:
        return False
    return True


def assert_satisfies_total(graph: PropertyGraph, limits: SizeConstraints) -> None:
    cols = size_columns(graph)
    total = sizes(graph).agg(F.count("*").alias("components"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in cols.values())).first()
    if total.components > limits.components:
        raise ValueError(f"{total.components} components; the budget is {limits.components}")
    for (kind, name), c in cols.items():
        most = (limits.nodes if kind == "nodes" else limits.edges).get(name)
        if most is not None and total[c] > most:
            raise ValueError(f"{total[c]} {kind} of {name}; the budget is {most}")
    for name, edges in limits.edges.items():
        more = edges - total[cols["edges", name]]
        e = graph.edges[name]
        if more and (total.components >= limits.components or any(total[cols["nodes", n]] >= limits.nodes.get(n, 1 << 62) for n in (e.source, e.target))):
            raise ValueError(f"padding edges of {name} need a padding component with nodes")


def make_room(limits: SizeConstraints, graph: PropertyGraph, least_nodes: dict[str, int] | None = None) -> SizeConstraints:
    """One more component, and a node for padding edges to join in each node set that has edges."""
    least = least_nodes or {}
    ends = {n for e in graph.edges.values() for n in (e.source, e.target)}
    nodes = {n: k + max(least.get(n, 0), int(n in ends)) for n, k in limits.nodes.items()}
    return SizeConstraints(limits.components + 1, nodes, dict(limits.edges), dict(least))


def tight_constraints(graph: PropertyGraph, batch: int = 1, least_nodes: dict[str, int] | None = None) -> SizeConstraints:
    """The smallest budget that any ``batch`` of these components fits: largest sizes times the batch, and room for padding."""
    cols = size_columns(graph)
    top = sizes(graph).agg(*(F.coalesce(F.max(c), F.lit(0)).alias(c) for c in cols.values())).first()
    limits = SizeConstraints(batch, {n: top[c] * batch for (k, n), c in cols.items() if k == "nodes"}, {n: top[c] * batch for (k, n), c in cols.items() if k == "edges"})
    return make_room(limits, graph, least_nodes)


def learn_constraints(graph: PropertyGraph, batch: int, success: float = 0.99, trials: int = 1000, seed: int = 0, least_nodes: dict[str, int] | None = None, step: float = 0.01) -> SizeConstraints:
    """A budget that a share ``success`` of random batches fits, as small as one common quantile level can make it.

    Batches are drawn in Spark (hash of trial and component); only their totals, ``trials`` rows, come to the driver.
    """
    cols = size_columns(graph)
    own = sizes(graph)
    n = own.count()
    if not n:
        raise ValueError("no components to learn from")
    share = min(1.0, batch * trials / n)
    rows = own.where(F.pmod(F.xxhash64(F.lit(seed), "component_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    # every drawn component joins as many batches as keep their number at ``trials``, each by another hash
    repeat = max(1, -(-batch * trials // max(1, int(n * share))))
    dealt = rows.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(repeat)))).withColumn("_batch", F.pmod(F.xxhash64(F.lit(seed + 1), "component_id", "_k"), F.lit(trials)))
    totals = dealt.groupBy("_batch").agg(F.count("*").alias("_n"), *((F.sum(c) * batch / F.count("*")).alias(c) for c in cols.values())).toPandas()
    names = list(cols.values())
    x = totals[names].to_numpy(float)
    level = 1.0
    best = x.max(0)
    while level > step:
        level -= step
        q = np.quantile(x, level, axis=0)
        if (x <= q).all(1).mean() < success:
            break
        best = q
    most = {k: int(np.ceil(v)) for k, v in zip(names, best, strict=True)}
    limits = SizeConstraints(batch, {n: most[c] for (k, n), c in cols.items() if k == "nodes"}, {n: most[c] for (k, n), c in cols.items() if k == "edges"})
    return make_room(limits, graph, least_nodes)


def pad_to_totals(graph: PropertyGraph, limits: SizeConstraints, defaults: DefaultValues | None = None, pad_component: object = -1) -> tuple[PropertyGraph, DataFrame]:
    """Add components, nodes and edges up to exact totals; the graph and (component_id, real).

    Padding nodes and edges are in the first padding component; padding edges are spread evenly over
    its nodes. The padded components are numbered down from ``pad_component``, as the ids' type allows.
    """
    assert_satisfies_total(graph, limits)
    spark, values = graph.spark, (defaults or DefaultValues()).values
    cols = size_columns(graph)
    total = sizes(graph).agg(F.count("*").alias("components"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in cols.values())).first()
    context = graph.context()
    kind = context.schema["component_id"].dataType
    number = lambda c: (F.lit(pad_component) - c if kind.simpleString() != "string" else F.concat(F.lit("pad"), c.cast("string"))).cast(kind)

    def filled(df: DataFrame, of: tuple[str, str], n: int, keys: dict[str, Column]) -> DataFrame:
        own = values.get(of, {})
        rows = spark.range(n)
        cells = [(keys[f.name] if f.name in keys else F.lit(own[f.name]) if f.name in own else F.lit(None) if f.name == "pos" else default_value(f.dataType)).cast(f.dataType).alias(f.name) for f in df.schema.fields]
        return df.unionByName(rows.select(*cells))

    first = number(F.lit(0))
    out = replace(graph, context_table=filled(context, ("context", ""), limits.components - total.components, {"component_id": number(F.col("id"))}))
    room: dict[str, int] = {}
    for n, df in graph.nodes.items():
        room[n] = limits.nodes.get(n, total[cols["nodes", n]]) - total[cols["nodes", n]]
        out = out.with_table("nodes", n, filled(df, ("nodes", n), room[n], {"component_id": first, "node_id": -1 - F.col("id")}))
    for n, e in graph.edges.items():
        more = limits.edges.get(n, total[cols["edges", n]]) - total[cols["edges", n]]
        at = lambda s: -1 - F.floor(F.col("id") * F.lit(max(1, room[s])) / F.lit(max(1, more)))
        rows = filled(e.table, ("edges", n), more, {"component_id": first, "edge_id": -1 - F.col("id"), "source_id": at(e.source), "target_id": at(e.target)})
        out = out.with_table("edges", n, rows)
    mask = context.select("component_id", F.lit(True).alias("real")).unionByName(spark.range(limits.components - total.components).select(number(F.col("id")).alias("component_id"), F.lit(False).alias("real")))
    return out, mask


def dynamic_batches(sized: DataFrame, limits: dict[str, int], order: list[str], shard: str | None = None) -> DataFrame:
    """Greedy packing of consecutive graphs: ``batch`` numbers added to rows of sizes.

    Rows go in order into the open batch; one that would break a budget starts the next; one that breaks a
    budget alone raises. Over the whole table batches are found in parallel (weft.operators.greedy). With a
    ``shard`` column, whose groups must be bounded, each group is packed by one task and batches never span groups.
    """
    if not shard:
        return greedy_batches(sized, limits, order)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        used, batch, out = dict.fromkeys(limits, 0), 0, []
        for row in pdf[list(limits)].itertuples(index=False):
            size = dict(zip(limits, row, strict=True))
            if over := [k for k, v in size.items() if v > limits[k]]:
                raise ValueError(f"a graph alone breaks the budget of {over}")
            if any(used[k] + v > limits[k] for k, v in size.items()):
                used, batch = dict.fromkeys(limits, 0), batch + 1
            used = {k: used[k] + v for k, v in size.items()}
            out.append(batch)
        return pdf.assign(batch=out)

    kind = T.StructType([*sized.schema.fields, T.StructField("batch", T.LongType())])
    return sized.groupBy(shard).applyInPandas(pack, kind)


def filter_observed(df: DataFrame, keep: Column, name: str = "filter") -> tuple[DataFrame, object]:
    """Rows that pass, and an Observation that after an action holds ``seen`` and ``removed``."""
    from pyspark.sql import Observation

    seen = Observation(name)
    flag = F.coalesce(keep, F.lit(False))
    return df.observe(seen, F.count(F.lit(1)).alias("seen"), F.sum(F.when(flag, 0).otherwise(1)).alias("removed")).where(flag), seen


def one_node_per_component(graph: PropertyGraph) -> dict[str, int]:
    return {n: 1 for n in graph.nodes if aux_prefix(n) is None}


@dataclass(frozen=True)
class FitOrSkip:
    """A learned budget: components that don't fit by themselves are dropped."""

    limits: SizeConstraints

    def __call__(self, graph: PropertyGraph) -> PropertyGraph:
        ok = satisfies(graph, self.limits).where("ok").select("component_id")
        keep = lambda df: df.join(ok, "component_id", "left_semi")
        return PropertyGraph({n: keep(x) for n, x in graph.nodes.items()}, {n: EdgeSet(keep(e.table), e.source, e.target) for n, e in graph.edges.items()}, keep(graph.context()))


@dataclass(frozen=True)
class Tight:
    """The tight budget of a graph for batches of a size; nothing is dropped."""

    batch: int

    def limits(self, graph: PropertyGraph) -> SizeConstraints:
        return tight_constraints(graph, self.batch, one_node_per_component(graph))


def micro_batches(df: DataFrame, fn, schema: str, rows: int = 10_000) -> DataFrame:
    """Apply ``fn(pandas.DataFrame)`` to Arrow batches of a partition, at most ``rows`` at a time."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for i in range(0, b.num_rows, rows):
                yield pa.RecordBatch.from_pandas(fn(b.slice(i, rows).to_pandas()), preserve_index=False)

    return df.mapInArrow(run, schema)

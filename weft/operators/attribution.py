"""Integrated gradients of message-passing models with given weights.

A model is a list of steps, each of which sets one node set's states to act(W x + U pool(neighbours) + b), and a
readout that sums w . x over a node set in each component. Along the straight path from a baseline to the features
the model runs on all points at once, as components (component, point); derivatives go backwards through the same
tables: through an activation by its derivative at the kept pre-activation, through W and U by their transposes,
and through pooling by the edges, from receivers back to senders. Attributions are the mean derivative along the
path times the way from the baseline; summed over a component they come to the model's value less the baseline's.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.graph import EdgeSet, PropertyGraph
from weft.operators import message
from weft.operators.layers import KEY, Matrix, activate, add
from weft.schema import reverse_tag


@dataclass(frozen=True)
class Step:
    """States of the edge set's end at ``tag``: its own times ``own``, plus the other end's pooled ones times ``other``, plus bias."""

    edge_set: str
    tag: str
    own: Matrix
    other: Matrix
    bias: Sequence[float]
    activation: str = "linear"
    reduce: str = "sum"


def _times(x: Column, m: Matrix, width: int) -> Column:
    return F.array(*(sum((x[i] * float(m[i][j]) for i in range(len(m))), F.lit(0.0)) for j in range(width)))


def _transposed(g: Column, m: Matrix) -> Column:
    return F.array(*(sum((g[j] * float(v) for j, v in enumerate(row)), F.lit(0.0)) for row in m))


def _slope(name: str, z: Column) -> Column:
    """The derivative of an activation at its argument."""
    if name == "linear":
        return F.lit(1.0)
    if name == "relu":
        return F.when(z > 0, 1.0).otherwise(0.0)
    if name == "leaky_relu":
        return F.when(z > 0, 1.0).otherwise(0.2)
    if name == "elu":
        return F.when(z > 0, 1.0).otherwise(F.exp(z))
    if name == "tanh":
        return 1 - F.tanh(z) * F.tanh(z)
    if name == "sigmoid":
        return F.exp(-z) / ((1 + F.exp(-z)) * (1 + F.exp(-z)))
    if name == "gelu":
        u = 0.7978845608028654 * (z + 0.044715 * z * z * z)
        return (1 + F.tanh(u)) * 0.5 + z * 0.5 * (1 - F.tanh(u) * F.tanh(u)) * 0.7978845608028654 * (1 + 3 * 0.044715 * z * z)
    raise ValueError(f"no activation {name}")


def _activated(name: str) -> Column:
    return F.transform("z", lambda z: activate(name, z))


def _through(name: str) -> Column:
    return F.zip_with("g", "z", lambda g, z: g * _slope(name, z))


def _zero(width: int) -> Column:
    return F.array(*[F.lit(0.0)] * width)


class Run:
    """A model's forward pass over (component, node, x) tables of node sets, with what the backward pass needs."""

    def __init__(self, graph: PropertyGraph, widths: dict[str, int], steps: Sequence[Step]) -> None:
        self.graph, self.steps = graph, list(steps)
        self.state = {n: graph.nodes[n].select(*KEY, F.col("x")) for n in widths}
        self.width, self.kept = dict(widths), []
        for s in self.steps:
            e = graph.edges[s.edge_set]
            to, of = e.end(s.tag), e.end(reverse_tag(s.tag))
            if s.reduce not in ("sum", "mean"):
                raise ValueError("derivatives go through sums and means")
            now = PropertyGraph(self.state, graph.edges, graph.context_table)
            pooled = message.pool_neighbors(now, s.edge_set, s.tag, feature="x", reduce=s.reduce, width=self.width[of], name="_p")
            width = len(s.bias)
            z = add(add(_times(F.col("x"), s.own, width), _times(F.col("_p"), s.other, width)), F.array(*(F.lit(float(b)) for b in s.bias)))
            own = self.state[to].join(pooled, KEY).select(*KEY, z.alias("z"))
            self.kept.append((to, of, own, self.width[to], self.width[of]))
            self.state[to] = own.select(*KEY, _activated(s.activation).alias("x"))
            self.width[to] = width

    def value(self, node_set: str, weights: Sequence[float]) -> DataFrame:
        """(component_id, value): the readout."""
        y = sum((F.col("x")[i] * float(w) for i, w in enumerate(weights)), F.lit(0.0))
        return self.state[node_set].groupBy("component_id").agg(F.sum(y).alias("value"))

    def gradients(self, node_set: str, weights: Sequence[float]) -> dict[str, DataFrame]:
        """By node set (component_id, node_id, g): the readout's derivative by each of its first states."""
        grads = {node_set: self.state[node_set].select(*KEY, F.array(*(F.lit(float(w)) for w in weights)).alias("g"))}
        for s, (to, of, own, own_width, of_width) in reversed(list(zip(self.steps, self.kept, strict=True))):
            if to not in grads:
                continue
            through = grads.pop(to).join(own, KEY).select(*KEY, _through(s.activation).alias("g"))
            back = through.select(*KEY, _transposed(F.col("g"), s.other).alias("x"))
            if s.reduce == "mean":
                n = message.degree(PropertyGraph({to: own.select(*KEY)}, {s.edge_set: self.graph.edges[s.edge_set]}), s.edge_set, s.tag)
                back = back.join(n, KEY).select(*KEY, F.transform("x", lambda v: v / F.greatest(F.col("degree"), F.lit(1))).alias("x"))
            e = self.graph.edges[s.edge_set]
            senders = self.graph.nodes[of].select(*KEY, _zero(of_width).alias("x"))
            # a set that is both ends sends and receives as two
            both = PropertyGraph({"_to": back, "_of": senders}, {s.edge_set: EdgeSet(e.table, *(("_to", "_of") if s.tag == "source" else ("_of", "_to")))})
            sent = message.pool_neighbors(both, s.edge_set, reverse_tag(s.tag), feature="x", width=of_width, name="g")
            parts = {to: [through.select(*KEY, _transposed(F.col("g"), s.own).alias("g"))]}
            parts.setdefault(of, []).append(sent.select(*KEY, "g"))
            for n, found in parts.items():
                if n in grads:
                    found = [*found, grads[n]]
                total = found[0]
                for f in found[1:]:
                    total = total.unionByName(f)
                width = own_width if n == to else of_width
                grads[n] = total if len(found) == 1 else total.groupBy(*KEY).agg(F.array(*(F.sum(F.col("g")[i]) for i in range(width))).alias("g"))
        return grads


def integrated_gradients(graph: PropertyGraph, features: dict[str, tuple[str, int]], steps: Sequence[Step], readout: str, weights: Sequence[float], points: int = 32, baseline: float = 0.0) -> tuple[dict[str, DataFrame], DataFrame]:
    """Attributions by node set, (component_id, node_id, attribution), and (component_id, value, baseline) of the model.

    ``features`` names each node set's array of doubles and its width; the baseline has one value everywhere. The path is
    taken at the middles of ``points`` equal parts.
    """
    spark = graph.spark
    at = spark.range(points + 2).select(((F.col("id") - 0.5) / points).alias("t"))
    # the path's points, and both of its ends for the model's values
    at = at.withColumn("t", F.when(F.col("t") < 0, 0.0).when(F.col("t") > 1, 1.0).otherwise(F.col("t"))).withColumn("inside", (F.col("t") > 0) & (F.col("t") < 1))
    at = F.broadcast(at)
    point = lambda df: df.crossJoin(at.select("t")).withColumn("component_id", F.struct("component_id", "t")).drop("t")
    moved = lambda c: F.transform(c, lambda v: F.lit(baseline) + (v - baseline) * F.col("t"))
    nodes = {n: graph.nodes[n].select(*KEY, F.col(f).cast("array<double>").alias("x")) for n, (f, _) in features.items()}
    path = {n: df.crossJoin(at.select("t")).select(F.struct("component_id", "t").alias("component_id"), "node_id", moved("x").alias("x")) for n, df in nodes.items()}
    edges = {s.edge_set: EdgeSet(point(graph.edges[s.edge_set].table), graph.edges[s.edge_set].source, graph.edges[s.edge_set].target) for s in steps}
    run = Run(PropertyGraph(path, edges), {n: w for n, (_, w) in features.items()}, steps)
    out = {}
    for n, g in run.gradients(readout, weights).items():
        width = features[n][1]
        mean = g.where("component_id.t > 0 and component_id.t < 1").groupBy(F.col("component_id.component_id").alias("component_id"), "node_id").agg(F.array(*(F.sum(F.col("g")[i]) / points for i in range(width))).alias("_g"))
        out[n] = nodes[n].join(mean, KEY).select(*KEY, F.zip_with("x", "_g", lambda x, g: (x - baseline) * g).alias("attribution"))
    ends = run.value(readout, weights).where("component_id.t = 0 or component_id.t = 1")
    values = ends.groupBy(F.col("component_id.component_id").alias("component_id")).agg(F.max(F.when(F.col("component_id.t") == 1, F.col("value"))).alias("value"), F.max(F.when(F.col("component_id.t") == 0, F.col("value"))).alias("baseline"))
    return out, values



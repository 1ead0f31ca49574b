"""Message-passing layers as queries: inference with weights that the caller supplies.

States are arrays. Dense maps are unrolled into sums of products, so they stay in generated code; a
node's projection is computed once, before it's joined to its edges.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.graph import PropertyGraph, end_column
from weft.operators.message import pool, receivers
from weft.operators.structure import spread
from weft.schema import CONTEXT, EDGES, NODES, SOURCE, TARGET, reverse_tag

Matrix = Sequence[Sequence[float]]
KEY = ["component_id", "node_id"]


@dataclass(frozen=True)
class Dense:
    """x W + b, then an activation; W has a row for each input."""

    weights: Matrix
    bias: Sequence[float] | None = None
    activation: str = "linear"

    @property
    def width(self) -> int:
        return len(self.weights[0])

    def __call__(self, x: Column) -> Column:
        b = self.bias or [0.0] * self.width
        return F.array(*(activate(self.activation, sum((x[i] * float(row[j]) for i, row in enumerate(self.weights)), F.lit(float(b[j])))) for j in range(self.width)))


def activate(name: str, x: Column) -> Column:
    if name == "linear":
        return x
    if name == "relu":
        return F.greatest(x, F.lit(0.0))
    if name == "leaky_relu":
        return F.when(x > 0, x).otherwise(x * 0.2)
    if name == "elu":
        return F.when(x > 0, x).otherwise(F.exp(x) - 1)
    if name == "tanh":
        return F.tanh(x)
    if name == "sigmoid":
        return 1 / (1 + F.exp(-x))
    if name == "gelu":
        return x * 0.5 * (1 + F.tanh(0.7978845608028654 * (x + 0.044715 * x * x * x)))
    raise ValueError(f"no activation {name}")


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def scale(a: Column, s: Column) -> Column:
    return F.transform(a, lambda x: x * s)


def l2_normalize(x: Column) -> Column:
    n = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    return F.transform(x, lambda v: F.when(n > 0, v / n).otherwise(0.0))


def layer_norm(x: Column, width: int, eps: float = 1e-3) -> Column:
    mean = F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / width
    var = F.aggregate(x, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean)) / width
    return F.transform(x, lambda v: (v - mean) / F.sqrt(var + eps))


def messages(graph: PropertyGraph, edge_set: str, receiver: str, node: str | None = "state", edge: str | None = None, receiver_feature: str | None = None, map_node: Callable[[Column], Column] | None = None) -> DataFrame:
    """Edges as (component_id, edge_id, node_id of the receiver, sender, edge, receiver states); what isn't asked for is left out.

    ``receiver`` is source, target or context; edges to the context have the source node as sender.
    """
    e = graph.edges[edge_set]
    sender_tag = SOURCE if receiver == CONTEXT else reverse_tag(receiver)
    cols = [F.col("component_id"), F.col("edge_id"), F.col(end_column(sender_tag)).alias("_s")]
    if receiver != CONTEXT:
        cols.append(F.col(end_column(receiver)).alias("node_id"))
    if edge:
        cols.append(F.col(edge).alias("edge"))
    out = e.table.select(*cols)
    if node:
        x = F.col(node)
        s = graph.nodes[e.end(sender_tag)].select("component_id", F.col("node_id").alias("_s"), (map_node(x) if map_node else x).alias("sender"))
        out = out.join(s, ["component_id", "_s"])
    if receiver_feature:
        if receiver == CONTEXT:
            out = out.join(graph.context().select("component_id", F.col(receiver_feature).alias("receiver")), "component_id")
        else:  # what follows is by receiver too, so this deals out all of its rows
            out = spread(out, e.table.count(), *KEY).join(graph.nodes[e.end(receiver)].select("component_id", "node_id", F.col(receiver_feature).alias("receiver")), KEY)
    return out.drop("_s")


def pooled(graph: PropertyGraph, edge_set: str, receiver: str, msg: DataFrame, reduce: str, width: int) -> DataFrame:
    """Pool message arrays; every receiver has a row (component_id[, node_id], value)."""
    e = graph.edges[edge_set]
    key = "node_id" if receiver != CONTEXT else None
    table = msg.select("component_id", "edge_id", *([F.col(key).alias(end_column(receiver))] if key else []), "message")
    return pool(graph.with_edges(edge_set, table, e.source, e.target), receiver, edge_sets=edge_set, reduce=reduce, feature="message", width=width)


def simple_conv(graph: PropertyGraph, edge_set: str, dense: Dense, receiver: str = TARGET, reduce: str = "sum", node: str | None = "state", edge: str | None = None, receiver_feature: str | None = None) -> DataFrame:
    """Pool of dense(sender ++ edge ++ receiver) over each receiver's edges; the inputs that are named."""
    m = messages(graph, edge_set, receiver, node, edge, receiver_feature)
    parts = [F.col(c) for c, on in (("sender", node), ("edge", edge), ("receiver", receiver_feature)) if on]
    return pooled(graph, edge_set, receiver, m.withColumn("message", dense(F.concat(*parts))), reduce, dense.width)


def gcn_conv(graph: PropertyGraph, edge_set: str, dense: Dense, receiver: str = TARGET, node: str = "state", weight: str | None = None, self_loops: bool = False, normalization: str = "in_out") -> DataFrame:
    """Graph convolution with degree normalization none, in, out, in_out or in_in.

    A degree is the sum of edge weights, plus 1 with self loops, else at least 1. Self loops aren't made as
    edges: each node's own message joins after pooling.
    """
    e = graph.edges[edge_set]
    sender = reverse_tag(receiver)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    edges = e.table.select("component_id", "edge_id", F.col(end_column(sender)).alias("_s"), F.col(end_column(receiver)).alias("node_id"), w.alias("_w"))
    nodes = graph.nodes[e.end(receiver)]

    def degrees(by: str, name: str, of: DataFrame) -> DataFrame:
        d = edges.groupBy("component_id", F.col(by).alias("node_id")).agg(F.sum("_w").alias("_d"))
        d = of.select(*KEY).join(d, KEY, "left")
        got = F.coalesce("_d", F.lit(0.0))
        return d.select(*KEY, (got + 1 if self_loops else F.greatest(got, F.lit(1.0))).alias(name))

    if normalization not in ("none", "in", "out", "in_out", "in_in"):
        raise ValueError(f"no normalization {normalization}")
    plain = Dense(dense.weights)  # bias and activation come after pooling
    states = graph.nodes[e.end(sender)].select("component_id", F.col("node_id").alias("_s"), plain(F.col(node)).alias("sender"))
    m = edges.join(states, ["component_id", "_s"])
    own = nodes.select(*KEY, plain(F.col(node)).alias("_own")) if self_loops else None
    factor = F.col("_w")
    loop = F.lit(1.0)
    d_in = degrees("node_id", "_in", nodes)
    d_out = degrees("_s", "_out", graph.nodes[e.end(sender)])
    if normalization in ("in", "in_out", "in_in"):
        m = m.join(d_in, KEY)
        p = F.col("_in") if normalization == "in" else F.sqrt("_in")
        factor, loop = factor / p, loop / p
    if normalization in ("out", "in_out", "in_in"):
        other = d_in if normalization == "in_in" else d_out
        m = m.join(other.select("component_id", F.col("node_id").alias("_s"), F.col(other.columns[-1]).alias("_od")), ["component_id", "_s"])
        factor = factor / (F.col("_od") if normalization == "out" else F.sqrt("_od"))
    out = pooled(graph, edge_set, receiver, m.withColumn("message", scale(F.col("sender"), factor)), "sum", dense.width)
    if self_loops:
        out = out.join(own, KEY).join(d_in, KEY).join(d_out, KEY)
        if normalization in ("out", "in_out", "in_in"):
            o = F.col("_in") if normalization == "in_in" else F.col("_out")
            loop = loop / (o if normalization == "out" else F.sqrt(o))
        out = out.withColumn("value", add(F.col("value"), scale(F.col("_own"), loop)))
    b = dense.bias or [0.0] * dense.width
    return out.select(*KEY, F.array(*(activate(dense.activation, F.col("value")[j] + float(b[j])) for j in range(dense.width))).alias("value"))


def sage_mean(graph: PropertyGraph, edge_set: str, dense: Dense, receiver: str = TARGET, reduce: str = "mean", node: str = "state", width: int | None = None) -> DataFrame:
    """dense(pool of the neighbours' states); the pool is over the input width."""
    width = width or len(dense.weights)
    m = messages(graph, edge_set, receiver, node).withColumnRenamed("sender", "message")
    out = pooled(graph, edge_set, receiver, m, reduce, width)
    return out.withColumn("value", dense(F.col("value")))


def sage_pool(graph: PropertyGraph, edge_set: str, hidden: Dense, dense: Dense, receiver: str = TARGET, reduce: str = "max_no_inf", node: str = "state") -> DataFrame:
    """dense(pool of hidden(state)) over the neighbours; hidden is computed once a node."""
    m = messages(graph, edge_set, receiver, node, map_node=hidden).withColumnRenamed("sender", "message")
    return pooled(graph, edge_set, receiver, m, reduce, hidden.width).withColumn("value", dense(F.col("value")))


def sage_next_state(own: DataFrame, inputs: Sequence[DataFrame], dense: Dense, node: str = "state", combine: str = "sum", normalize: bool = True, bias: Sequence[float] | None = None, activation: str = "relu") -> DataFrame:
    """dense(own state) with the pooled inputs, by sum or concatenation, L2-normalized."""
    out = own.select(*KEY, dense(F.col(node)).alias("_x"))
    width = dense.width
    for i, df in enumerate(inputs):
        out = out.join(df.select(*KEY, F.col("value").alias(f"_{i}")), KEY)
    parts = [F.col("_x"), *(F.col(f"_{i}") for i in range(len(inputs)))]
    if combine == "concat":
        x = F.concat(*parts)
    else:
        x = parts[0]
        for p in parts[1:]:
            x = add(x, p)
        b = bias or [0.0] * width
        x = F.array(*(x[j] + float(b[j]) for j in range(width)))
    x = F.transform(x, lambda v: activate(activation, v))
    return out.select(*KEY, (l2_normalize(x) if normalize else x).alias("value"))


def gcn_sage_update(graph: PropertyGraph, edge_sets: Sequence[str], dense: Dense, own: Dense, receiver: str = TARGET, node: str = "state", reduce: str = "mean", width: int | None = None) -> DataFrame:
    """Pool of all edge sets' senders and the node itself, jointly, each mapped first."""
    to = receivers(graph, receiver, list(edge_sets))
    table = None
    for n in edge_sets:
        m = messages(graph, n, receiver, node, map_node=dense).select("component_id", "edge_id", F.col("node_id").alias(end_column(receiver)), F.col("sender").alias("message"))
        table = m if table is None else table.unionByName(m)
    loops = graph.nodes[to].select("component_id", F.lit(-1).cast("long").alias("edge_id"), F.col("node_id").alias(end_column(receiver)), own(F.col(node)).alias("message"))
    e = graph.edges[edge_sets[0]]
    return pool(graph.with_edges("_all", table.unionByName(loops), e.source, e.target), receiver, edge_sets="_all", reduce=reduce, feature="message", width=width or dense.width)


def attention(graph: PropertyGraph, edge_sets: Sequence[str], per_edge: Callable[[str], DataFrame], receiver: str, heads: int, per_head: int) -> DataFrame:
    """Softmax of ``logits`` (an array by head) over all edges of a receiver, jointly over edge sets, and the weighted sum of ``values``.

    per_edge gives (component_id, edge_id[, node_id], logits, values) of an edge set; values hold the heads one after another.
    """
    key = ["component_id"] if receiver == CONTEXT else KEY
    rows = None
    for n in edge_sets:
        m = per_edge(n).select(*key, "edge_id", "logits", "values")
        rows = m if rows is None else rows.unionByName(m)
    w = Window.partitionBy(*key)
    top = [F.max(F.col("logits")[h]).over(w) for h in range(heads)]
    rows = rows.withColumn("_e", F.array(*(F.exp(F.col("logits")[h] - top[h]) for h in range(heads))))
    sums = rows.groupBy(*key).agg(F.array(*(F.sum(F.col("_e")[h]) for h in range(heads))).alias("_z"), F.array(*(F.sum(F.col("_e")[h] * F.col("values")[h * per_head + j]) for h in range(heads) for j in range(per_head))).alias("_v"))
    to = graph.context().select("component_id") if receiver == CONTEXT else graph.nodes[receivers(graph, receiver, list(edge_sets))].select(*KEY)
    got = F.array(*(F.col("_v")[h * per_head + j] / F.col("_z")[h] for h in range(heads) for j in range(per_head)))
    return to.join(sums, key, "left").select(*key, F.when(F.col("_z").isNull(), F.array(*[F.lit(0.0)] * (heads * per_head))).otherwise(got).alias("value"))


@dataclass(frozen=True)
class Attention:
    """Weights of an attention layer: query and key maps, each to heads x per_head, and for GATv2 a vector a head."""

    query: Dense
    key: Dense
    value: Dense | None = None
    vector: Matrix | None = None
    heads: int = 1
    scaling: str = "rsqrt_dim"
    activation: str = "leaky_relu"
    out_activation: str = "linear"
    merge: str = "concat"
    edge: Dense | None = None


def gat_v2(graph: PropertyGraph, edge_set: str, a: Attention, receiver: str = TARGET, node: str = "state", receiver_feature: str = "state", edge: str | None = None) -> DataFrame:
    """Attention with logits vector . activation(query(receiver) + key(sender) [+ edge]); values are the keys."""
    d = a.key.width // a.heads

    def per_edge(n: str) -> DataFrame:
        m = messages(graph, n, receiver, node, edge, receiver_feature, map_node=a.key)
        k = F.col("sender")
        if edge and a.edge:
            k = add(k, a.edge(F.col("edge")))
        m = m.withColumn("_k", k).withColumn("_x", F.transform(add(a.query(F.col("receiver")), F.col("_k")), lambda v: activate(a.activation, v)))
        logits = [sum((F.col("_x")[h * d + j] * float(a.vector[h][j]) for j in range(d)), F.lit(0.0)) for h in range(a.heads)]
        return m.withColumn("logits", F.array(*logits)).withColumn("values", F.col("_k"))

    return _merged(attention(graph, [edge_set], per_edge, receiver, a.heads, d), a, d)


def _merged(out: DataFrame, a: Attention, d: int) -> DataFrame:
    v = F.col("value")
    if a.merge == "mean":
        v = F.array(*(sum((v[h * d + j] for h in range(a.heads)), F.lit(0.0)) / a.heads for j in range(d)))
    return out.withColumn("value", F.transform(v, lambda x: activate(a.out_activation, x)))


def multi_head_attention(graph: PropertyGraph, edge_set: str, a: Attention, receiver: str = TARGET, node: str = "state", receiver_feature: str = "state", edge: str | None = None, transform_keys: bool = True, map_after_pooling: bool = False) -> DataFrame:
    """Scaled dot-product attention; scaling is none, rsqrt_dim or a factor as text.

    With ``edge``, a feature of edges joins the keys through ``a.edge``. Without ``transform_keys`` the senders'
    states are the keys as they are. Values are mapped before pooling, or once a receiver and head after it.
    """
    d = a.key.width // a.heads
    factor = {"none": 1.0, "rsqrt_dim": d**-0.5}.get(a.scaling)
    factor = float(a.scaling) if factor is None else factor
    value = a.value or a.key
    dv = value.width // a.heads
    keys = a.key if transform_keys else lambda x: F.concat(*[x] * a.heads)
    n_in = len(value.weights)
    # a value map after pooling sees each head's weighted mean of the states
    pooled_width = n_in if map_after_pooling else dv
    values = (lambda x: F.concat(*[x] * a.heads)) if map_after_pooling else value

    def per_edge(n: str) -> DataFrame:
        m = messages(graph, n, receiver, node, edge, receiver_feature, map_node=lambda x: F.struct(keys(x).alias("k"), values(x).alias("v")))
        k = add(F.col("sender.k"), a.edge(F.col("edge"))) if edge and a.edge else F.col("sender.k")
        m = m.withColumn("_q", a.query(F.col("receiver"))).withColumn("_k", k)
        logits = [sum((F.col("_q")[h * d + j] * F.col("_k")[h * d + j] for j in range(d)), F.lit(0.0)) * factor for h in range(a.heads)]
        return m.withColumn("logits", F.array(*logits)).withColumn("values", F.col("sender.v"))

    out = attention(graph, [edge_set], per_edge, receiver, a.heads, pooled_width)
    if map_after_pooling:
        mapped = [sum((F.col("value")[h * n_in + i] * float(value.weights[i][h * dv + j]) for i in range(n_in)), F.lit(float((value.bias or [0.0] * value.width)[h * dv + j]))) for h in range(a.heads) for j in range(dv)]
        out = out.withColumn("value", F.array(*(activate(value.activation, x) for x in mapped)))
    return _merged(out, a, dv)


def hgt_update(graph: PropertyGraph, edge_sets: Sequence[str], receiver: str, layers: dict[str, Attention], priors: dict[str, Sequence[float]], out: Dense, gate: float, node: str = "state", normalize: bool = False) -> DataFrame:
    """Attention jointly over all edge sets into a node set, keys and values by edge set, then a gated skip.

    value = sigmoid(gate) * out(gelu(attention)) + (1 - sigmoid(gate)) * state, layer-normalized if asked for.
    """
    import math

    first = layers[edge_sets[0]]
    d = first.key.width // first.heads

    def per_edge(n: str) -> DataFrame:
        a = layers[n]
        m = messages(graph, n, receiver, node, None, node, map_node=lambda x: F.struct(a.key(x).alias("k"), (a.value or a.key)(x).alias("v")))
        m = m.withColumn("_q", a.query(F.col("receiver")))
        logits = [sum((F.col("_q")[h * d + j] * F.col("sender.k")[h * d + j] for j in range(d)), F.lit(0.0)) * (float(priors[n][h]) * d**-0.5) for h in range(a.heads)]
        return m.withColumn("logits", F.array(*logits)).withColumn("values", F.col("sender.v"))

    got = attention(graph, list(edge_sets), per_edge, receiver, first.heads, d)
    g = 1 / (1 + math.exp(-gate))
    own = graph.nodes[receivers(graph, receiver, list(edge_sets))].select(*KEY, F.col(node).alias("_own"))
    x = out(F.transform("value", lambda v: activate("gelu", v)))
    new = add(scale(x, F.lit(g)), scale(F.col("_own"), F.lit(1 - g)))
    # x is out(...) of one value, so its width is that of the state
    return got.join(own, KEY).select(*KEY, (layer_norm(new, out.width) if normalize else new).alias("value"))


# ---------------------------------------------------------------- updates


def next_state_concat(own: DataFrame, inputs: Sequence[DataFrame], dense: Dense, node: str = "state", keys: Sequence[str] = tuple(KEY)) -> DataFrame:
    """dense(state ++ inputs)."""
    out = own.select(*keys, F.col(node).alias("_x"))
    for i, df in enumerate(inputs):
        out = out.join(df.select(*(k for k in keys if k in df.columns), F.col("value").alias(f"_{i}")), [k for k in keys if k in df.columns])
    return out.select(*keys, dense(F.concat(F.col("_x"), *(F.col(f"_{i}") for i in range(len(inputs))))).alias("value"))


def next_state_residual(own: DataFrame, inputs: Sequence[DataFrame], dense: Dense, activation: str = "relu", node: str = "state", skip: Dense | None = None) -> DataFrame:
    """activation(dense(state ++ inputs) + state); a skip map where widths differ."""
    got = next_state_concat(own, inputs, dense, node)
    both = got.join(own.select(*KEY, F.col(node).alias("_own")), KEY)
    x = add(F.col("value"), skip(F.col("_own")) if skip else F.col("_own"))
    return both.select(*KEY, F.transform(x, lambda v: activate(activation, v)).alias("value"))


def next_state_single(inputs: Sequence[DataFrame]) -> DataFrame:
    """The only input as it is."""
    if len(inputs) != 1:
        raise ValueError("one input only")
    return inputs[0]


def mt_albis_next_state(own: DataFrame, inputs: Sequence[DataFrame], dense: Dense, node: str = "state", residual: bool = True, normalization: str = "layer", activation: str = "relu") -> DataFrame:
    """dense(state ++ inputs), residual, then layer normalization or none."""
    got = next_state_concat(own, inputs, dense, node).join(own.select(*KEY, F.col(node).alias("_own")), KEY)
    x = F.transform("value", lambda v: activate(activation, v))
    x = add(x, F.col("_own")) if residual else x
    if normalization not in ("layer", "none"):
        raise ValueError(f"no normalization {normalization}")
    return got.select(*KEY, (layer_norm(x, dense.width) if normalization == "layer" else x).alias("value"))


@dataclass(frozen=True)
class GraphUpdate:
    """New edge states, then node states, then the context's; each a function of the graph as updated so far."""

    edges: dict[str, Callable[[PropertyGraph], DataFrame]] = field(default_factory=dict)
    nodes: dict[str, Callable[[PropertyGraph], DataFrame]] = field(default_factory=dict)
    context: Callable[[PropertyGraph], DataFrame] | None = None
    state: str = "state"

    def __call__(self, graph: PropertyGraph) -> PropertyGraph:
        for kind, fns, keys in ((EDGES, self.edges, ["component_id", "edge_id"]), (NODES, self.nodes, KEY)):
            new = {n: fn(graph) for n, fn in fns.items()}  # all from the same graph
            for n, df in new.items():
                graph = graph.with_table(kind, n, graph.table(kind, n).drop(self.state).join(df.withColumnRenamed("value", self.state), keys))
        if self.context:
            graph = graph.with_table(CONTEXT, "", graph.context().drop(self.state).join(self.context(graph).withColumnRenamed("value", self.state), "component_id"))
        return graph


def edge_update(graph: PropertyGraph, edge_set: str, dense: Dense, node: str = "state", edge: str | None = "state") -> DataFrame:
    """dense(edge ++ source ++ target) for each edge."""
    m = messages(graph, edge_set, TARGET, node, edge, node)
    return m.select("component_id", "edge_id", dense(F.concat(*([F.col("edge")] if edge else []), F.col("sender"), F.col("receiver"))).alias("value"))


def conv_updates(graph: PropertyGraph, conv: Callable[[PropertyGraph, str, str], DataFrame], next_state: Callable[[DataFrame, list[DataFrame]], DataFrame], receiver: str = TARGET, node_sets: Sequence[str] | None = None) -> GraphUpdate:
    """An update of each node set that receives edges (or of those named), with a convolution for each of its edge sets."""
    from weft.schema import aux_prefix

    into: dict[str, list[str]] = {}
    for n, e in graph.edges.items():
        if aux_prefix(n) is None and (node_sets is None or e.end(receiver) in node_sets):
            into.setdefault(e.end(receiver), []).append(n)
    return GraphUpdate(nodes={to: (lambda g, to=to, names=names: next_state(g.nodes[to], [conv(g, n, receiver) for n in names])) for to, names in into.items()})


def vanilla_mpnn(graph: PropertyGraph, message: dict[str, Dense], nxt: dict[str, Dense], receiver: str = TARGET, reduce: str = "sum") -> PropertyGraph:
    """One round of simple_conv with sender and receiver states, then next_state_concat."""
    conv = lambda g, n, tag: simple_conv(g, n, message[n], tag, reduce, "state", None, "state")
    out: dict[str, Callable] = {}
    for to, d in nxt.items():
        names = [n for n in message if graph.edges[n].end(receiver) == to]
        out[to] = lambda g, to=to, names=names, d=d: next_state_concat(g.nodes[to], [conv(g, n, receiver) for n in names], d)
    return GraphUpdate(nodes=out)(graph)


def slice_feature(x: Column, start: int, stop: int) -> Column:
    """Items start to stop of an array feature."""
    return F.slice(x, start + 1, max(0, stop - start))


def empty_feature(kind: str = "double") -> Column:
    """A feature of width 0."""
    return F.array().cast(f"array<{kind}>")


def item_dropout(df: DataFrame, features: Sequence[str], rate: float, keys: Sequence[str], seed: int = 0) -> DataFrame:
    """Whole items to 0 at a rate, the others scaled by 1 / (1 - rate); drawn by key, so repeatable."""
    from weft.operators.structure import keyed_random

    u = F.conv(F.substring(keyed_random(seed, *keys), 1, 12), 16, 10).cast("double") / 2.0**48
    f = F.when(u < rate, F.lit(0.0)).otherwise(1 / (1 - rate))
    return df.withColumns({c: scale(F.col(c), f) if df.schema[c].dataType.simpleString().startswith("array") else F.col(c) * f for c in features})


# ---------------------------------------------------------------- whole updates


def hom_update(graph: PropertyGraph, conv: Callable[[PropertyGraph, str, str], DataFrame], receiver: str = TARGET) -> PropertyGraph:
    """A graph of one node set and one edge set whose new states are a convolution of the old."""
    nodes, edges = graph.homogeneous_names()
    return GraphUpdate(nodes={nodes: lambda g: conv(g, edges, receiver)})(graph)


def gcn_update(graph: PropertyGraph, dense: Dense, receiver: str = TARGET, **how) -> PropertyGraph:
    """gcn_conv() over a homogeneous graph, with self loops unless told otherwise."""
    return hom_update(graph, lambda g, n, tag: gcn_conv(g, n, dense, tag, **{"self_loops": True, **how}), receiver)


def gat_v2_update(graph: PropertyGraph, a: Attention, receiver: str = TARGET, **how) -> PropertyGraph:
    return hom_update(graph, lambda g, n, tag: gat_v2(g, n, a, tag, **how), receiver)


def attention_update(graph: PropertyGraph, a: Attention, receiver: str = TARGET, **how) -> PropertyGraph:
    return hom_update(graph, lambda g, n, tag: multi_head_attention(g, n, a, tag, **how), receiver)


def mpnn_update(graph: PropertyGraph, convs: dict[str, Callable[[PropertyGraph, str, str], DataFrame]], nxt: dict[str, Callable[[DataFrame, list[DataFrame]], DataFrame]], receiver: str = TARGET) -> PropertyGraph:
    """Convolutions by edge set, and for each receiving node set that is named a next state of its own state and all that arrive there."""
    out: dict[str, Callable] = {}
    for to, state in nxt.items():
        names = [n for n in convs if graph.edges[n].end(receiver) == to]
        out[to] = lambda g, to=to, names=names, state=state: state(g.nodes[to], [convs[n](g, n, receiver) for n in names])
    return GraphUpdate(nodes=out)(graph)


def gat_v2_mpnn(graph: PropertyGraph, attentions: dict[str, Attention], nxt: dict[str, Dense], receiver: str = TARGET) -> PropertyGraph:
    """gat_v2() messages and dense(state ++ messages)."""
    return mpnn_update(graph, {n: (lambda g, e, tag, a=a: gat_v2(g, e, a, tag)) for n, a in attentions.items()}, {n: (lambda own, x, d=d: next_state_concat(own, x, d)) for n, d in nxt.items()}, receiver)


def attention_mpnn(graph: PropertyGraph, attentions: dict[str, Attention], nxt: dict[str, Dense], receiver: str = TARGET) -> PropertyGraph:
    """multi_head_attention() messages and dense(state ++ messages)."""
    return mpnn_update(graph, {n: (lambda g, e, tag, a=a: multi_head_attention(g, e, a, tag)) for n, a in attentions.items()}, {n: (lambda own, x, d=d: next_state_concat(own, x, d)) for n, d in nxt.items()}, receiver)


def sage_update(graph: PropertyGraph, neighbors: dict[str, Dense], own: dict[str, Dense], receiver: str = TARGET, **how) -> PropertyGraph:
    """sage_mean() by edge set and sage_next_state() by node set."""
    return mpnn_update(graph, {n: (lambda g, e, tag, d=d: sage_mean(g, e, d, tag)) for n, d in neighbors.items()}, {n: (lambda x, got, d=d: sage_next_state(x, got, d, **how)) for n, d in own.items()}, receiver)


def mt_albis_update(graph: PropertyGraph, messages_: dict[str, Dense], nxt: dict[str, Dense], receiver: str = TARGET, reduce: str = "mean", **how) -> PropertyGraph:
    """simple_conv() of sender and receiver states by edge set and mt_albis_next_state() by node set."""
    convs = {n: (lambda g, e, tag, d=d: simple_conv(g, e, d, tag, reduce, "state", None, "state")) for n, d in messages_.items()}
    return mpnn_update(graph, convs, {n: (lambda own, x, d=d: mt_albis_next_state(own, x, d, **how)) for n, d in nxt.items()}, receiver)


def attention_edge_pool(graph: PropertyGraph, edge_set: str, a: Attention, receiver: str = TARGET, edge: str = "state", receiver_feature: str = "state", kind: str = "gat_v2") -> DataFrame:
    """Attention of a receiver (a node or the context) over its edges' own states, as gat_v2 or scaled dot products."""
    d = a.key.width // a.heads
    value = a.key if kind == "gat_v2" else a.value or a.key
    factor = {"none": 1.0, "rsqrt_dim": d**-0.5}.get(a.scaling, 1.0)

    def per_edge(n: str) -> DataFrame:
        m = messages(graph, n, receiver, None, edge, receiver_feature)
        m = m.withColumn("_k", a.key(F.col("edge"))).withColumn("_q", a.query(F.col("receiver"))).withColumn("values", value(F.col("edge")))
        if kind == "gat_v2":
            x = F.transform(add(F.col("_q"), F.col("_k")), lambda v: activate(a.activation, v))
            m = m.withColumn("_x", x)
            logits = [sum((F.col("_x")[h * d + j] * float(a.vector[h][j]) for j in range(d)), F.lit(0.0)) for h in range(a.heads)]
        else:
            logits = [sum((F.col("_q")[h * d + j] * F.col("_k")[h * d + j] for j in range(d)), F.lit(0.0)) * factor for h in range(a.heads)]
        return m.withColumn("logits", F.array(*logits))

    dv = value.width // a.heads
    return _merged(attention(graph, [edge_set], per_edge, receiver, a.heads, dv), a, dv)


def config(layer: Dense | Attention) -> dict:
    """A layer as plain values, for files of settings."""
    return asdict(layer)


def from_config(kind: type, values: dict) -> Dense | Attention:
    """The layer that config() gave these values for; unknown names raise."""
    known = {f.name for f in fields(kind)}
    if unknown := set(values) - known:
        raise ValueError(f"{kind.__name__} has no {sorted(unknown)}")
    return kind(**{k: Dense(**v) if isinstance(v, dict) else v for k, v in values.items()})

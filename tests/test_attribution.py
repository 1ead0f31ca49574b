import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.graph import PropertyGraph
from weft.operators.attribution import Run, Step, integrated_gradients
from weft.schema import SOURCE, TARGET


@pytest.fixture
def shop(spark):
    """Buyers and goods with two edge sets; goods without buyers, repeated edges, two components."""
    rng = np.random.default_rng(3)
    rows = lambda n, k: [(i % 2, i, rng.normal(size=k).tolist()) for i in range(n)]
    kind = "component_id long, node_id long, f array<double>"
    b, g = rows(6, 2), rows(8, 3)
    bought = [(c, i, s, t) for i, (c, s, t) in enumerate([(0, 0, 0), (0, 0, 2), (0, 2, 2), (0, 2, 2), (1, 1, 3), (1, 3, 3), (1, 3, 5)])]
    like = [(c, i, s, t) for i, (c, s, t) in enumerate([(0, 0, 2), (0, 2, 4), (1, 1, 5), (1, 5, 1)])]
    edge = "component_id long, edge_id long, source_id long, target_id long"
    graph = PropertyGraph.of({"b": spark.createDataFrame(b, kind), "g": spark.createDataFrame(g, kind)}, {"bought": (spark.createDataFrame(bought, edge), "b", "g"), "like": (spark.createDataFrame(like, edge), "b", "b")})
    return graph, b, g, bought, like


STEPS = [
    Step("bought", SOURCE, [[0.5, -0.2], [0.3, 0.8]], [[0.4, 0.1], [-0.6, 0.2], [0.7, -0.3]], [0.1, -0.2], "tanh", "mean"),
    Step("like", TARGET, [[0.9, 0.1, -0.4], [0.2, -0.7, 0.6]], [[0.3, 0.5, -0.1], [-0.8, 0.2, 0.4]], [0.05, 0.0, -0.1], "gelu", "sum"),
]
WEIGHTS = [1.0, -0.5, 2.0]


def plain(b, g, bought, like, component):
    """The model's value for one component, from arrays of features by id."""
    h = {}
    for i in b:
        near = [g[t] for c, _, s, t in bought if s == i]
        h[i] = np.tanh(b[i] @ STEPS[0].own + (np.mean(near, 0) if near else np.zeros(3)) @ STEPS[0].other + STEPS[0].bias)
    total = 0.0
    for i in h:
        near = [h[s] for c, _, s, t in like if t == i]
        z = h[i] @ np.array(STEPS[1].own) + (np.sum(near, 0) if near else np.zeros(2)) @ np.array(STEPS[1].other) + STEPS[1].bias
        y = z * 0.5 * (1 + np.tanh(0.7978845608028654 * (z + 0.044715 * z**3)))
        total += y @ WEIGHTS if i % 2 == component else 0.0
    return total


def test_gradients_against_finite_differences(shop):
    graph, b, g, bought, like = shop
    x = PropertyGraph({n: df.withColumnRenamed("f", "x") for n, df in graph.nodes.items()}, graph.edges)
    run = Run(x, {"b": 2, "g": 3}, STEPS)
    own = {"b": {i: np.array(v) for _, i, v in b}, "g": {i: np.array(v) for _, i, v in g}}
    value = lambda: {c: plain(own["b"], own["g"], bought, like, c) for c in (0, 1)}
    base = value()
    assert {r.component_id: r.value for r in run.value("b", WEIGHTS).collect()} == pytest.approx(base)
    for n, df in run.gradients("b", WEIGHTS).items():
        for r in df.collect():
            for k, got in enumerate(r.g):
                at = own[n][r.node_id]
                at[k] += 1e-6
                up = value()[r.component_id]
                at[k] -= 2e-6
                want = (up - value()[r.component_id]) / 2e-6
                at[k] += 1e-6
                assert got == pytest.approx(want, abs=1e-6)


def test_attributions_add_up(shop):
    graph = shop[0]
    found, values = integrated_gradients(graph, {"b": ("f", 2), "g": ("f", 3)}, STEPS, "b", WEIGHTS, points=40, baseline=0.25)
    total = {}
    for df in found.values():
        for r in df.select("component_id", F.aggregate("attribution", F.lit(0.0), lambda s, v: s + v).alias("a")).collect():
            total[r.component_id] = total.get(r.component_id, 0.0) + r.a
    want = {r.component_id: r.value - r.baseline for r in values.collect()}
    assert set(found) == {"b", "g"} and total == pytest.approx(want, rel=2e-3, abs=2e-3)

"""Prediction tasks: what a level of the graph predicts, joined with its labels, and all metrics and losses of the problem.

Levels are ``graph`` (a node set's states pooled to each component), ``root`` (those of each component's first node)
and ``readout`` (those that readout edges of a key name). Problems are ``binary``, ``multiclass`` and ``regression``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.graph import PropertyGraph
from weft.operators import message, metrics
from weft.operators.readout import structured_readout
from weft.operators.structure import first_node

GRAPH, ROOT, READ = "graph", "root", "readout"
BINARY, MULTICLASS, REGRESSION = "binary", "multiclass", "regression"


@dataclass(frozen=True)
class Task:
    """A problem at a level: where predictions and labels are.

    ``prediction`` and ``label`` are features: of ``node_set``, or of what the readout key names. At level ``graph`` the
    label is the context's. Predictions are logits (an array of them for ``multiclass``) or numbers.
    """

    problem: str
    level: str
    prediction: str
    label: str
    node_set: str = ""
    key: str = ""
    reduce: str = "mean"
    width: int | None = None

    def activations(self, graph: PropertyGraph, feature: str | None = None, name: str = "prediction") -> DataFrame:
        """(component_id, value) or, for readouts, (component_id, node_id, value)."""
        feature = feature or self.prediction
        if self.level == GRAPH:
            return message.pool_nodes_to_context(graph, self.node_set, self.reduce, feature=feature, width=self.width, name=name)
        if self.level == ROOT:
            return first_node(graph, self.node_set, feature, name)
        if self.level == READ:
            return structured_readout(graph, self.key, feature, name)
        raise ValueError(f"no level {self.level}")

    def labelled(self, graph: PropertyGraph) -> DataFrame:
        """Predictions with their labels."""
        got = self.activations(graph)
        if self.level == GRAPH:
            return got.join(graph.context().select("component_id", F.col(self.label).alias("label")), "component_id")
        return got.join(self.activations(graph, self.label, "label"), [c for c in ("component_id", "node_id") if c in got.columns])

    def evaluate(self, graph: PropertyGraph) -> DataFrame:
        """(metric, value): every metric and loss of the problem."""
        both = self.labelled(graph).select("label", "prediction")
        if self.problem == BINARY:
            out = metrics.binary_metrics(both, "label", "prediction")
        elif self.problem == REGRESSION:
            out = metrics.regression_losses(both, "label", "prediction")
        elif self.problem == MULTICLASS:
            head, by_class = metrics.multiclass_metrics(both, "label", "prediction")
            rows = by_class.select(F.explode(F.array(*(F.struct(F.concat(F.lit(f"{m}_"), F.col("class").cast("string")).alias("metric"), F.col(m).alias("value")) for m in ("precision", "recall")))).alias("x")).select("x.*")
            return _rows(head).unionByName(rows)
        else:
            raise ValueError(f"no problem {self.problem}")
        return _rows(out)


def _rows(one: DataFrame) -> DataFrame:
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in one.columns))).alias("x")).select("x.*")

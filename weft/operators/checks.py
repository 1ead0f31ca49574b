"""Value checks in the running plan: counts of violations ride along with a graph's tables and are read when an action ends."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.graph import KEYS, EdgeSet, PropertyGraph, end_column
from weft.schema import EDGES, SOURCE, TARGET, GraphSchema, SchemaError


@dataclass
class Watch:
    """Observations of tables by (kind, set): what they counted once an action has read the table to its end."""

    observed: dict[tuple[str, str], tuple[Observation, list[str]]] = field(default_factory=dict)

    def counts(self, *sets: tuple[str, str]) -> dict[tuple[str, str, str], int]:
        """(kind, set, violation) -> rows, of the named sets or all; waits for the first action on each."""
        out = {}
        for at in sets or self.observed:
            seen, names = self.observed[at]
            got = seen.get
            out |= {(*at, n): int(got[f"v{i}"] or 0) for i, n in enumerate(names)}
        return out

    def check(self, *sets: tuple[str, str]) -> None:
        if bad := {k: n for k, n in self.counts(*sets).items() if n}:
            raise SchemaError("; ".join(f"{kind}/{name}: {n} rows, {what}" for (kind, name, what), n in sorted(bad.items())))


def _widths(schema: GraphSchema | None, kind: str, name: str, df: DataFrame) -> dict[str, Column]:
    """Arrays of another width than the schema's, and features that lack a value."""
    out = {}
    for k, n, s in schema.iter_sets() if schema else ():
        if (k, n) == (kind, name):
            for f, x in s.features.items():
                if f in df.columns:
                    out[f"{f} is null"] = F.col(f).isNull()
                    if isinstance(df.schema[f].dataType, T.ArrayType) and x.shape and x.shape[0] >= 0:
                        out[f"{f} isn't {x.shape[0]} wide"] = F.size(f) != x.shape[0]
    return out


def watched(graph: PropertyGraph, schema: GraphSchema | None = None) -> tuple[PropertyGraph, Watch]:
    """The same graph with counters on each table, and the watch that reads them.

    Counted are null keys; features without a value and arrays of another width than the schema says; and edges with an
    end that is no node, or a node of another component only. Ends are found by left joins that the tables' readers run
    along; no table is read by a job of its own.
    """
    watch = Watch()

    def put(df: DataFrame, kind: str, name: str, found: dict[str, Column], columns: list[str]) -> DataFrame:
        seen = Observation()
        watch.observed[kind, name] = (seen, list(found))
        return df.observe(seen, *(F.count(F.when(c, 1)).alias(f"v{i}") for i, c in enumerate(found.values()))).select(*columns)

    nodes, edges = {}, {}
    nulls = lambda kind, df: {f"{c} is null": F.col(c).isNull() for c in KEYS[kind] if c != "pos" and c in df.columns}
    for n, df in graph.nodes.items():
        nodes[n] = put(df, "nodes", n, nulls("nodes", df) | _widths(schema, "nodes", n, df), df.columns)
    for n, e in graph.edges.items():
        df, found = e.table, nulls(EDGES, e.table) | _widths(schema, EDGES, n, e.table)
        for tag in (SOURCE, TARGET):
            c = end_column(tag)
            own = graph.nodes[e.end(tag)]
            here = own.select("component_id", F.col("node_id").alias(c), F.lit(True).alias(f"_here_{tag}")).distinct()
            any_ = own.select(F.col("node_id").alias(c), F.lit(True).alias(f"_any_{tag}")).distinct()
            df = df.join(here, ["component_id", c], "left").join(any_, c, "left")
            found[f"{tag} is no node"] = F.col(f"_any_{tag}").isNull() & F.col(c).isNotNull()
            found[f"{tag} is in another component"] = F.col(f"_any_{tag}").isNotNull() & F.col(f"_here_{tag}").isNull()
        edges[n] = EdgeSet(put(df, EDGES, n, found, e.table.columns), e.source, e.target)
    context = graph.context_table
    if context is not None:
        context = put(context, "context", "", nulls("context", context) | _widths(schema, "context", "", context), context.columns)
    return PropertyGraph(nodes, edges, context), watch

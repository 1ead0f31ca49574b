"""A property graph: tables of nodes, edges and components.

Every node table has ``component_id`` and ``node_id``; every edge table ``component_id``, ``edge_id``,
``source_id`` and ``target_id``; the context table ``component_id``, and it lists all components, empty
ones too. All other columns are features. Order matters in a few operators only; those use the ``pos``
column, and where a table has none, the id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.schema import CONTEXT, EDGES, NODES, SOURCE, TARGET, Feature, GraphSchema, SchemaError, SetSchema, aux_prefix

KEYS = {CONTEXT: ("component_id",), NODES: ("component_id", "node_id", "pos"), EDGES: ("component_id", "edge_id", "source_id", "target_id", "pos")}


_checked = False


def enable_validation() -> None:
    """From now on graphs check as they are made that tables have their key columns and edges join known node sets. No jobs run."""
    global _checked
    _checked = True


def disable_validation() -> None:
    global _checked
    _checked = False


def is_graph(x: object) -> bool:
    return isinstance(x, PropertyGraph)


@dataclass(frozen=True)
class EdgeSet:
    table: DataFrame
    source: str
    target: str

    def end(self, tag: str) -> str:
        """The node set at one end."""
        return {SOURCE: self.source, TARGET: self.target}[tag]


def end_column(tag: str) -> str:
    return {SOURCE: "source_id", TARGET: "target_id"}[tag]


def position(df: DataFrame, id_col: str) -> Column:
    return F.col("pos") if "pos" in df.columns else F.col(id_col)


@dataclass(frozen=True)
class PropertyGraph:
    nodes: dict[str, DataFrame] = field(default_factory=dict)
    edges: dict[str, EdgeSet] = field(default_factory=dict)
    context_table: DataFrame | None = None

    def __post_init__(self) -> None:
        if not _checked:
            return
        for kind, name, df in [*((NODES, n, x) for n, x in self.nodes.items()), *((EDGES, n, e.table) for n, e in self.edges.items())]:
            if missing := [c for c in KEYS[kind] if c != "pos" and c not in df.columns]:
                raise SchemaError(f"{kind}/{name} has no {missing}")
        for name, e in self.edges.items():
            if aux_prefix(name) is None and (missing := {e.source, e.target} - set(self.nodes)):
                raise SchemaError(f"edges/{name} joins unknown node sets {sorted(missing)}")

    @staticmethod
    def of(nodes: dict[str, DataFrame], edges: dict[str, tuple[DataFrame, str, str]], context: DataFrame | None = None) -> PropertyGraph:
        """A graph of tables; component 0, and edge ids from a hash-free running id, are added where missing."""
        whole = lambda df: df if "component_id" in df.columns else df.withColumn("component_id", F.lit(0).cast("long"))
        numbered = lambda df: df if "edge_id" in df.columns else df.withColumn("edge_id", F.monotonically_increasing_id())
        return PropertyGraph({n: whole(x) for n, x in nodes.items()}, {n: EdgeSet(numbered(whole(x)), s, t) for n, (x, s, t) in edges.items()}, context)

    @staticmethod
    def homogeneous(edges: DataFrame, nodes: DataFrame | None = None, node_set: str = "nodes", edge_set: str = "edges") -> PropertyGraph:
        """One node set and one edge set; without a node table, the nodes are the edges' ends."""
        if nodes is None:
            keys = [c for c in ("component_id",) if c in edges.columns]
            nodes = edges.select(*keys, F.col("source_id").alias("node_id")).union(edges.select(*keys, F.col("target_id").alias("node_id"))).distinct()
        return PropertyGraph.of({node_set: nodes}, {edge_set: (edges, node_set, node_set)})

    @property
    def spark(self) -> SparkSession:
        return next(iter([*self.nodes.values(), *(e.table for e in self.edges.values())])).sparkSession

    def context(self) -> DataFrame:
        """All components; without a context table those that any node or edge names."""
        if self.context_table is not None:
            return self.context_table
        parts = [x.select("component_id") for x in [*self.nodes.values(), *(e.table for e in self.edges.values())]]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out.distinct()

    def table(self, kind: str, name: str = "") -> DataFrame:
        return self.context() if kind == CONTEXT else self.nodes[name] if kind == NODES else self.edges[name].table

    def iter_sets(self, aux: bool = True) -> Iterator[tuple[str, str, DataFrame]]:
        yield CONTEXT, "", self.context()
        for kind, names in ((NODES, self.nodes), (EDGES, self.edges)):
            for n in names:
                if aux or aux_prefix(n) is None:
                    yield kind, n, self.table(kind, n)

    def features(self, kind: str, name: str = "") -> list[str]:
        return [c for c in self.table(kind, name).columns if c not in KEYS[kind]]

    def with_table(self, kind: str, name: str, df: DataFrame) -> PropertyGraph:
        if kind == CONTEXT:
            return replace(self, context_table=df)
        if kind == NODES:
            return replace(self, nodes={**self.nodes, name: df})
        return replace(self, edges={**self.edges, name: replace(self.edges[name], table=df)})

    def with_edges(self, name: str, df: DataFrame, source: str, target: str) -> PropertyGraph:
        return replace(self, edges={**self.edges, name: EdgeSet(df, source, target)})

    def replace_features(self, kind: str, name: str, **new: Column) -> PropertyGraph:
        """The set with exactly these features."""
        df = self.table(kind, name)
        return self.with_table(kind, name, df.select(*(c for c in KEYS[kind] if c in df.columns), *(x.alias(c) for c, x in new.items())))

    def remove_features(self, kind: str, name: str, *gone: str) -> PropertyGraph:
        missing = set(gone) - set(self.features(kind, name))
        if missing:
            raise KeyError(f"{kind}/{name} has no {sorted(missing)}")
        return self.with_table(kind, name, self.table(kind, name).drop(*gone))

    def map_features(self, context: Callable | None = None, nodes: Callable | None = None, edges: Callable | None = None, aux: bool = False) -> PropertyGraph:
        """Apply ``fn(table, name)`` to context, node sets and edge sets; auxiliary sets are left alone unless asked for."""
        out = self
        for kind, name, df in self.iter_sets(aux):
            fn = {CONTEXT: context, NODES: nodes, EDGES: edges}[kind]
            if fn is not None:
                out = out.with_table(kind, name, fn(df, name))
        return out

    def register_views(self, prefix: str = "") -> list[str]:
        """Every table as a temporary view for spark.sql."""
        made = []
        for kind, name, df in self.iter_sets():
            df.createOrReplaceTempView(view := f"{prefix}{kind}{'_' + name if name else ''}")
            made.append(view)
        return made

    def schema(self) -> GraphSchema:
        own = lambda kind, name: {f: Feature.of(self.table(kind, name).schema[f].dataType) for f in self.features(kind, name)}
        return GraphSchema(
            {n: SetSchema(own(NODES, n)) for n in self.nodes},
            {n: SetSchema(own(EDGES, n), e.source, e.target) for n, e in self.edges.items()},
            SetSchema(own(CONTEXT, "")) if self.context_table is not None else None,
        )

    def check(self, schema: GraphSchema) -> None:
        """Raise unless all of the schema's sets and features are here with their types."""
        for kind, name, s in schema.iter_sets():
            if name not in {CONTEXT: {""}, NODES: self.nodes, EDGES: self.edges}[kind]:
                raise SchemaError(f"no {kind}/{name}")
            if kind == EDGES and (self.edges[name].source, self.edges[name].target) != (s.source, s.target):
                raise SchemaError(f"edges/{name} joins other node sets")
            have = {f.name: f.dataType for f in self.table(kind, name).schema.fields}
            for f, x in s.features.items():
                if have.get(f) != x.spark_type():
                    raise SchemaError(f"{kind}/{name}/{f} is {have.get(f)}, not {x.spark_type()}")

    def dangling(self, edge_set: str) -> DataFrame:
        """Edges with an end that isn't a node: edge rows and the ``tag`` of the missing end."""
        e = self.edges[edge_set]
        parts = []
        for tag in (SOURCE, TARGET):
            ids = self.nodes[e.end(tag)].select("component_id", F.col("node_id").alias(end_column(tag)))
            parts.append(e.table.join(ids, ["component_id", end_column(tag)], "left_anti").select(*e.table.columns, F.lit(tag).alias("tag")))
        return parts[0].unionByName(parts[1])

    def assert_valid(self) -> None:
        """Raise if an edge has a missing end or a node id occurs twice in a component. Runs count queries."""
        for n in self.edges:
            if k := self.dangling(n).limit(1).count():
                raise SchemaError(f"edges/{n} has ends that aren't nodes ({k} at least)")
        for n, df in self.nodes.items():
            if df.groupBy("component_id", "node_id").count().where("count > 1").limit(1).count():
                raise SchemaError(f"nodes/{n} repeats an id")

    def homogeneous_names(self) -> tuple[str, str]:
        """The names of the only node set and edge set that aren't auxiliary."""
        nodes, edges = ([n for n in x if aux_prefix(n) is None] for x in (self.nodes, self.edges))
        if len(nodes) != 1 or len(edges) != 1:
            raise ValueError(f"not homogeneous: node sets {nodes}, edge sets {edges}")
        return nodes[0], edges[0]


def default_value(kind: Any) -> Column:
    """The value of a feature that isn't there: 0, false, empty string, empty array, the first of January 1970."""
    name = kind.simpleString()
    if name.startswith("array"):
        return F.array().cast(kind)
    if name in ("timestamp", "timestamp_ntz", "date"):
        return F.lit("1970-01-01").cast(kind)
    return F.lit({"string": "", "boolean": False}.get(name, 0)).cast(kind)

"""Operators that change which nodes and edges there are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.graph import EdgeSet, PropertyGraph, default_value, end_column, position
from weft.schema import EDGES, NODES, SOURCE, TARGET, aux_prefix
from weft.sources.scratch import new_path

_E = ("component_id", "edge_id", "source_id", "target_id")


def mask_edges(graph: PropertyGraph, edge_set: str, keep: Column, rest: str | None = None) -> PropertyGraph:
    """Keep the edges where ``keep`` holds; the others go to the edge set ``rest`` if it's named. A null counts as false."""
    e = graph.edges[edge_set]
    flag = F.coalesce(keep, F.lit(False))
    out = graph.with_table(EDGES, edge_set, e.table.where(flag))
    return out.with_edges(rest, e.table.where(~flag), e.source, e.target) if rest else out


def add_self_loops(graph: PropertyGraph, edge_set: str) -> PropertyGraph:
    """An edge from each node to itself, also where there is one already; their features are 0, false or empty."""
    e = graph.edges[edge_set]
    if e.source != e.target:
        raise ValueError("self loops need one node set at both ends")
    nodes = graph.nodes[e.source]
    kinds = {f.name: f.dataType for f in e.table.schema.fields}
    # loops get the negative numbers of a hash of their node, so ids stay apart from those of edges
    loop_id = (-F.abs(F.xxhash64("component_id", "node_id")) - 1).cast(kinds["edge_id"])
    cols = {"component_id": F.col("component_id"), "edge_id": loop_id, "source_id": F.col("node_id"), "target_id": F.col("node_id")}
    loops = nodes.select(*((cols[c] if c in cols else F.lit(None).cast(k) if c == "pos" else default_value(k)).alias(c) for c, k in kinds.items()))
    return graph.with_table(EDGES, edge_set, e.table.unionByName(loops))


def first_node(graph: PropertyGraph, node_set: str, feature: str, name: str = "value", strict: bool = False) -> DataFrame:
    """The feature of each component's first node; a component without nodes is an error (with strict, checked at once)."""
    nodes = graph.nodes[node_set]
    first = nodes.groupBy("component_id").agg(F.min_by(F.struct(F.col(feature).alias("v")), position(nodes, "node_id")).alias("f"))
    out = graph.context().select("component_id").join(first, "component_id", "left")
    if strict and out.where("f is null").limit(1).count():
        raise ValueError(f"a component has no node in {node_set}")
    if not strict:
        out = out.withColumn("f", F.when(F.col("f").isNull(), F.raise_error(F.lit(f"a component has no node in {node_set}")).cast(first.schema["f"].dataType)).otherwise(F.col("f")))
    return out.select("component_id", F.col("f.v").alias(name))


def dense_index(df: DataFrame, id_col: str, name: str = "index", few_components: bool = False) -> DataFrame:
    """Number the rows of each component from 0, in order of position.

    A component is one task's, which suits samples; with ``few_components`` rows are ranked over the whole
    table by range, whatever a component's size.
    """
    if few_components:
        return within_components(ordered_rank(df.withColumn("_pos", position(df, id_col)), ["component_id", "_pos", id_col], name), name, few=True).drop("_pos")
    w = Window.partitionBy("component_id").orderBy(position(df, id_col), id_col)
    return df.withColumn(name, (F.row_number().over(w) - 1).cast("long"))


#: Rows that a task of a large shuffle is dealt.
TASK_ROWS = 400_000


def spread(df: DataFrame, n_rows: int, *keys: str) -> DataFrame:
    """Deal the rows of a large table over tasks of some TASK_ROWS rows each by keys. Spark merges partitions up to a size in
    bytes as they are on disk, where repeated values take next to nothing, so a task's rows in memory have no bound by it.

    A component_id that can't be null is the constant of a graph of one component: Spark drops it from the keys of joins."""
    if n_rows <= 4 * TASK_ROWS:
        return df
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = [k for k in keys if k != "component_id" or df.schema[k].nullable] or keys
    return df.repartition(max(least, -(-n_rows // TASK_ROWS)), *own)


def attach_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, n_rows: int) -> DataFrame:
    """Join rows with one row for each of their groups. Groups of over n_rows / 1000 rows are fewer than 1000, whatever the
    data, and are broadcast; the others are joined by shuffle, where no key has more rows than that (10,000 at least)."""
    limit = max(10_000, n_rows // 1000)
    values = [c for c in groups.columns if c != key]
    near = rows.join(F.broadcast(groups.where(F.col(size) > limit)), key, "left")
    rest = spread(near.where(F.col(size).isNull()).drop(*values), n_rows, key).join(spread(groups.where(F.col(size) <= limit), n_rows, key), key)
    return near.where(F.col(size).isNotNull()).unionByName(rest)


def within_components(df: DataFrame, rank: str, few: bool = False) -> DataFrame:
    """Ranks over the whole table, in order of components, as ranks in each component; ``few`` components' first ranks are broadcast."""
    first = df.groupBy("component_id").agg(F.min(rank).alias("_first"))
    return df.join(F.broadcast(first) if few else first, "component_id").withColumn(rank, F.col(rank) - F.col("_first")).drop("_first")


def written(df: DataFrame, name: str) -> DataFrame:
    """A table written to the shared folder and read again."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reorder_nodes(graph: PropertyGraph, node_set: str, order: DataFrame) -> PropertyGraph:
    """Give nodes new positions: ``order`` has component_id, node_id, new_pos, a permutation of 0 .. n - 1 in each component."""
    nodes = graph.nodes[node_set]
    n = nodes.groupBy("component_id").agg(F.count("*").alias("n"))
    bad = order.groupBy("component_id").agg(F.count("*").alias("m"), F.countDistinct("new_pos").alias("d"), F.min("new_pos").alias("lo"), F.max("new_pos").alias("hi"), F.countDistinct("node_id").alias("i"))
    wrong = n.join(bad, "component_id", "left").where("m is null or n <> m or m <> d or m <> i or lo <> 0 or hi <> m - 1")
    if wrong.limit(1).count():
        raise ValueError("not a permutation of each component's nodes")
    return graph.with_table(NODES, node_set, nodes.drop("pos").join(order.withColumnRenamed("new_pos", "pos"), ["component_id", "node_id"]))


def keyed_random(seed: int, *cols: str | Column) -> Column:
    """A random-looking key that depends on seed and values alone, so that any plan and any retry draws alike."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") if isinstance(c, str) else c for c in cols)))


def shuffle_nodes(graph: PropertyGraph, node_sets: list[str] | None = None, seed: int = 0) -> PropertyGraph:
    """A random order of each component's nodes; auxiliary sets keep theirs."""
    for n in node_sets or [n for n in graph.nodes if aux_prefix(n) is None]:
        keyed = graph.nodes[n].withColumn("_key", keyed_random(seed, F.lit(n), "component_id", "node_id"))
        graph = graph.with_table(NODES, n, global_rank(keyed, "_key", "pos", ["component_id"]).drop("_key"))
    return graph


def shuffle_features(graph: PropertyGraph, kind: str, name: str, features: list[str], seed: int = 0, rate: float = 1.0) -> PropertyGraph:
    """Permute each feature's values over the items, independently; only a share of the items if rate < 1.

    Items are ranked by range-partitioned keys, so no task sees the whole table.
    """
    df = graph.table(kind, name)
    keys = [c for c in ("component_id", "node_id", "edge_id") if c in df.columns]
    for f in features:
        from_key, to_key = keyed_random(seed, F.lit(f + "/from"), *keys), keyed_random(seed, F.lit(f + "/to"), *keys)
        drawn = df.select(*keys, F.col(f).alias("_v"), from_key.alias("_from"), to_key.alias("_to"))
        if rate < 1:
            drawn = drawn.where(F.conv(F.substring(keyed_random(seed, F.lit(f + "/rate"), *keys), 1, 8), 16, 10).cast("double") < rate * 2.0**32)
        taken = global_rank(drawn.select("_v", "_from"), "_from", "_r").select("_r", F.struct("_v").alias("_new"))
        put = global_rank(drawn.select(*keys, "_to"), "_to", "_r")
        moved = put.join(taken, "_r").select(*keys, "_new")
        df = df.join(moved, keys, "left").withColumn(f, F.when(F.col("_new").isNotNull(), F.col("_new._v")).otherwise(F.col(f))).drop("_new")
    return graph.with_table(kind, name, df)


def global_rank(df: DataFrame, key: str, name: str, within: list[str] | None = None) -> DataFrame:
    """Rank of each row by a hexadecimal key, over the whole table or within groups: ranks within 4096 ranges of the key, after the sizes of the ranges before."""
    by = within or []
    df = df.withColumn("_cell", F.substring(key, 1, 3))
    sizes = df.groupBy(*by, "_cell").agg(F.count("*").alias("_n"))
    w = (Window.partitionBy(*by) if by else Window).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy(*by, "_cell").orderBy(key)) - 1
    return df.withColumn("_own", own).join(before if by else F.broadcast(before), [*by, "_cell"]).withColumn(name, (F.col("_own") + F.col("_before")).cast("long")).drop("_cell", "_own", "_before")


def ordered_rank(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rank of each row from 0 along some columns, over the whole table: range partitions, numbered apart after the sizes of those before.

    Rows that tie in all of the columns are ranked in any order.
    """
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # the id is the partition's number << 33 and the row's number in it; written, so that it's made once
    placed = written(parts.withColumn("_at", F.monotonically_increasing_id()), "ranked")
    sizes = placed.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    out = placed.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(before), "_part")
    return out.withColumn(name, (F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).cast("long")).drop("_part", "_at", "_before")


def combine_values(way: str, *cols: Column, array: bool = False) -> Column:
    """``sum`` elementwise, or ``concat`` of arrays."""
    if way == "concat":
        return F.concat(*cols)
    if way != "sum":
        raise ValueError(f"no way to combine: {way}")
    out = cols[0]
    for c in cols[1:]:
        out = F.zip_with(out, c, lambda a, b: a + b) if array else out + c
    return out


def line_graph(graph: PropertyGraph, connect_from: str = TARGET, connect_to: str = SOURCE, non_backtracking: bool = False, with_original: bool = False, node_features: bool = False) -> PropertyGraph:
    """Edges become nodes, joined where the ``connect_from`` end of one is the ``connect_to`` end of the next.

    Each ordered pair (A, B) of edge sets that share the node set there makes an edge set ``A=>B``. Without
    backtracking, pairs whose outer ends are one node are left out, where both are in one node set.
    ``node_features`` puts the shared node's features on the new edges; ``with_original`` keeps the original
    nodes as ``original/<set>``, with edge sets ``original/from/<set>`` and ``original/to/<set>``.
    """
    names = [n for n in graph.edges if aux_prefix(n) is None]
    nodes = {n: graph.edges[n].table.withColumnRenamed("edge_id", "node_id").drop("source_id", "target_id") for n in names}
    edges: dict[str, EdgeSet] = {}
    outer = {SOURCE: TARGET, TARGET: SOURCE}
    for a in names:
        for b in names:
            ea, eb = graph.edges[a], graph.edges[b]
            if ea.end(connect_from) != eb.end(connect_to):
                continue
            left = ea.table.select("component_id", F.col("edge_id").alias("source_id"), F.col(end_column(connect_from)).alias("_via"), F.col(end_column(outer[connect_from])).alias("_a"))
            right = eb.table.select("component_id", F.col("edge_id").alias("target_id"), F.col(end_column(connect_to)).alias("_via"), F.col(end_column(outer[connect_to])).alias("_b"))
            pairs = left.join(right, ["component_id", "_via"])
            if non_backtracking and ea.end(outer[connect_from]) == eb.end(outer[connect_to]):
                pairs = pairs.where("_a <> _b")
            if node_features:
                via = graph.nodes[ea.end(connect_from)]
                pairs = pairs.join(via.withColumnRenamed("node_id", "_via").drop("pos"), ["component_id", "_via"])
            made = pairs.withColumn("edge_id", F.xxhash64("source_id", "target_id")).drop("_a", "_b", "_via")
            edges[f"{a}=>{b}"] = EdgeSet(made, a, b)
    if with_original:
        for n, df in graph.nodes.items():
            nodes[f"original/{n}"] = df
        for n in names:
            e = graph.edges[n]
            item = e.table.select("component_id", "edge_id", F.col("source_id").alias("s"), F.col("target_id").alias("t"))
            edges[f"original/from/{n}"] = EdgeSet(item.select("component_id", "edge_id", F.col("s").alias("source_id"), F.col("edge_id").alias("target_id")), f"original/{e.source}", n)
            edges[f"original/to/{n}"] = EdgeSet(item.select("component_id", "edge_id", F.col("edge_id").alias("source_id"), F.col("t").alias("target_id")), n, f"original/{e.target}")
    return PropertyGraph(nodes, edges, graph.context())


def unique_nodes(graph: PropertyGraph, node_set: str) -> PropertyGraph:
    """One node of each id in a component, the first by position. Edges name ids, so they stay as they are."""
    nodes = graph.nodes[node_set]
    order = position(nodes, "node_id")
    rest = [c for c in nodes.columns if c not in ("component_id", "node_id")]
    if not rest:
        return graph.with_table(NODES, node_set, nodes.distinct())
    kept = nodes.groupBy("component_id", "node_id").agg(F.min_by(F.struct(*rest), order).alias("_x"))
    return graph.with_table(NODES, node_set, kept.select("component_id", "node_id", *(F.col(f"_x.{c}").alias(c) for c in rest)))


def remove_parallel_edges(graph: PropertyGraph, edge_set: str) -> PropertyGraph:
    """One edge of each (component, source, target): the one with the lowest position."""
    e = graph.edges[edge_set]
    rest = [c for c in e.table.columns if c not in ("component_id", "source_id", "target_id")]
    order = F.struct(position(e.table, "edge_id"), "edge_id")
    kept = e.table.groupBy("component_id", "source_id", "target_id").agg(F.min_by(F.struct(*rest), order).alias("_x"))
    return graph.with_table(EDGES, edge_set, kept.select("component_id", "source_id", "target_id", *(F.col(f"_x.{c}").alias(c) for c in rest)))


def concat_graphs(graphs: list[PropertyGraph], components: str = "keep") -> PropertyGraph:
    """Union of graphs: components keep their ids, are ``merged`` into one, or are ``stacked`` as new ones (number, id)."""
    if components not in ("keep", "merge", "stack"):
        raise ValueError(components)

    def own(df: DataFrame, i: int) -> DataFrame:
        if components == "merge":
            return df.withColumn("component_id", F.lit(0).cast("long"))
        return df.withColumn("component_id", F.concat_ws("/", F.lit(i), F.col("component_id").cast("string"))) if components == "stack" else df

    def union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out

    nodes = {n: union([own(g.nodes[n], i) for i, g in enumerate(graphs) if n in g.nodes]) for n in dict.fromkeys(n for g in graphs for n in g.nodes)}
    edges = {}
    for n in dict.fromkeys(n for g in graphs for n in g.edges):
        first = next(g.edges[n] for g in graphs if n in g.edges)
        edges[n] = EdgeSet(union([own(g.edges[n].table, i) for i, g in enumerate(graphs) if n in g.edges]), first.source, first.target)
    context = union([own(g.context(), i) for i, g in enumerate(graphs)]).dropDuplicates(["component_id"])
    return PropertyGraph(nodes, edges, context)


def latent_nodes(edges: list[tuple[DataFrame, str]], few_components: bool = False) -> DataFrame:
    """The node set that edges' ends make: (component_id, node_id, pos), in order of first appearance.

    ``edges`` lists (table, tag) in order; a table's rows are ordered by position. ``few_components`` as in dense_index().
    """
    out = None
    for i, (df, tag) in enumerate(edges):
        own = df.select("component_id", F.col(end_column(tag)).alias("node_id"), F.struct(F.lit(i).alias("i"), position(df, "edge_id").alias("p")).alias("_at"))
        out = own if out is None else out.unionByName(own)
    first = out.groupBy("component_id", "node_id").agg(F.min("_at").alias("_at"))
    if few_components:
        flat = first.select("component_id", "node_id", F.col("_at.i").alias("_i"), F.col("_at.p").alias("_p"))
        return within_components(ordered_rank(flat, ["component_id", "_i", "_p", "node_id"], "pos"), "pos").select("component_id", "node_id", "pos")
    w = Window.partitionBy("component_id").orderBy("_at", "node_id")
    return first.select("component_id", "node_id", (F.row_number().over(w) - 1).cast("long").alias("pos"))


def index_edges(graph: PropertyGraph, edge_set: str, strict: bool = True, few_components: bool = False, index: dict[str, DataFrame] | None = None) -> DataFrame:
    """Edges with their ends' dense indices. An end that isn't a node raises (as the row is read), or is null if not strict.

    ``index`` has tables of nodes that are numbered already, in ``_i``, by node set.
    """
    e = graph.edges[edge_set]
    out = e.table
    for tag in (SOURCE, TARGET):
        numbered = index[e.end(tag)].withColumnRenamed("_i", f"{tag}_index") if index else dense_index(graph.nodes[e.end(tag)], "node_id", f"{tag}_index", few_components)
        ids = numbered.select("component_id", F.col("node_id").alias(end_column(tag)), f"{tag}_index")
        out = out.join(ids, ["component_id", end_column(tag)], "left")
        if strict:
            c = F.col(f"{tag}_index")
            out = out.withColumn(f"{tag}_index", F.when(c.isNull(), F.raise_error(F.lit(f"an end of {edge_set} isn't a node")).cast("long")).otherwise(c))
    return out


def connecting_edges(graph: PropertyGraph, edge_set: str, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges with both ends in given sets, by sample: both tables are (sample_id, node_id)."""
    s = sources.select("sample_id", F.col("node_id").alias("source_id")).distinct()
    t = targets.select("sample_id", F.col("node_id").alias("target_id")).distinct()
    return graph.edges[edge_set].table.join(s, "source_id").join(t, ["sample_id", "target_id"], "left_semi")


def lookup(queries: DataFrame, values: DataFrame, key: str, check: bool = True, defaults: bool = False) -> DataFrame:
    """Left join of queries with values by a key that must be unique among the values; repeated queries are kept.

    With ``defaults``, what isn't found gets 0, false or the empty string instead of null.
    """
    if check:
        values = values.groupBy(key).agg(F.count("*").alias("_n"), F.first(F.struct(*(c for c in values.columns if c != key))).alias("_v"))
        unique = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit(f"{key} repeats: "), F.col(key).cast("string"))).cast(values.schema["_v"].dataType)).otherwise(F.col("_v"))
        values = values.select(key, unique.alias("_u")).select(key, "_u.*")
    out = queries.join(values, key, "left")
    if defaults:
        for f in values.schema.fields:
            if f.name != key:
                out = out.withColumn(f.name, F.coalesce(F.col(f.name), default_value(f.dataType)))
    return out


def map_each(graph: PropertyGraph, fn: Callable[[DataFrame], DataFrame]) -> PropertyGraph:
    return graph.map_features(nodes=lambda df, _: fn(df), edges=lambda df, _: fn(df))

"""Graphs on disk: a schema in text format beside a table for each set, in CSV, Parquet or TFRecord."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.graph import EdgeSet, PropertyGraph
from weft.schema import CONTEXT, EDGES, NODES, GraphSchema, SchemaError, SetSchema, parse_schema, write_schema

_SHARD = re.compile(r"(?P<base>.*)@(?P<n>\d+)(?P<ext>\.\w+)?\Z")
_SHARDS = re.compile(r"(?P<base>.*?)-\d{5}-of-\d{5}(?P<ext>\.\w+)?\Z")


def guess_format(filename: str) -> str:
    """csv, parquet or tfrecord, by the name."""
    for kind, pattern in (("csv", r"\.csv\b"), ("parquet", r"\.parquet\b"), ("tfrecord", r"\.tfrecords?\b")):
        if re.search(pattern, filename):
            return kind
    raise ValueError(f"can't tell the format of {filename}")


def expand_shards(filename: str) -> str:
    """``base@3.csv`` and ``base.csv@3`` as a glob of their shards."""
    m = _SHARD.match(filename)
    return f"{m['base']}-?????-of-{int(m['n']):05d}{m['ext'] or ''}" if m else filename


def base_name(filename: str) -> str:
    """The name without shard numbers."""
    m = _SHARD.match(filename) or _SHARDS.match(filename)
    return m["base"] + (m["ext"] or "") if m else filename


def shard_count(filename: str) -> int:
    m = _SHARD.match(filename)
    return int(m["n"]) if m else 1


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def find_schema(spark: SparkSession, folder: str) -> str:
    """The folder's only .pbtxt file."""
    fs, _ = _hadoop(spark, folder)
    found = [str(s.getPath()) for s in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/*.pbtxt")) or []]
    if len(found) != 1:
        raise ValueError(f"{len(found)} schema files in {folder}")
    return found[0]


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())


def converter(kind: T.DataType) -> T.DataType:
    """How a table's column is read: floats as float, integers and booleans as long, strings as they are."""
    if isinstance(kind, (T.FloatType, T.DoubleType, T.StringType, T.ArrayType)):
        return kind
    return T.LongType()


def read_table(spark: SparkSession, path: str, features: dict[str, T.DataType] | None = None) -> DataFrame:
    """A table with columns cast to a schema's types; columns that it doesn't know stay strings (CSV) or as they are.

    Headers id, source and target mean #id, #source and #target. A CSV row of the wrong width fails.
    """
    kind, glob = guess_format(path), expand_shards(path)
    if kind == "csv":
        df = spark.read.csv(glob, header=True, mode="FAILFAST", quote='"', escape='"', multiLine=True)
    elif kind == "parquet":
        df = spark.read.parquet(glob)
    else:
        from weft.sources.tfrecord import read_examples

        return read_examples(spark, glob, {**(features or {}), "#id": T.StringType(), "#source": T.StringType(), "#target": T.StringType()})
    df = df.withColumnsRenamed({c: f"#{c}" for c in ("id", "source", "target") if c in df.columns})
    return df.withColumns({c: F.col(c).cast(t) for c, t in (features or {}).items() if c in df.columns and df.schema[c].dataType != t})


def is_reversed(s: SetSchema) -> bool:
    return s.metadata.get("edge_type") == "reversed"


def node_table(df: DataFrame) -> DataFrame:
    if "#id" not in df.columns:
        raise SchemaError("a node table has no id column")
    return df.withColumnRenamed("#id", "node_id")


def edge_table(df: DataFrame, swap: bool = False) -> DataFrame:
    for c in ("#source", "#target"):
        if c not in df.columns:
            raise SchemaError(f"an edge table has no {c[1:]} column")
    return df.withColumnsRenamed({"#source": "target_id", "#target": "source_id"} if swap else {"#source": "source_id", "#target": "target_id"})


def read_set(spark: SparkSession, s: SetSchema, folder: str) -> DataFrame | None:
    """A set's rows: from its file, else from its table or SQL query; None if the schema names no source."""
    features = {f: x.spark_type() for f, x in s.features.items()}
    if kind := s.metadata.get("component_type"):
        features["component_id"] = T.StringType() if kind == "string" else T.LongType()
    if name := s.metadata.get("filename"):
        return read_table(spark, name if name.startswith("/") or "://" in name else f"{folder}/{name}", features)
    for key, read in (("table", spark.table), ("sql", spark.sql)):
        if x := s.metadata.get(key):
            df = read(x)
            df = df.withColumnsRenamed({c: f"#{c}" for c in ("id", "source", "target") if c in df.columns})
            return df.select(*(c for c in df.columns if c.startswith("#")), *(F.col(f).cast(t) for f, t in features.items()))
    return None


def load_graph(spark: SparkSession, path: str) -> tuple[PropertyGraph, GraphSchema]:
    """The graph of a schema file, or of a folder with one; sets without a source are left out."""
    file = path if path.endswith(".pbtxt") else find_schema(spark, path)
    folder = file.rsplit("/", 1)[0]
    schema = parse_schema(read_text(spark, file))
    tables = {(kind, name): read_set(spark, s, folder) for kind, name, s in schema.iter_sets()}
    nodes = {n: node_table(tables[NODES, n]) for n in schema.node_sets if tables[NODES, n] is not None}
    edges = {n: (edge_table(tables[EDGES, n], is_reversed(s)), s.source, s.target) for n, s in schema.edge_sets.items() if tables[EDGES, n] is not None}
    context = tables.get((CONTEXT, ""))
    if context is not None and "component_id" not in context.columns:
        context = context.withColumn("component_id", F.lit(0).cast("long"))
    return PropertyGraph.of(nodes, edges, context), schema


def save_graph(graph: PropertyGraph, folder: str, kind: str = "parquet", shards: int | None = None) -> GraphSchema:
    """Write every set and the schema; CSV for graphs without array features, else Parquet or TFRecord."""
    schema, spark = graph.schema(), graph.spark
    named: dict[tuple[str, str], SetSchema] = {}
    for k, name, s in schema.iter_sets():
        file = f"{k}{'-' + name.replace('/', '_') if name else ''}.{kind}"
        df = graph.table(k, name)
        # Examples don't name their columns, so the schema says that there are components
        component = {"component_type": df.schema["component_id"].dataType.simpleString()} if kind == "tfrecord" and "component_id" in df.columns else {}
        keys = {NODES: {"node_id": "#id"}, EDGES: {"source_id": "#source", "target_id": "#target"}, CONTEXT: {}}[k]
        out = df.withColumnsRenamed(keys)
        if shards:
            out = out.repartition(shards)
        if kind == "csv":
            out.write.csv(f"{folder}/{file}", header=True)
        elif kind == "parquet":
            out.write.parquet(f"{folder}/{file}")
        else:
            from weft.sources.tfrecord import write_examples

            write_examples(out, f"{folder}/{file}")
        named[k, name] = SetSchema(s.features, s.source, s.target, s.context, {**s.metadata, "filename": file, **component}, s.description)
    out = GraphSchema({n: named[NODES, n] for n in schema.node_sets}, {n: named[EDGES, n] for n in schema.edge_sets}, named.get((CONTEXT, "")))
    write_schema(out, f"{folder}/graph_schema.pbtxt", spark)
    return out


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, node_id) of a table with an id column; a sample is named by its seed."""
    df = read_table(spark, path)
    return df.select(F.col("#id").alias("sample_id"), F.col("#id").alias("node_id"))


def read_link_seeds(spark: SparkSession, path: str, features: dict[str, T.DataType] | None = None) -> DataFrame:
    """(sample_id, source, target, features); samples are named S<source>:T<target>. Integers stay integers."""
    df = read_table(spark, path, features)
    return df.select(F.concat(F.lit("S"), F.col("#source"), F.lit(":T"), F.col("#target")).alias("sample_id"), F.col("#source").alias("source"), F.col("#target").alias("target"), *(c for c in df.columns if not c.startswith("#")))


def all_seeds(graph: PropertyGraph, node_set: str) -> DataFrame:
    """Every node as a seed."""
    return graph.nodes[node_set].select(F.col("node_id").alias("sample_id"), "node_id")


def local_rows(df: DataFrame) -> Iterator[dict]:
    """Rows one by one on the driver, a partition at a time."""
    return (r.asDict(recursive=True) for r in df.toLocalIterator())


def mix_datasets(parts: list[tuple[DataFrame, float]], rows: int | None = None, seed: int = 0) -> DataFrame:
    """Weighted sample of datasets: the first is taken once, the others repeat as often as their weight asks.

    ``rows`` fixes the first's share: rows / weight in all.
    """
    first, w0 = parts[0]
    n0 = rows if rows is not None else first.count()
    total = int(n0 / w0)
    out = first if rows is None else first.limit(rows)
    for i, (df, w) in enumerate(parts[1:]):
        n, want = df.count(), round(total * w)
        if not n or not want:
            continue
        times, rest = divmod(want, n)
        again = df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(times)))).withColumn("_h", F.xxhash64(F.lit(seed + i), *df.columns, "_k"))
        whole = again.where(F.col("_k") < times)
        part = again.where(F.col("_k") == times).orderBy("_h").limit(rest)
        out = out.unionByName(whole.unionByName(part).drop("_k", "_h"))
    return out


def shuffled(df: DataFrame, seed: int = 0) -> DataFrame:
    return df.orderBy(F.xxhash64(F.lit(seed), *df.columns))


def edge_lists_from_arrays(spark: SparkSession, edge_index: list[list[int]], n_nodes: int, node_features: dict[str, list] | None = None, name: str = "nodes", edge_set: str = "edges") -> PropertyGraph:
    """A homogeneous graph of index arrays: node ids are the set's name and number."""
    ids = [f"{name}{i}" for i in range(n_nodes)]
    cols = node_features or {}
    rows = [(i, *(cols[c][k] for c in cols)) for k, i in enumerate(ids)]
    nodes = spark.createDataFrame(rows, ["node_id", *cols]) if rows else spark.createDataFrame([], "node_id string")
    pairs = [(i, ids[s], ids[t]) for i, (s, t) in enumerate(zip(*edge_index, strict=True))]
    edges = spark.createDataFrame(pairs, "edge_id long, source_id string, target_id string")
    return PropertyGraph.of({name: nodes}, {edge_set: (edges, name, name)})


def graph_from_arrays(spark: SparkSession, nodes: dict[str, int], edge_index: dict[tuple[str, str, str], list[list[int]]], features: dict[str, dict[str, list]] | None = None) -> PropertyGraph:
    """A heterogeneous graph of index arrays, by (source set, edge set, target set): node ids are the set's name and number."""
    tables = {}
    for n, k in nodes.items():
        cols = (features or {}).get(n, {})
        rows = [(f"{n}{i}", *(cols[c][i] for c in cols)) for i in range(k)]
        tables[n] = spark.createDataFrame(rows, ["node_id", *cols]) if rows else spark.createDataFrame([], "node_id string")
    edges = {}
    for (s, name, t), pairs in edge_index.items():
        rows = [(i, f"{s}{a}", f"{t}{b}") for i, (a, b) in enumerate(zip(*pairs, strict=True))]
        edges[name] = (spark.createDataFrame(rows, "edge_id long, source_id string, target_id string"), s, t)
    return PropertyGraph.of(tables, edges)


def write_table(df: DataFrame, filename: str) -> None:
    """Write a CSV or Parquet table as the files ``base-00000-of-00003.csv`` and so on that ``base@3.csv`` stands for; without @ as one file."""
    spark, n, kind = df.sparkSession, shard_count(filename), guess_format(filename)
    folder = f"{filename}.parts"
    out = df.repartition(n).write
    out.csv(folder, header=True) if kind == "csv" else out.parquet(folder)
    fs, p = _hadoop(spark, folder)
    parts = sorted(str(s.getPath()) for s in fs.listStatus(p) if s.getPath().getName().startswith("part-"))
    m = _SHARD.match(filename)
    for i in range(n):
        name = f"{m['base']}-{i:05d}-of-{n:05d}{m['ext'] or ''}" if m else filename
        to = spark._jvm.org.apache.hadoop.fs.Path(name)
        if i < len(parts):
            fs.rename(spark._jvm.org.apache.hadoop.fs.Path(parts[i]), to)
        else:  # Spark writes no file for an empty partition
            stream = fs.create(to)
            if kind == "csv":
                stream.write(bytearray((",".join(df.columns) + "\n").encode()))
            stream.close()
    fs.delete(p, True)


def triples_to_graph(triples: DataFrame, subject: str = "s", predicate: str = "p", obj: str = "o", order: Column | None = None, predicates: list[str] | None = None) -> PropertyGraph:
    """One node set ``nodes`` of all subjects and objects, in order of first appearance, and an edge set for each predicate."""
    from weft.operators.structure import latent_nodes

    t = triples.select(F.lit(0).cast("long").alias("component_id"), F.col(subject).alias("source_id"), F.col(predicate).alias("_p"), F.col(obj).alias("target_id"), (order if order is not None else F.monotonically_increasing_id()).alias("edge_id"))
    nodes = latent_nodes([(t.drop("_p"), "source"), (t.drop("_p"), "target")])
    names = predicates or [r[0] for r in t.select("_p").distinct().orderBy("_p").collect()]
    return PropertyGraph({"nodes": nodes}, {p: EdgeSet(t.where(F.col("_p") == p).drop("_p"), "nodes", "nodes") for p in names}, None)


def to_edge_list(graph: PropertyGraph) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with global numbers: node sets in order of name, then components and positions."""
    from pyspark.sql import Window

    from weft.graph import position
    from weft.operators.structure import ordered_rank

    nodes = None
    for i, n in enumerate(sorted(graph.nodes)):
        df = graph.nodes[n]
        own = df.select(F.lit(i).alias("_i"), F.lit(n).alias("node_set"), "component_id", "node_id", position(df, "node_id").cast("string").alias("_p"), position(df, "node_id").alias("_q"))
        own = ordered_rank(own, ["component_id", "_q"], "local_id").drop("_q", "_p")
        nodes = own if nodes is None else nodes.unionByName(own)
    sizes = nodes.groupBy("_i").agg(F.count("*").alias("n"))
    first = sizes.select("_i", F.coalesce(F.sum("n").over(Window.orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    nodes = nodes.join(F.broadcast(first), "_i").withColumn("global_id", F.col("_first") + F.col("local_id")).drop("_i", "_first")
    edges = None
    for n in sorted(graph.edges):
        e = graph.edges[n]
        own = e.table.select(F.lit(n).alias("edge_set"), "component_id", "edge_id", "source_id", "target_id")
        for tag, to in (("source", e.source), ("target", e.target)):
            ids = nodes.where(F.col("node_set") == to).select("component_id", F.col("node_id").alias(f"{tag}_id"), F.col("global_id").alias(tag))
            own = own.join(ids, ["component_id", f"{tag}_id"])
        own = own.select("edge_set", "component_id", "edge_id", "source", "target")
        edges = own if edges is None else edges.unionByName(own)
    return nodes, edges


def random_graph(spark: SparkSession, schema: GraphSchema, nodes: dict[str, int], edges: dict[str, int], seed: int = 0) -> PropertyGraph:
    """A random graph of given sizes for a schema; arrays of varying size get 0 to 8 items."""

    def value(x, key: Column, depth: int = 0) -> Column:
        dims = x.shape[depth:]
        if dims:
            n = F.lit(dims[0]) if dims[0] >= 0 else (F.pmod(F.xxhash64(F.lit(seed), key, F.lit("n")), F.lit(9))).cast("int")
            return F.transform(F.slice(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), 1, n), lambda i: value(x, F.xxhash64(key, i), depth + 1))
        h = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_003))
        if x.dtype == "DT_STRING":
            return F.substring(F.md5(h.cast("string")), 1, 8)
        if x.dtype == "DT_BOOL":
            return h % 2 == 0
        return (h / 1_000_003.0 if x.dtype in ("DT_FLOAT", "DT_DOUBLE", "DT_HALF", "DT_BFLOAT16") else h % 100).cast(x.spark_type() if not x.shape else "double")

    def features(df: DataFrame, s: SetSchema, salt: str) -> DataFrame:
        return df.withColumns({f: value(x, F.concat(F.lit(f"{salt}/{f}/"), F.col("id").cast("string"))).cast(x.spark_type()) for f, x in s.features.items()})

    node_tables = {n: features(spark.range(nodes[n]), s, n).withColumnRenamed("id", "node_id") for n, s in schema.node_sets.items()}
    edge_tables = {}
    for n, s in schema.edge_sets.items():
        e = features(spark.range(edges[n]), s, n)
        end = lambda tag, of: F.pmod(F.xxhash64(F.lit(seed), F.lit(tag), "id"), F.lit(nodes[of]))
        edge_tables[n] = (e.withColumn("source_id", end("s", s.source)).withColumn("target_id", end("t", s.target)).withColumnRenamed("id", "edge_id"), s.source, s.target)
    context = None
    if schema.context is not None:
        context = features(spark.range(1), schema.context, "context").withColumnRenamed("id", "component_id")
    return PropertyGraph.of(node_tables, edge_tables, context)


def generated(spark: SparkSession, make: Callable[[int], Iterator[tuple]], parts: int, schema: str) -> DataFrame:
    """Rows that a generator makes for each of some parts, each part in a task of its own."""
    import pandas as pd

    names = [f.name for f in T._parse_datatype_string(schema).fields] if not isinstance(schema, T.StructType) else schema.names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in b["id"].tolist():
                rows: list[tuple] = []
                for row in make(int(i)):
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return spark.range(parts, numPartitions=parts).mapInPandas(run, schema)


@dataclass(frozen=True)
class Dataset:
    """Where rows come from, and how they are given out: shuffled by a seed, repeated, as a share of this worker's."""

    load: Callable[[SparkSession], DataFrame]
    seed: int | None = None
    times: int = 1

    def read(self, spark: SparkSession, worker: int = 0, workers: int = 1) -> DataFrame:
        df = self.load(spark)
        if workers > 1:
            df = df.where(F.pmod(F.xxhash64(*df.columns), F.lit(workers)) == worker)
        if self.times > 1:
            df = df.withColumn("_time", F.explode(F.sequence(F.lit(1), F.lit(self.times)))).drop("_time")
        return df if self.seed is None else shuffled(df, self.seed)

"""Graph schemas: dataclasses, a text-format reader and writer, conversion to Spark types, validation.

A schema names one optional context, node sets and edge sets, and the features of each. A feature has a
type and a shape: no dimensions is a scalar, each further dimension nests an array; -1 is a dimension
of varying size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import types as T

CONTEXT, NODES, EDGES = "context", "nodes", "edges"
SOURCE, TARGET = "source", "target"
#: Names that start with one of these belong to auxiliary sets, which modelling operators skip.
AUX_PREFIXES = "_#!%.^~"
#: Column names that features may not take.
RESERVED = {"component_id", "node_id", "edge_id", "source_id", "target_id", "pos", "#id", "#source", "#target", "#size"}

_SPARK = {
    "DT_BOOL": T.BooleanType(), "DT_INT8": T.ByteType(), "DT_INT16": T.ShortType(), "DT_INT32": T.IntegerType(), "DT_INT64": T.LongType(),
    "DT_UINT8": T.ShortType(), "DT_UINT16": T.IntegerType(), "DT_UINT32": T.LongType(), "DT_UINT64": T.LongType(),
    "DT_BFLOAT16": T.FloatType(), "DT_HALF": T.FloatType(), "DT_FLOAT": T.FloatType(), "DT_DOUBLE": T.DoubleType(), "DT_STRING": T.StringType(),
}
_BACK = {T.BooleanType: "DT_BOOL", T.ByteType: "DT_INT8", T.ShortType: "DT_INT16", T.IntegerType: "DT_INT32", T.LongType: "DT_INT64", T.FloatType: "DT_FLOAT", T.DoubleType: "DT_DOUBLE", T.StringType: "DT_STRING", T.DecimalType: "DT_DOUBLE", T.BinaryType: "DT_STRING", T.TimestampType: "DT_INT64", T.TimestampNTZType: "DT_INT64", T.DateType: "DT_INT64"}


class SchemaError(ValueError):
    """A schema, or a graph against its schema, is invalid."""


@dataclass(frozen=True)
class Feature:
    dtype: str = "DT_FLOAT"
    shape: tuple[int, ...] = ()
    description: str = ""

    def spark_type(self) -> T.DataType:
        out: T.DataType = _SPARK[self.dtype]
        for _ in self.shape:
            out = T.ArrayType(out)
        return out

    @staticmethod
    def of(kind: T.DataType) -> Feature:
        depth = 0
        while isinstance(kind, T.ArrayType):
            kind, depth = kind.elementType, depth + 1
        if type(kind) not in _BACK:
            raise SchemaError(f"no feature type for {kind.simpleString()}")
        return Feature(_BACK[type(kind)], (-1,) * depth)


@dataclass(frozen=True)
class SetSchema:
    features: dict[str, Feature] = field(default_factory=dict)
    source: str = ""
    target: str = ""
    context: tuple[str, ...] = ()
    metadata: dict[str, str] = field(default_factory=dict)
    description: str = ""


@dataclass(frozen=True)
class GraphSchema:
    node_sets: dict[str, SetSchema] = field(default_factory=dict)
    edge_sets: dict[str, SetSchema] = field(default_factory=dict)
    context: SetSchema | None = None

    def iter_sets(self) -> Iterator[tuple[str, str, SetSchema]]:
        """(kind, name, set): context (only if present), node sets, edge sets."""
        if self.context is not None:
            yield CONTEXT, "", self.context
        for kind, sets in ((NODES, self.node_sets), (EDGES, self.edge_sets)):
            for name, s in sets.items():
                yield kind, name, s

    def iter_features(self) -> Iterator[tuple[str, str, str, Feature]]:
        for kind, name, s in self.iter_sets():
            for f, x in s.features.items():
                yield kind, name, f, x

    def struct_type(self, kind: str, name: str = "") -> T.StructType:
        """The columns that a set's table must have."""
        s = {CONTEXT: {"": self.context}, NODES: self.node_sets, EDGES: self.edge_sets}[kind][name]
        keys = {CONTEXT: [], NODES: ["node_id"], EDGES: ["source_id", "target_id"]}[kind]
        return T.StructType([*(T.StructField(k, T.StringType(), False) for k in keys), *(T.StructField(f, x.spark_type()) for f, x in s.features.items())])


def is_supported_type(kind: str) -> bool:
    return kind in _SPARK


def aux_prefix(name: str) -> str | None:
    """The first character of an auxiliary set's name, else None."""
    return name[0] if name and name[0] in AUX_PREFIXES else None


def reverse_tag(tag: str) -> str:
    if tag not in (SOURCE, TARGET):
        raise ValueError(f"no reverse of {tag!r}")
    return TARGET if tag == SOURCE else SOURCE


# ---------------------------------------------------------------- text format

_TOKEN = re.compile(r"""\s+|\#[^\n]*|(?P<open>[{<])|(?P<close>[}>])|(?P<str>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(?P<sign>[:,;\[\]])|(?P<word>[^\s{}<>:;,\[\]"'\#]+)""")


def parse_text(text: str) -> dict[str, list]:
    """Text-format message as {field: [values]}; a value is a string or another message."""
    tokens = [(m.lastgroup, m[m.lastgroup]) for m in _TOKEN.finditer(text) if m.lastgroup]
    at = 0

    def value() -> object:
        nonlocal at
        kind, x = tokens[at]
        at += 1
        if kind == "open":
            return message()
        if kind != "str":
            return x
        out = _unquote(x)
        while at < len(tokens) and tokens[at][0] == "str":
            out += _unquote(tokens[at][1])
            at += 1
        return out

    def message(top: bool = False) -> dict[str, list]:
        nonlocal at
        out: dict[str, list] = {}
        while at < len(tokens):
            kind, name = tokens[at]
            at += 1
            if kind == "close":
                if top:
                    raise SchemaError("unbalanced brackets")
                return out
            if kind == "sign":
                continue
            if at < len(tokens) and tokens[at] == ("sign", ":"):
                at += 1
            if at >= len(tokens):
                raise SchemaError(f"{name} has no value")
            if tokens[at] == ("sign", "["):
                at += 1
                while tokens[at] != ("sign", "]"):
                    if tokens[at] == ("sign", ","):
                        at += 1
                    else:
                        out.setdefault(name, []).append(value())
                at += 1
            else:
                out.setdefault(name, []).append(value())
        if not top:
            raise SchemaError("unbalanced brackets")
        return out

    return message(True)


_ESCAPES = {"n": 10, "t": 9, "r": 13, "a": 7, "b": 8, "f": 12, "v": 11}


def _unquote(x: str) -> str:
    """A quoted string's text; octal and hexadecimal escapes are bytes of its UTF-8."""

    def byte(m: re.Match) -> bytes:
        e = m[1].decode()
        n = int(e[1:], 16) if e[0] in "xX" and len(e) > 1 else int(e, 8) if e[0] in "01234567" else _ESCAPES.get(e, ord(e))
        return bytes([n & 255])

    return re.sub(rb"\\([xX][0-9a-fA-F]{1,2}|[0-7]{1,3}|[\x00-\x7f])", byte, x[1:-1].encode()).decode("utf-8", "replace")


def _one(m: dict, name: str, default: object = "") -> object:
    return m.get(name, [default])[-1]


def _features(m: dict) -> dict[str, Feature]:
    out = {}
    for x in m.get("features", []):
        v = _one(x, "value", {})
        dims = [int(_one(d, "size", "-1")) for s in v.get("shape", []) for d in s.get("dim", [])]
        out[_one(x, "key")] = Feature(_one(v, "dtype", "DT_INVALID"), tuple(dims), _one(v, "description"))
    return out


def _set(m: dict) -> SetSchema:
    meta = _one(m, "metadata", {})
    known = {k: v[-1] for k, v in meta.items() if isinstance(v[-1], str)}
    known |= {_one(x, "key"): _one(x, "value") for x in meta.get("extra", [])}
    return SetSchema(_features(m), _one(m, "source"), _one(m, "target"), tuple(m.get("context", [])), known, _one(m, "description"))


def parse_schema(text: str) -> GraphSchema:
    m = parse_text(text)
    sets = lambda name: {_one(x, "key"): _set(_one(x, "value", {})) for x in m.get(name, [])}
    return GraphSchema(sets("node_sets"), sets("edge_sets"), _set(_one(m, "context", {})) if "context" in m else None)


def write_text(schema: GraphSchema) -> str:
    """The schema in text format; parse_schema() reads it back."""
    q = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'
    out: list[str] = []

    def body(s: SetSchema, pad: str) -> None:
        for k, v in (("description", s.description), ("source", s.source), ("target", s.target)):
            if v:
                out.append(f"{pad}{k}: {q(v)}")
        out.extend(f"{pad}context: {q(c)}" for c in s.context)
        if s.metadata:
            out.append(f"{pad}metadata {{")
            for k, v in s.metadata.items():
                own = k in ("filename", "cardinality")
                out.append(f"{pad}  {k}: {v if k == 'cardinality' else q(v)}" if own else f"{pad}  extra {{ key: {q(k)} value: {q(v)} }}")
            out.append(pad + "}")
        for name, f in s.features.items():
            shape = " ".join(f"dim {{ size: {d} }}" for d in f.shape)
            text = f" description: {q(f.description)}" if f.description else ""
            out.append(f"{pad}features {{ key: {q(name)} value {{ dtype: {f.dtype}{text}{f' shape {{ {shape} }}' if shape else ''} }} }}")

    for kind, name, s in schema.iter_sets():
        if kind == CONTEXT:
            out.append("context {")
            body(s, "  ")
            out.append("}")
        else:
            out.append(f"{'node_sets' if kind == NODES else 'edge_sets'} {{\n  key: {q(name)}\n  value {{")
            body(s, "    ")
            out.append("  }\n}")
    return "\n".join(out) + "\n"


def read_schema(path: str, spark: SparkSession | None = None) -> GraphSchema:
    """The schema of a file; with a session, of any file system that Spark reads."""
    if spark is not None:
        return parse_schema("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
    with open(path) as f:
        return parse_schema(f.read())


def write_schema(schema: GraphSchema, path: str, spark: SparkSession | None = None) -> None:
    """Write a schema in text format; with a session, to any file system that Spark writes."""
    if spark is not None:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p)
        out.write(bytearray(write_text(schema).encode()))
        out.close()
        return
    with open(path, "w") as f:
        f.write(write_text(schema))


# ---------------------------------------------------------------- validation


def validate_schema(schema: GraphSchema) -> list[str]:
    """Raise SchemaError for what is wrong; return warnings."""
    warnings = []
    for kind, name, feature, x in schema.iter_features():
        where = f"{kind}/{name}/{feature}"
        if not is_supported_type(x.dtype):
            raise SchemaError(f"{where}: unsupported type {x.dtype}")
        if feature in RESERVED or feature.startswith("#"):
            raise SchemaError(f"{where}: reserved name")
        if any(d < -1 or d == 0 for d in x.shape):
            raise SchemaError(f"{where}: invalid dimension")
        if x.shape and x.shape[0] == 1 and len(x.shape) == 1:
            warnings.append(f"{where}: one dimension of size 1 could be a scalar")
    for name, s in schema.node_sets.items():
        for c in s.context:
            if schema.context is None or c not in schema.context.features:
                raise SchemaError(f"nodes/{name}: no context feature {c}")
    for name, s in schema.edge_sets.items():
        for end in (s.source, s.target):
            if not end:
                raise SchemaError(f"edges/{name}: an endpoint has no node set")
            if end not in schema.node_sets:
                raise SchemaError(f"edges/{name}: no node set {end}")
        if name.startswith("_readout/") and s.target != "_readout":
            raise SchemaError(f"edges/{name}: readout edges must end in _readout")
    return warnings


def check_required_features(required: GraphSchema, actual: GraphSchema) -> None:
    """Raise unless all sets and features asked for are there; a dimension of 0 asks for any size."""
    have = {(k, n, f): x for k, n, f, x in actual.iter_features()}
    sets = {(k, n) for k, n, _ in actual.iter_sets()}
    for kind, name, _ in required.iter_sets():
        if (kind, name) not in sets:
            raise SchemaError(f"missing {kind}/{name}")
    for kind, name, feature, x in required.iter_features():
        got = have.get((kind, name, feature))
        if got is None:
            raise SchemaError(f"missing {kind}/{name}/{feature}")
        if x.dtype != "DT_INVALID" and got.dtype != x.dtype:
            raise SchemaError(f"{kind}/{name}/{feature}: {got.dtype}, not {x.dtype}")
        if len(x.shape) != len(got.shape) or any(a not in (0, b) for a, b in zip(x.shape, got.shape, strict=False)):
            raise SchemaError(f"{kind}/{name}/{feature}: shape {got.shape}, not {x.shape}")

"""Sampling in SQL: table functions with partitioned TABLE arguments, over the views that a graph registers.

    register(spark)
    graph.register_views("g_")
    spark.sql('''SELECT * FROM top_k(TABLE(SELECT s.node_id AS sample_id, e.* FROM g_nodes_customer s JOIN g_edges_placed e ON e.source_id = s.node_id)
                 PARTITION BY (sample_id, source_id) ORDER BY (weight DESC, edge_id), 2)''')

``top_k(TABLE ... PARTITION BY ... ORDER BY ..., k)`` passes the first k rows of each partition on; ``draw(TABLE ...
PARTITION BY ..., k, seed, columns)`` k rows drawn by md5 of seed and the named columns, which should tell rows apart;
``softmax_sums(TABLE ... PARTITION BY (receiver), value, receiver columns)`` gives each partition's largest value and the sum
of exp(value - largest), with which a join gives every row's share. Rows stream through, so a partition of any size
takes k rows or two numbers of memory. Columns of results are those of the table (and top and total).
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, SkipRestOfInputTableException


def _names(text: str) -> list[str]:
    return [x.strip() for x in text.split(",") if x.strip()]


@udtf
class TopK:
    """The first k rows of each partition, in the order that the query gives."""

    def __init__(self) -> None:
        self.n = 0

    @staticmethod
    def analyze(table: AnalyzeArgument, k: AnalyzeArgument) -> AnalyzeResult:
        return AnalyzeResult(schema=table.dataType)

    def eval(self, row: Row, k: int) -> Iterator[tuple]:
        self.n += 1
        if self.n <= k:
            yield tuple(row)
        if self.n >= k:
            raise SkipRestOfInputTableException("the partition's first rows are out")


@udtf
class Draw:
    """k rows of each partition by the least md5 of seed and some columns."""

    def __init__(self) -> None:
        self.held: list[tuple] = []
        self.n = 0

    @staticmethod
    def analyze(table: AnalyzeArgument, k: AnalyzeArgument, seed: AnalyzeArgument, columns: AnalyzeArgument) -> AnalyzeResult:
        missing = [c for c in _names(columns.value) if c not in table.dataType.names]
        if missing:
            raise ValueError(f"no columns {missing}")
        return AnalyzeResult(schema=table.dataType)

    def eval(self, row: Row, k: int, seed: int, columns: str) -> None:
        key = hashlib.md5("|".join(map(str, [seed, *(row[c] for c in _names(columns))])).encode()).hexdigest()
        self.n += 1
        # the largest keys are on top; rows themselves are never compared
        item = (-int(key, 16), -self.n, tuple(row))
        if len(self.held) < k:
            heapq.heappush(self.held, item)
        elif k and item > self.held[0]:
            heapq.heapreplace(self.held, item)

    def terminate(self) -> Iterator[tuple]:
        for _, _, row in sorted(self.held, reverse=True):
            yield row


@udtf
class SoftmaxSums:
    """The key columns of each partition, its largest value, and the sum of exp(value - largest); null values don't count."""

    def __init__(self) -> None:
        self.key: tuple | None = None
        self.top, self.total = -math.inf, 0.0

    @staticmethod
    def analyze(table: AnalyzeArgument, value: AnalyzeArgument, key: AnalyzeArgument) -> AnalyzeResult:
        fields = {f.name: f for f in table.dataType.fields}
        return AnalyzeResult(schema=T.StructType([*(fields[c] for c in _names(key.value)), T.StructField("top", T.DoubleType()), T.StructField("total", T.DoubleType())]))

    def eval(self, row: Row, value: str, key: str) -> None:
        self.key = self.key or tuple(row[c] for c in _names(key))
        x = row[value]
        if x is not None:
            x = float(x)
            if x > self.top:
                self.total, self.top = self.total * math.exp(self.top - x) if self.total else 0.0, x
            self.total += math.exp(x - self.top)

    def terminate(self) -> Iterator[tuple]:
        if self.key is not None:
            yield (*self.key, self.top if self.total else None, self.total)


def register(spark: SparkSession) -> None:
    """Make the table functions known to spark.sql."""
    for name, fn in (("top_k", TopK), ("draw", Draw), ("softmax_sums", SoftmaxSums)):
        spark.udtf.register(name, fn)

"""Incremental graph views over streams of edges: windowed degrees and first-hop pooling, with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.message import REDUCERS


def windowed_degree(edges: DataFrame, time: str = "ts", window: str = "1 day", late: str = "1 hour", by: str = "source_id") -> DataFrame:
    """(window start, node_id, degree) of a stream of edges; the same plan runs on a batch."""
    source = edges.withWatermark(time, late) if edges.isStreaming else edges
    out = source.groupBy(F.window(time, window).alias("w"), F.col(by).alias("node_id")).agg(F.count("*").alias("degree"))
    return out.select(F.col("w.start").alias("start"), "node_id", "degree")


def windowed_pool(edges: DataFrame, feature: str, reduce: str = "sum", time: str = "ts", window: str = "1 day", late: str = "1 hour", by: str = "source_id") -> DataFrame:
    """(window start, node_id, value): a feature of edges pooled to their nodes. Nodes without edges in a window have no row."""
    source = edges.withWatermark(time, late) if edges.isStreaming else edges
    out = source.groupBy(F.window(time, window).alias("w"), F.col(by).alias("node_id")).agg(REDUCERS[reduce].agg(F.col(feature)).alias("value"))
    return out.select(F.col("w.start").alias("start"), "node_id", "value")


def latest_edges(edges: DataFrame, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each edge id once within the watermark, for streams that repeat edges."""
    return edges.withWatermark(time, late).dropDuplicatesWithinWatermark(["edge_id"]) if edges.isStreaming else edges.dropDuplicates(["edge_id"])

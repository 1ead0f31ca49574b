"""Uniform draws by position: an index of edges by (source, dense position), and distinct positions drawn from degrees.

A hop draws positions below the source's degree first and then joins the edges by (source, position), so an
edge is read once for each draw that takes it, whatever its source's degree. The draws of a source are
Floyd's subset: step j of the last k below the degree takes a hash modulo j + 1, or j itself if that was taken
before. The hash is md5 of seed, op, sample, source and j, so draws are the same under any partitioning or retry.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.graph import position
from weft.operators.structure import attach_groups, ordered_rank, written


@dataclass(frozen=True)
class PositionIndex:
    """Edges with ``_at``, their place among their source's, from 0; and (source_id, degree)."""

    edges: DataFrame
    degrees: DataFrame


def position_index(edges: DataFrame) -> PositionIndex:
    """The written index of an edge table: edges are ranked by range partitions over source, position and id, so hubs are no task's."""
    e = edges.drop("component_id").withColumn("_pos", position(edges, "edge_id"))
    ranked = written(ordered_rank(e, ["source_id", "_pos", "edge_id"], "_rank"), "ranked")
    first = written(ranked.groupBy("source_id").agg(F.min("_rank").alias("_first"), F.count("*").alias("degree")), "degrees")
    placed = attach_groups(ranked, first, "source_id", "degree", ranked.count())
    return PositionIndex(written(placed.select(*e.drop("_pos").columns, (F.col("_rank") - F.col("_first")).alias("_at")), "positions"), first.select("source_id", "degree"))


def drawn_positions(degree: Column, k: int, key: Column) -> Column:
    """min(k, degree) distinct positions below the degree, every such set being as likely."""
    step = lambda j: F.struct(j.alias("j"), (F.conv(F.substring(F.md5(F.concat_ws("|", key, j.cast("string"))), 1, 15), 16, 10).cast("long") % (j + 1)).alias("t"))
    steps = F.transform(F.sequence(degree - k, degree - 1), step)
    some = F.aggregate(steps, F.array().cast("array<long>"), lambda got, s: F.concat(got, F.array(F.when(F.array_contains(got, s["t"]), s["j"]).otherwise(s["t"]))))
    return F.when(degree <= k, F.sequence(F.lit(0).cast("long"), degree - 1)).otherwise(some)


def draw(frontier: DataFrame, index: PositionIndex, k: int, seed: int, op: str, occurrence: bool = False) -> DataFrame:
    """At most k edges of every (sample_id, node_id) of the frontier, without replacement; edges with sample_id."""
    if k < 1:
        raise ValueError("a hop draws one edge at least")
    key = F.concat_ws("|", F.lit(str(seed)), F.lit(op), F.col("sample_id").cast("string"), F.col("source_id").cast("string"), *([F.col("_n").cast("string")] if occurrence else []))
    near = frontier.withColumnRenamed("node_id", "source_id").join(index.degrees, "source_id")
    taken = near.withColumn("_at", F.explode(drawn_positions(F.col("degree"), k, key))).drop("degree", "_n")
    return taken.join(index.edges, ["source_id", "_at"]).drop("_at")

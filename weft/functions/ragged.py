"""Functions of ragged rows, as tables of (row_id, value) with a position or weight column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.structure import keyed_random


def choice(rows: DataFrame, k: int, seed: int = 0, key: str = "value") -> DataFrame:
    """min(k, n) values of each row, without replacement, by a seeded key; ``key`` tells a row's values apart."""
    w = Window.partitionBy("row_id").orderBy(keyed_random(seed, "row_id", key), key)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def top_k(rows: DataFrame, k: int) -> DataFrame:
    """The k heaviest of each row; ties go to the lower position."""
    w = Window.partitionBy("row_id").orderBy(F.col("weight").desc(), "pos")
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def unique(rows: DataFrame) -> DataFrame:
    """Distinct values of each row, numbered by first appearance."""
    first = rows.groupBy("row_id", "value").agg(F.min("pos").alias("_p"))
    w = Window.partitionBy("row_id").orderBy("_p", "value")
    return first.select("row_id", "value", (F.row_number().over(w) - 1).cast("long").alias("pos"))


def lookup(rows: DataFrame, vocabulary: DataFrame, global_index: bool = False) -> DataFrame:
    """Position of each value in its row's vocabulary; an unknown value raises when its row is read.

    With ``global_index`` positions count on from the vocabularies of the rows before.
    """
    v = vocabulary.select("row_id", "value", F.col("pos").alias("index"))
    if global_index:
        sizes = v.groupBy("row_id").agg(F.count("*").alias("_n"))
        first = sizes.select("row_id", F.coalesce(F.sum("_n").over(Window.orderBy("row_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
        v = v.join(first, "row_id").select("row_id", "value", (F.col("index") + F.col("_first")).alias("index"))
    out = rows.join(v, ["row_id", "value"], "left")
    return out.withColumn("index", F.when(F.col("index").isNull(), F.raise_error(F.lit("a value isn't in its row's vocabulary")).cast("long")).otherwise(F.col("index")))


def row_ids(lengths: Column) -> Column:
    """[2, 1, 0, 2] -> [0, 0, 1, 3, 3]."""
    return F.flatten(F.transform(lengths, lambda n, i: F.array_repeat(i, n)))


def shuffle_within(rows: DataFrame, seed: int = 0) -> DataFrame:
    """A random permutation of the positions of each row."""
    w = Window.partitionBy("row_id").orderBy(keyed_random(seed, "row_id", "pos"))
    return rows.withColumn("pos", (F.row_number().over(w) - 1).cast("long"))

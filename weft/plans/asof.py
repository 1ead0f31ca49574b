"""The state of edges as of a time.

An edge may have several rows, versions of it with a time from which they hold. As of a time the last version at
or before it is in force, unless it has expired by then or marks a removal. ``edges_in_force`` finds them all, as
intervals joined by source. ``last_before`` finds one version a question: versions and questions are merged in one
stream by key and time: times are cut into at most BUCKETS buckets of about equal numbers of versions, the
last version before each question is found by a window over its key and bucket, and where its bucket has none it
is carried over from the last bucket before that has one. So a key of many versions is dealt over as many tasks
as buckets, and what is carried over is one version a bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.operators.structure import written

BUCKETS = 64
#: A source of more versions or questions than this is a hub: dealt over time buckets.
HUB_ROWS = 4096


def _bounds(versions: DataFrame, time: str, buckets: int) -> list[float]:
    """Times, as numbers, that cut the versions into at most so many parts of about equal size."""
    shares = [i / buckets for i in range(1, buckets)]
    return sorted(set(versions.select(_number(F.col(time), versions.schema[time].dataType).alias("t")).approxQuantile("t", shares, 1 / (4 * buckets)))) if shares else []


def _number(t: Column, kind: T.DataType) -> Column:
    return t.cast("timestamp").cast("double") if kind.simpleString().startswith(("timestamp", "date")) else t.cast("double")


def _place(bounds: list[float], t: Column, kind: T.DataType) -> Column:
    """Bucket numbers: the number of bounds at or below a time."""
    out = F.lit(0)
    for b in bounds:
        out = out + (_number(t, kind) >= b).cast("int")
    return out


def last_before(queries: DataFrame, versions: DataFrame, by: Sequence[str], query_time: str, time: str, tie: str, buckets: int = BUCKETS) -> DataFrame:
    """The queries' columns and ``_version``, a struct of the last version of their key at or before their time, or null.

    Of versions of one key and time that with the largest ``tie`` counts. Null times and keys find nothing.
    """
    by = list(by)
    # made once: both are read several times
    v = written(versions.where(" and ".join(f"`{c}` is not null" for c in [*by, time])).select(*by, F.struct(*(c for c in versions.columns)).alias("_v"), F.col(time).alias("_t"), F.struct(F.col(tie).alias("x")).alias("_tie")), "versions")
    kind = v.schema["_t"].dataType
    bucket = _place(_bounds(v, "_t", buckets), F.col("_t"), kind)
    v = v.withColumn("_bucket", bucket)
    q = queries.select(*by, F.struct(*queries.columns).alias("_q"), F.col(query_time).cast(kind).alias("_t")).withColumn("_bucket", bucket)
    none = lambda name, of: F.lit(None).cast(of.schema[name].dataType).alias(name)
    both = v.select(*by, "_t", "_bucket", "_tie", "_v", none("_q", q)).unionByName(q.select(*by, "_t", "_bucket", none("_tie", v), none("_v", v), "_q"))
    # versions come before the questions of their time
    w = Window.partitionBy(*by, "_bucket").orderBy(F.col("_t"), F.col("_q").isNotNull(), F.col("_tie")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = both.withColumn("_version", F.last("_v", True).over(w)).where("_q is not null")
    ends = v.groupBy(*by, "_bucket").agg(F.max_by("_v", F.struct("_t", "_tie")).alias("_v"))
    ends = ends.groupBy(*by).agg(F.collect_list(F.struct("_bucket", "_v")).alias("_ends"))
    carried = own.join(ends, by, "left")
    before = F.array_max(F.transform(F.filter("_ends", lambda e: e["_bucket"] < F.col("_bucket")), lambda e: e["_bucket"]))
    found = F.filter("_ends", lambda e: e["_bucket"] == before)[0]["_v"]
    return carried.withColumn("_version", F.coalesce("_version", F.when(F.col("_t").isNotNull() & before.isNotNull(), found))).select("_q.*", "_version")


def edges_in_force(edges: DataFrame, questions: DataFrame, key: str = "edge_id", time: str = "ts", tie: str | None = None, expires: str | None = None, removed: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The questions' columns (source_id, as_of and others) with the edge columns of each edge of their source in force then.

    A version holds from its time to that of its key's next version, or until it expires; so questions meet only the
    versions of their source, and only what is in force then leaves the join. Sources of over HUB_ROWS versions or
    questions are joined by source and time bucket, a version being in each bucket in which it holds.
    """
    spark, e = edges.sparkSession, edges.drop("component_id")
    names = [c for c in e.columns if c != "source_id"]
    # made once: both are read several times
    e = written(e.where(f"source_id is not null and `{key}` is not null and `{time}` is not null"), "versions")
    q = written(questions.where("source_id is not null and as_of is not null"), "questions")
    kind = e.schema[time].dataType
    v = e.select("source_id", F.struct(*names).alias("_v"))
    many = e.select("source_id", F.lit(1).alias("_e"), F.lit(0).alias("_q")).unionAll(q.select("source_id", F.lit(0), F.lit(1))).groupBy("source_id").agg(F.sum("_e").alias("_e"), F.sum("_q").alias("_q"))
    hubs = written(many.where((F.greatest("_e", "_q") > HUB_ROWS) & (F.least("_e", "_q") > 0)).select("source_id"), "hubs")
    some = buckets > 1 and not hubs.isEmpty()
    until = lambda following: F.least(following, *([F.col(f"_v.{expires}").cast(kind)] if expires else []))
    at, order = F.col(f"_v.{time}"), [F.col(f"_v.{time}"), F.col(f"_v.{tie or key}")]
    left = ["_v", "_end"]

    def holding(held: DataFrame, asked: DataFrame, by: list[str]) -> DataFrame:
        t = F.col("as_of").cast(kind)
        held = held.where(~F.coalesce(F.col(f"_v.{removed}"), F.lit(False))) if removed else held
        found = asked.join(held.hint("merge"), by).where((t >= at) & (F.col("_end").isNull() | (t < F.col("_end"))))
        return found.select(*questions.columns, *(F.col(f"_v.{c}").alias(c) for c in names if c not in questions.columns))

    def timed(x: DataFrame) -> DataFrame:
        return x.withColumn("_end", until(F.lead(at).over(Window.partitionBy("source_id", F.col(f"_v.{key}")).orderBy(*order)))).where(F.col("_end").isNull() | (F.col("_end") > at))

    dealt = lambda x: x.repartition("source_id")  # noqa: E731 (the window and the join share this exchange)
    if not some:
        return holding(timed(dealt(v)), dealt(q), ["source_id"])
    out = holding(timed(dealt(v.join(hubs, "source_id", "left_anti"))), dealt(q.join(hubs, "source_id", "left_anti")), ["source_id"])
    # of hubs: the next version is in the bucket, or the first of the key's next bucket that has one
    bounds = _bounds(e, time, buckets)
    own = v.join(hubs, "source_id").withColumn("_key", F.col(f"_v.{key}")).withColumn("_bucket", _place(bounds, at, kind))
    first = own.groupBy("source_id", "_key", "_bucket").agg(F.min(at).alias("_first"))
    first = first.withColumn("_after", F.lead("_first").over(Window.partitionBy("source_id", "_key").orderBy("_bucket"))).drop("_first")
    follows = own.withColumn("_next", F.lead(at).over(Window.partitionBy("source_id", "_key", "_bucket").orderBy(*order)))
    ends = follows.join(first, ["source_id", "_key", "_bucket"]).withColumn("_end", until(F.coalesce("_next", "_after"))).where(F.col("_end").isNull() | (F.col("_end") > at))
    last = F.when(F.col("_end").isNull(), len(bounds)).otherwise(_place(bounds, F.col("_end"), kind))
    spread = ends.withColumn("_in", F.explode(F.sequence("_bucket", last))).select("source_id", F.col("_in").alias("_bucket"), *left)
    asked = q.join(hubs, "source_id").withColumn("_bucket", _place(bounds, F.col("as_of").cast(kind), kind))
    return out.unionByName(holding(spread, asked, ["source_id", "_bucket"]))


def live_edges(edges: DataFrame, pairs: DataFrame, key: str = "edge_id", time: str = "ts", tie: str | None = None, expires: str | None = None, removed: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(as_of, edge columns): the version in force of each edge of every distinct (source_id, as_of).

    ``key`` names an edge among its source's, ``tie`` orders versions of one time (the larger counts; by default the
    key). A version has expired from ``expires`` on; where ``removed`` holds it ends its edge.
    """
    found = edges_in_force(edges, pairs.select("source_id", "as_of").distinct(), key, time, tie, expires, removed, buckets)
    return found.select("as_of", *edges.drop("component_id").columns)

import random
from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from weft.graph import PropertyGraph
from weft.plans import asof
from weft.plans.asof import last_before, live_edges
from weft.plans.positions import draw, position_index
from weft.plans.sample import sample_edges
from weft.plans.spec import UNIFORM, SpecBuilder


def hub_graph(spark, parts):
    rows = [(0, i, 1, 10_000 + i) for i in range(600)] + [(0, 1000 + i, 2 + i % 5, i) for i in range(23)]
    e = spark.createDataFrame(rows, "component_id long, edge_id long, source_id long, target_id long").repartition(parts)
    nodes = e.select(F.explode(F.array("source_id", "target_id")).alias("node_id")).distinct()
    return PropertyGraph.of({"n": nodes}, {"e": (e, "n", "n")})


def test_drawn_positions(spark):
    """Every draw has min(k, degree) edges of its source without repeats, is the same under any partitioning, and is uniform."""
    found = []
    for parts in (1, 5):
        g = hub_graph(spark, parts)
        index = position_index(g.edges["e"].table)
        at = index.edges.groupBy("source_id").agg(F.sort_array(F.collect_list("_at")).alias("at")).collect()
        assert all(r["at"] == list(range(len(r["at"]))) for r in at) and len(at) == 6
        seeds = spark.range(400).select(F.col("id").alias("sample_id"), (F.col("id") % 7).alias("node_id")).repartition(parts)
        spec = SpecBuilder(g.schema()).seed("n").sample("e", 4, UNIFORM, "hop").build()
        found.append(sorted((r.sample_id, r.edge_id) for r in sample_edges(g, spec, seeds, 3, index={"e": index})["e"].collect()))
    assert found[0] == found[1] and len(found[0]) == len(set(found[0]))
    degree = {1: 600, 2: 5, 3: 5, 4: 5, 5: 4, 6: 4, 0: 0}
    assert Counter(s for s, _ in found[0]) == {s: min(4, degree[s % 7]) for s in range(400) if s % 7}
    many = spark.range(6000).select(F.col("id").alias("sample_id"), F.lit(2).alias("node_id"))
    n = Counter(r.edge_id for r in draw(many, index, 2, 0, "hop").collect())
    assert len(n) == 5 and all(2200 < x < 2600 for x in n.values())


def test_hub_edges_are_joined_once_a_draw(spark):
    """The plan has no window, and the edges come in by source and position."""
    g = hub_graph(spark, 3)
    index = position_index(g.edges["e"].table)
    seeds = spark.range(300).select(F.col("id").alias("sample_id"), F.lit(1).cast("long").alias("node_id"))
    out = draw(seeds, index, 3, 0, "hop", False)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "_at" in plan.split("Join")[1] and out.count() == 900


def test_last_version_before(spark):
    """Against a scan: several buckets, keys without versions, ties, nulls, and a key of most rows."""
    rng = random.Random(8)
    at = lambda n: datetime(2024, 1, 1) + timedelta(minutes=n)
    versions = [(rng.choice(["a"] * 8 + ["b", "c"]), at(rng.randint(0, 300)), i, f"v{i}") for i in range(250)] + [(None, at(5), 900, "x"), ("a", None, 901, "y")]
    queries = [(i, rng.choice(["a", "a", "b", "c", "none", None]), at(rng.randint(-20, 320)) if i % 40 else None) for i in range(200)]
    v = spark.createDataFrame(versions, "k string, ts timestamp, no long, name string").repartition(3)
    q = spark.createDataFrame(queries, "id long, k string, as_of timestamp").repartition(2)
    want = {}
    for i, k, t in queries:
        some = [(x[1], x[2], x[3]) for x in versions if k and t and x[0] == k and x[1] and x[1] <= t]
        want[i] = max(some)[2] if some else None
    for buckets in (1, 4, 64):
        got = {r.id: r._version and r._version.name for r in last_before(q, v, ["k"], "as_of", "ts", "no", buckets).collect()}
        assert got == want
    numbers = last_before(spark.createDataFrame([(1, 5), (1, 0)], "k long, t long"), spark.createDataFrame([(1, 3, 1), (1, 5, 2), (1, 5, 1)], "k long, s long, no long"), ["k"], "t", "s", "no", 8)
    assert {r.t: r._version and r._version.no for r in numbers.collect()} == {5: 2, 0: None}


def test_live_edges_leave_out_what_is_over(spark):
    rows = [(1, 7, 10, 1, 20, False), (1, 7, 15, 2, None, False), (1, 8, 10, 1, 20, False), (1, 9, 10, 1, None, False), (1, 9, 18, 2, None, True), (2, 7, 10, 1, 12, False)]
    e = spark.createDataFrame(rows, "source_id long, edge_id long, ts long, no long, until long, gone boolean")
    pairs = spark.createDataFrame([(1, 9), (1, 12), (1, 19), (1, 25), (2, 12), (3, 12), (1, 12)], "source_id long, as_of long")
    got = sorted((r.source_id, r.as_of, r.edge_id, r.no) for r in live_edges(e, pairs, tie="no", expires="until", removed="gone").collect())
    assert got == [(1, 12, 7, 1), (1, 12, 8, 1), (1, 12, 9, 1), (1, 19, 7, 2), (1, 19, 8, 1), (1, 25, 7, 2)]


def _plain_live(versions, questions):
    """Every question with the versions in force by a scan: the last of each key, not over and not a removal."""
    out = []
    for i, s, t in questions:
        last = {}
        for v in sorted((v for v in versions if v[0] == s and v[1] is not None and v[2] is not None and t is not None and v[2] <= t), key=lambda v: (v[2], v[3])):
            last[v[1]] = v
        out += [(i, v[3]) for v in last.values() if not v[5] and (v[4] is None or v[4] > t)]
    return sorted(out)


def test_live_edges_of_hubs(spark, monkeypatch):
    """Hubs dealt over buckets give what one pass gives: ties, removals, expiry at once and never, nulls."""
    rng = random.Random(4)
    versions = [(rng.choice([1, 1, 1, 2, 3]), rng.choice([7, 8, 9, None]), rng.choice([None, *range(60)]), i, rng.choice([None, rng.randint(0, 70)]), rng.choice([None, False, False, True])) for i in range(260)]
    questions = [(i, rng.choice([1, 1, 2, 4, None]), rng.choice([None, *range(-3, 66)])) for i in range(120)]
    e = spark.createDataFrame(versions, "source_id long, edge_id long, ts long, no long, until long, gone boolean").repartition(3)
    q = spark.createDataFrame(questions, "id long, source_id long, as_of long")
    want = _plain_live(versions, questions)
    for rows, buckets in ((1_000_000, 64), (20, 8), (0, 64), (0, 1)):
        monkeypatch.setattr(asof, "HUB_ROWS", rows)
        got = asof.edges_in_force(e, q, tie="no", expires="until", removed="gone", buckets=buckets)
        assert sorted((r.id, r.no) for r in got.collect()) == want


def test_live_edges_leave_the_join_only(spark):
    """Questions aren't multiplied by the keys of their source before an exchange: what is shuffled are versions and questions."""
    e = spark.range(4000).select(F.lit(1).cast("long").alias("source_id"), F.col("id").alias("edge_id"), F.col("id").alias("ts"), (F.col("id") + 1).alias("until"))
    q = spark.range(400).select(F.lit(1).cast("long").alias("source_id"), (F.col("id") * 10).alias("as_of"))
    df = asof.edges_in_force(e, q, expires="until")
    assert df.count() == 400
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2

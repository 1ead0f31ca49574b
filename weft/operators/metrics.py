"""Losses, metrics, statistics and attribution arithmetic as aggregates."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.graph import PropertyGraph
from weft.operators.structure import written
from weft.schema import CONTEXT


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)


# ---------------------------------------------------------------- statistics


def basic_stats(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, min, max, mean) of scalar features."""
    one = df.agg(*(f(F.col(c).cast("double")).alias(f"{c}|{n}") for c in features for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), *(F.col(f"`{c}|{n}`").alias(n) for n in ("min", "max", "mean"))) for c in features))).alias("x")).select("x.*")


def graph_values(graph: PropertyGraph) -> DataFrame:
    """(key, value) of all numeric features, and ``#size`` of every set by component; keys are kind/set/feature."""
    out = None

    def add(df: DataFrame) -> None:
        nonlocal out
        out = df if out is None else out.unionByName(df)

    for kind, name, df in graph.iter_sets():
        at = f"{kind}/{name}/" if name else f"{kind}/"
        for f in graph.features(kind, name):
            t = df.schema[f].dataType.simpleString()
            if t in ("string", "boolean", "binary") or t.startswith(("struct", "map", "timestamp", "date")) or "string" in t:
                continue
            c = F.col(f)
            for _ in range(t.count("array<") - 1):
                c = F.flatten(c)
            own = df.select((F.explode(c) if t.startswith("array") else c).alias("value"))
            add(own.select(F.lit(at + f).alias("key"), F.col("value").cast("double").alias("value")))
        if kind != CONTEXT:
            n = graph.context().select("component_id").join(df.groupBy("component_id").agg(F.count("*").alias("n")), "component_id", "left")
            add(n.select(F.lit(at + "#size").alias("key"), F.coalesce("n", F.lit(0)).cast("double").alias("value")))
    return out


def exact_quantiles(values: DataFrame, at: Sequence[float]) -> DataFrame:
    """(key, quantiles) of (key, value), interpolated; null values don't count, and a key without others has null.

    Distinct values with their counts are sorted by range partitions; sums of the partitions before tell which hold
    the wanted places, and only in those are counts added up. So no task holds a key's values.
    """
    counts = values.groupBy("key", "value").agg(F.count("value").alias("_n"))
    placed = written(counts.repartitionByRange("key", "value").sortWithinPartitions("key", "value").withColumn("_part", F.spark_partition_id()), "values")
    ahead = Window.partitionBy("key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("key", "_part").agg(F.sum("_n").alias("_s")).withColumn("_before", F.coalesce(F.sum("_s").over(ahead), F.lit(0)))
    parts = written(sums, "parts")
    wanted = parts.groupBy("key").agg(F.sum("_s").alias("_all")).select("key", "_all", F.posexplode(F.array(*map(F.lit, at))).alias("_i", "_q")).where("_all > 0")
    wanted = wanted.select("key", "_i", ((F.col("_all") - 1) * F.col("_q")).alias("_p")).withColumn("_at", F.explode(F.array_distinct(F.array(F.floor("_p"), F.ceil("_p")))))
    there = parts.join(F.broadcast(wanted), "key").where("_at >= _before and _at < _before + _s")
    own = placed.where("_n > 0").join(F.broadcast(there.select("key", "_part", "_before").distinct()), ["key", "_part"])
    upto = Window.partitionBy("key", "_part").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = own.withColumn("_to", F.col("_before") + F.sum("_n").over(upto))
    found = own.join(F.broadcast(wanted), "key").where("_at < _to and _at >= _to - _n").groupBy("key", "_i").agg(F.max("_p").alias("_p"), F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    between = (F.ceil("_p") - F.col("_p")) * F.col("_lo") + (F.col("_p") - F.floor("_p")) * F.col("_hi")
    got = found.select("key", F.struct("_i", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(between).alias("v")).alias("x"))
    got = got.groupBy("key").agg(F.array_sort(F.collect_list("x"))["v"].alias("quantiles"))
    return parts.select("key").distinct().join(got, "key", "left")


def quantile_stats(graph: PropertyGraph, quantiles: int = 101, accuracy: int = 10_000, exact: bool = False) -> DataFrame:
    """(key, min, median, max, quantiles) of all features; an odd number of quantiles."""
    if quantiles % 2 == 0:
        raise ValueError("the number of quantiles must be odd")
    at = [i / (quantiles - 1) for i in range(quantiles)]
    values = graph_values(graph)
    out = exact_quantiles(values, at) if exact else values.groupBy("key").agg(F.percentile_approx("value", at, accuracy).alias("quantiles"))
    return out.select("key", F.col("quantiles")[0].alias("min"), F.col("quantiles")[quantiles // 2].alias("median"), F.col("quantiles")[quantiles - 1].alias("max"), "quantiles")


# ---------------------------------------------------------------- representations


def _products(batches: Iterator[pa.RecordBatch], width: int, centre: np.ndarray, unit: bool) -> Iterator[pa.RecordBatch]:
    """x^T y over a partition's rows, less the centres; x scaled to unit length first if asked for."""
    total, n = np.zeros((width, width)), 0
    for b in batches:
        x, y = (np.asarray(c.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, width) - m for c, m in zip(b.columns, centre, strict=True))
        if unit:
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            y = x
        total += x.T @ y
        n += len(x)
    if n:
        yield pa.RecordBatch.from_pydict({"n": [n], "m": [total.tobytes()]})


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = None, 0
    for b in batches:
        for k, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x = np.frombuffer(m)
            total, n = x if total is None else total + x, n + k
    if n:
        yield pa.RecordBatch.from_pydict({"n": [n], "m": [total.tobytes()]})


def _product(df: DataFrame, a: str, b: str, width: int, centre: np.ndarray | None = None, unit: bool = False) -> tuple[np.ndarray, int]:
    """The sum over rows of a^T b (width x width) and the number of rows: partial matrices, added in 16 tasks, then here."""
    whole = df.select(F.col(a).cast("array<double>").alias("a"), F.col(b).cast("array<double>").alias("b")).where("a is not null and b is not null")
    centre = np.zeros((2, width)) if centre is None else centre
    parts = whole.mapInArrow(partial(_products, width=width, centre=centre, unit=unit), "n long, m binary")
    out, n = np.zeros((width, width)), 0
    for r in parts.repartition(16).mapInArrow(_add, "n long, m binary").collect():
        out += np.frombuffer(r.m).reshape(width, width)
        n += r.n
    return out, n


def gram(df: DataFrame, col: str, width: int, unit: bool = False) -> tuple[np.ndarray, int]:
    """X^T X and the number of rows."""
    return _product(df, col, col, width, unit=unit)


def _most_leverage(batches: Iterator[pa.RecordBatch], width: int, basis: np.ndarray) -> Iterator[pa.RecordBatch]:
    top = 0.0
    for b in batches:
        x = np.asarray(b.column(0).flatten().to_numpy(zero_copy_only=False), float).reshape(-1, width)
        top = max(top, float(((x @ basis) ** 2).sum(1).max(initial=0)))
    yield pa.RecordBatch.from_pydict({"top": [top]})


def self_clustering(g: np.ndarray, n: int, eps: float = 1e-9) -> float:
    """From the gram matrix of rows of unit length: 1 if they have collapsed to a point (or all are zeros), about 0 if they're spread evenly."""
    d = g.shape[0]
    if not g.any():
        return 1.0
    expected = n + n * (n - 1) / d
    return (float((g * g).sum()) - expected) / max(n * n - expected, eps)


def _stacked(rows: Iterator[np.ndarray], width: int) -> np.ndarray:
    """The R factor of all rows."""
    r = np.zeros((0, width))
    for x in rows:
        r = np.linalg.qr(np.vstack([r, x]), mode="r")
    return r


def _factor(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """A task's R factor, of rows or of other tasks' factors."""
    r = _stacked((np.asarray(b.column(0).slice(i, ROWS).flatten().to_numpy(zero_copy_only=False), float).reshape(-1, width) for b in batches for i in range(0, b.num_rows, ROWS)), width)
    yield pa.RecordBatch.from_arrays([pa.array(list(r), pa.list_(pa.float64()))], ["x"])


#: Rows that are factored together, and factors that meet in a task.
ROWS, FAN = 4096, 16


def triangle(df: DataFrame, col: str, width: int) -> np.ndarray:
    """R of X = Q R by a tree of QR factors over tasks: of at most ``width`` rows, with X's singular values and right vectors."""
    rows = df.select(F.col(col).cast("array<double>").alias("x")).where("x is not null")
    parts = rows.rdd.getNumPartitions()
    r = rows.mapInArrow(partial(_factor, width=width), "x array<double>")
    while parts > FAN:
        parts = -(-parts // FAN)
        r = r.repartition(parts).mapInArrow(partial(_factor, width=width), "x array<double>")
    # FAN factors of width rows at most
    return _stacked((np.array([list(x.x)]) for x in r.collect()), width)


def svd_metrics(df: DataFrame, col: str, width: int) -> dict[str, float]:
    """pseudo_condition_number, numerical_rank, rankme, coherence and self_clustering of the matrix of all rows.

    Singular values are those of the R factor, min(rows, width) of them; squaring the matrix would lose the small ones.
    The condition number of a matrix that lacks rank is infinite, of one without rows or of zeros 0.
    """
    g, n = gram(df, col, width, unit=True)
    r = triangle(df, col, width)
    _, s, v = np.linalg.svd(r, full_matrices=False)
    s, v = s[: min(n, width)], v[: min(n, width)]
    top, low = (float(s[0]), float(s[-1])) if len(s) else (0.0, 0.0)
    p = s / max(s.sum(), 1e-300) + 1e-12
    keep = s > top * np.finfo(float).eps * max(n, width)
    basis = v[keep].T / s[keep]
    rows = df.select(F.col(col).cast("array<double>").alias("x")).where("x is not null")
    most = rows.mapInArrow(partial(_most_leverage, width=width, basis=basis), "top double").agg(F.max("top").alias("m")).first().m or 0.0
    return {
        "pseudo_condition_number": top / low if low > 0 else math.inf if top else 0.0,
        "numerical_rank": float((s * s).sum() / (top * top)) if top else 0.0,
        "rankme": float(math.exp(-(p * np.log(p)).sum())),
        "coherence": float(most) * n / max(1, min(n, width)),
        "self_clustering": self_clustering(g, n),
    }


def column_moments(df: DataFrame, cols: Sequence[str], width: int) -> dict[str, np.ndarray]:
    """Means and population variances of array columns' elements."""
    out = df.agg(*(f(F.col(c)[i].cast("double")).alias(f"{c}|{n}|{i}") for c in cols for n, f in (("mean", F.avg), ("var", F.var_pop)) for i in range(width))).first()
    return {f"{c}|{n}": np.array([out[f"{c}|{n}|{i}"] for i in range(width)], float) for c in cols for n in ("mean", "var")}


def centred_product(df: DataFrame, a: str, b: str, width: int, means: dict[str, np.ndarray]) -> np.ndarray:
    """Sum over rows of (a - mean a)^T (b - mean b)."""
    return _product(df, a, b, width, np.array([means[f"{a}|mean"], means[f"{b}|mean"]]))[0]


def vicreg_loss(df: DataFrame, a: str, b: str, width: int, sim: float = 25.0, var: float = 25.0, cov: float = 1.0, eps: float = 1e-4) -> float:
    """Weighted sum of mean squared difference, hinge of standard deviations below 1, and off-diagonal covariance."""
    m = column_moments(df, [a, b], width)
    head = df.agg(F.avg(squared_distance(a, b)).alias("d"), F.count("*").alias("n")).first()
    loss = sim * head.d / width
    for c in (a, b):
        loss += var * float(np.maximum(0, 1 - np.sqrt(m[f"{c}|var"] + eps)).mean())
        k = centred_product(df, c, c, width, m) / max(1, head.n - 1)
        loss += cov * float((k * k).sum() - (np.diag(k) ** 2).sum()) / width
    return loss


def barlow_twins_loss(df: DataFrame, a: str, b: str, width: int, lambd: float | None = None, eps: float = 1e-12) -> float:
    """Squared distance of the views' cross-correlation from the identity; off-diagonal terms weigh lambd (1 / width)."""
    m = column_moments(df, [a, b], width)
    n = df.count()
    c = centred_product(df, a, b, width, m) / n / np.sqrt(np.outer(m[f"{a}|var"] + eps, m[f"{b}|var"] + eps))
    lambd = 1 / width if lambd is None else lambd
    off = c * c
    np.fill_diagonal(off, 0)
    return float(((1 - np.diag(c)) ** 2).sum() + lambd * off.sum())


def triplet_loss(df: DataFrame, positive: str, negative: str, margin: float = 1.0) -> DataFrame:
    """One row: triplet_loss (a sum of hinges), and means of both distances and of their difference."""
    p, n = F.col(positive), F.col(negative)
    return df.agg(F.sum(F.greatest(p - n + margin, F.lit(0.0))).alias("triplet_loss"), F.avg(p).alias("positive"), F.avg(n).alias("negative"), F.avg(n - p).alias("difference"))


def triplet_distances(df: DataFrame, anchor: str, positive: str, negative: str, width: int) -> DataFrame:
    """Mean squared distances (by element) to the positive and the negative."""
    return df.withColumns({"d_positive": squared_distance(anchor, positive) / width, "d_negative": squared_distance(anchor, negative) / width})


def infomax_logits(df: DataFrame, col: str, weights: Sequence[Sequence[float]], width: int) -> DataFrame:
    """x W s, with s the sigmoid of the mean row; weights are given."""
    mean = df.agg(*(F.avg(F.col(col)[i].cast("double")).alias(str(i)) for i in range(width))).first()
    s = 1 / (1 + np.exp(-np.array([mean[str(i)] for i in range(width)])))
    v = np.asarray(weights) @ s
    return df.withColumn("logit", sum((F.col(col)[i].cast("double") * float(v[i]) for i in range(width)), F.lit(0.0)))


# ---------------------------------------------------------------- predictions

#: Pieces of a precision-recall curve that are summed apart.
CELLS = 4096


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def binary_metrics(df: DataFrame, label: str, logit: str, threshold: float = 0.5, at_precision: float = 0.8) -> DataFrame:
    """One row: accuracy, precision, recall, recall_at_precision, auc_roc, auc_pr and cross-entropy, from logits."""
    own = df.select((F.col(label) > 0).cast("long").alias("y"), F.col(logit).cast("double").alias("z"))
    yes = (sigmoid(F.col("z")) > threshold).cast("long")
    ce = F.greatest(F.col("z"), F.lit(0.0)) - F.col("z") * F.col("y") + F.log1p(F.exp(-F.abs("z")))
    tp, fp, fn = (F.sum(a * b) for a, b in ((F.col("y"), yes), (1 - F.col("y"), yes), (F.col("y"), 1 - yes)))
    head = own.agg(F.avg((F.col("y") == yes).cast("double")).alias("accuracy"), F.coalesce(tp / (tp + fp), F.lit(0.0)).alias("precision"), F.coalesce(tp / (tp + fn), F.lit(0.0)).alias("recall"), F.avg(ce).alias("cross_entropy"))
    # distinct logits are aggregated before the only ordered scan
    steps = own.groupBy("z").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    # running sums over cells of the sigmoid, after the sums of the cells before
    steps = steps.withColumn("cell", F.floor(sigmoid(F.col("z")) * CELLS))
    above = Window.orderBy(F.col("cell").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sums = steps.groupBy("cell").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    sums = sums.select("cell", F.coalesce(F.sum("_p").over(above), F.lit(0)).alias("_p"), F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_n"))
    w = Window.partitionBy("cell").orderBy(F.col("z").desc()).rowsBetween(Window.unboundedPreceding, 0)
    curve = steps.join(F.broadcast(sums), "cell").select("p", "n", (F.sum("p").over(w) + F.col("_p")).alias("tp"), (F.sum("n").over(w) + F.col("_n")).alias("fp"))
    total = own.agg(F.sum("y").alias("yes"), F.sum(1 - F.col("y")).alias("no"))
    area = (
        curve.crossJoin(F.broadcast(total))
        .agg(
            (F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2)) / F.first("yes") / F.first("no")).alias("auc_roc"),
            (F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.first("yes")).alias("auc_pr"),
            F.coalesce(F.max(F.when(F.col("tp") / (F.col("tp") + F.col("fp")) >= at_precision, F.col("tp") / F.col("yes"))), F.lit(0.0)).alias("recall_at_precision"),
        )
    )
    return head.crossJoin(area)


def multiclass_metrics(df: DataFrame, label: str, logits: str) -> tuple[DataFrame, DataFrame]:
    """(accuracy and cross-entropy in one row, precision and recall by class); the first largest logit is the prediction."""
    top = F.array_max(logits)
    own = df.select(F.col(label).cast("long").alias("_y"), (F.array_position(logits, top) - 1).alias("_p"), (F.col(logits)[F.col(label).cast("int")].cast("double")).alias("_z"), top.cast("double").alias("_m"), F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x.cast("double") - top)).alias("_e"))
    head = own.agg(F.avg((F.col("_y") == F.col("_p")).cast("double")).alias("accuracy"), F.avg(F.log("_e") + F.col("_m") - F.col("_z")).alias("cross_entropy"))
    return head, per_class(own, "_y", "_p")


def per_class(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(class, precision, recall): 0 where nothing is predicted or there is nothing to find."""
    hit = (F.col(label) == F.col(prediction)).cast("long")
    by_p = df.groupBy(F.col(prediction).cast("long").alias("class")).agg(F.sum(hit).alias("tp"), F.count("*").alias("said"))
    by_y = df.groupBy(F.col(label).cast("long").alias("class")).agg(F.count("*").alias("there"))
    out = by_y.join(by_p, "class", "full")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select("class", zero(F.col("tp") / F.col("said")).cast("double").alias("precision"), zero(zero(F.col("tp")) / F.col("there")).cast("double").alias("recall"))


def regression_losses(df: DataFrame, label: str, prediction: str, alpha: float = 1.0, eps: float = 1.0) -> DataFrame:
    """One row: mae, mape (percent), mse, msle, and mse_log_scaled = mse + alpha * squared difference of log(eps + value)."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    relu = lambda x: F.greatest(x, F.lit(0.0))
    log = lambda x: F.log(relu(x) + eps)
    return df.agg(
        F.avg(F.abs(y - p)).alias("mae"),
        (F.avg(F.abs((y - p) / F.greatest(F.abs(y), F.lit(1e-7)))) * 100).alias("mape"),
        F.avg((y - p) * (y - p)).alias("mse"),
        F.avg(F.pow(F.log1p(relu(y)) - F.log1p(relu(p)), F.lit(2))).alias("msle"),
        F.avg((y - relu(p)) * (y - relu(p)) + alpha * F.pow(log(y) - log(p), F.lit(2))).alias("mse_log_scaled"),
    )


def link_scores(graph: PropertyGraph, feature: str, weights: Sequence[float] | None = None) -> DataFrame:
    """Score of each readout node's link: the dot product of both ends' features, or of their product with weights."""
    from weft.operators.readout import structured_readout

    a = structured_readout(graph, "source", feature, "a")
    b = structured_readout(graph, "target", feature, "b")
    both = a.join(b, ["component_id", "node_id"])
    if weights is None:
        return both.select("component_id", "node_id", dot("a", "b").alias("score"))
    return both.select("component_id", "node_id", sum((F.col("a")[i] * F.col("b")[i] * float(w) for i, w in enumerate(weights)), F.lit(0.0)).alias("score"))


# ---------------------------------------------------------------- attribution


def combine_features(a: DataFrame, b: DataFrame, keys: Sequence[str], features: Sequence[str], way: str = "subtract") -> DataFrame:
    """Feature by feature a - b or a + b of tables with the same items."""
    b = b.select(*keys, *(F.col(f).alias(f"_{f}") for f in features))
    joined = a.join(b, list(keys))
    op = (lambda x, y: x - y) if way == "subtract" else (lambda x, y: x + y)
    return joined.select(*keys, *(op(F.col(f), F.col(f"_{f}")).alias(f) for f in features))


def sum_features(tables: Sequence[DataFrame], keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Feature-wise sum over many tables of the same items."""
    out = tables[0].select(*keys, *features)
    for t in tables[1:]:
        out = out.unionByName(t.select(*keys, *features))
    return out.groupBy(*keys).agg(*(F.sum(f).alias(f) for f in features))


def interpolate_features(baseline: DataFrame, df: DataFrame, keys: Sequence[str], features: Sequence[str], steps: int) -> DataFrame:
    """baseline + k / (steps - 1) * (df - baseline) for k = 0 .. steps - 1, both ends among them."""
    if steps < 2:
        raise ValueError("two steps at least")
    b = baseline.select(*keys, *(F.col(f).alias(f"_{f}") for f in features))
    each = df.join(b, list(keys)).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    return each.select(*keys, "step", *((F.col(f"_{f}") + (F.col(f) - F.col(f"_{f}")) * F.col("step") / (steps - 1)).alias(f) for f in features))


def counterfactual(df: DataFrame, features: Sequence[str], random: bool = False, seed: int = 0, keys: Sequence[str] = ("component_id", "node_id")) -> DataFrame:
    """Features replaced by 0, or by draws that are uniform between the feature's least and largest value."""
    if not random:
        return df.withColumns({f: F.lit(0).cast(df.schema[f].dataType) for f in features})
    from weft.operators.structure import keyed_random

    ends = df.agg(*(F.struct(F.min(f).alias("lo"), F.max(f).alias("hi")).alias(f"_{f}") for f in features))
    u = lambda f: F.conv(F.substring(keyed_random(seed, F.lit(f), *keys), 1, 12), 16, 10).cast("double") / 2.0**48
    out = df.crossJoin(F.broadcast(ends))
    return out.withColumns({f: (F.col(f"_{f}.lo") + (F.col(f"_{f}.hi") - F.col(f"_{f}.lo")) * u(f)).cast(df.schema[f].dataType) for f in features}).drop(*(f"_{f}" for f in features))


def integrated_gradients_linear(df: DataFrame, baseline: DataFrame, keys: Sequence[str], weights: dict[str, float]) -> DataFrame:
    """Attributions of a linear model, for which the path integral is weight * (value - baseline)."""
    diff = combine_features(df, baseline, keys, list(weights))
    return diff.select(*keys, *((F.col(f) * w).alias(f) for f, w in weights.items()))


# ---------------------------------------------------------------- contrastive tasks


@dataclass(frozen=True)
class Corruption:
    """Shares of items whose features are shuffled: (kind, set) -> rate, or -> {feature: rate}; ``default`` for the others.

    "*" stands for any set of a kind, and among features for those that aren't named. The context's set is "".
    """

    rates: dict[tuple[str, str], float | dict[str, float]] = field(default_factory=dict)
    default: float = 1.0

    def rate(self, kind: str, name: str, feature: str) -> float:
        found = self.rates.get((kind, name), self.rates.get((kind, "*"), self.default))
        return found.get(feature, found.get("*", self.default)) if isinstance(found, dict) else found


def corrupt(graph: PropertyGraph, spec: Corruption, seed: int = 0) -> PropertyGraph:
    """Every feature of every set that isn't auxiliary, of edges and the context too, shuffled over the set's items at its rate."""
    from weft.operators.structure import shuffle_features

    out = graph
    for kind, name, _ in graph.iter_sets(aux=False):
        by: dict[float, list[str]] = {}
        for f in graph.features(kind, name):
            by.setdefault(spec.rate(kind, name, f), []).append(f)
        for rate, own in by.items():
            if rate > 0:
                out = shuffle_features(out, kind, name, own, seed, rate)
    return out


def infomax_loss(clean: DataFrame, corrupted: DataFrame, col: str, weights: Sequence[Sequence[float]], width: int) -> DataFrame:
    """One row: the cross-entropy of telling clean rows from corrupted ones, both against the clean mean."""
    both = clean.select(col, F.lit(1.0).alias("y")).unionByName(corrupted.select(col, F.lit(0.0).alias("y")))
    mean = clean.agg(*(F.avg(F.col(col)[i].cast("double")).alias(str(i)) for i in range(width))).first()
    v = np.asarray(weights) @ (1 / (1 + np.exp(-np.array([mean[str(i)] for i in range(width)]))))
    z = sum((F.col(col)[i].cast("double") * float(v[i]) for i in range(width)), F.lit(0.0))
    return both.select(z.alias("z"), "y").agg(F.avg(F.greatest(F.col("z"), F.lit(0.0)) - F.col("z") * F.col("y") + F.log1p(F.exp(-F.abs("z")))).alias("loss"))


#: Losses of pairs of views, by name: fn(table, first view, second view, width) -> value.
CONTRASTIVE = {"vicreg": vicreg_loss, "barlow_twins": barlow_twins_loss}

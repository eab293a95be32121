"""Graph-level features: neighbour aggregation, pooling, fusion, and a weighted classifier."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _vector(column: str) -> Column:
    return array_to_vector(F.col(column).cast("array<double>"))


def _pooled(rows: DataFrame, keys: list[str], column: str, **metrics: tuple[str, Column | None]) -> DataFrame:
    """keys, dim and a column for each metric (its name in Summarizer, and weights or none) of the vectors of a group, all of one length.

    Vectors are summed up whole, before the shuffle and after: what is shuffled is one row for a group and task, however many dimensions there are.
    """
    own = rows.where(F.col(column).isNotNull()).withColumn("_vector", _vector(column))
    made = [getattr(Summarizer, m)(F.col("_vector"), *([w] if w is not None else [])).alias(name) for name, (m, w) in metrics.items()]
    whole = own.groupBy(*keys).agg(*made)
    each = whole.select(*keys, F.posexplode(F.arrays_zip(*[vector_to_array(n).alias(n) for n in metrics])).alias("dim", "v"))
    return each.select(*keys, "dim", *[F.col(f"v.{n}").alias(n) for n in metrics])


def neighbour_aggregate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """contract_id, node, dim, value: sum of neighbours' features over sqrt(deg_src * deg_dst), with self loops.

    Degrees count incoming edges and the loop. nodes are (contract_id, node, features), edges (contract_id, src, dst).
    """
    loops = nodes.select("contract_id", F.col("node").alias("src"), F.col("node").alias("dst"))
    every = edges.select("contract_id", "src", "dst").unionByName(loops)
    degree = every.groupBy("contract_id", "dst").agg(F.count(F.lit(1)).alias("deg"))
    source = nodes.join(degree.withColumnRenamed("dst", "node"), ["contract_id", "node"])
    sent = source.select("contract_id", F.col("node").alias("src"), F.col("deg").alias("src_deg"), "features")
    joined = every.join(sent, ["contract_id", "src"]).join(degree, ["contract_id", "dst"])
    scaled = joined.select("contract_id", F.col("dst").alias("node"), "features", (1 / F.sqrt(F.col("src_deg") * F.col("deg"))).alias("w"))
    return _pooled(scaled, ["contract_id", "node"], "features", value=("sum", F.col("w")))


def graph_pool(nodes: DataFrame) -> DataFrame:
    """contract_id, dim, mean, max of the node vectors."""
    return _pooled(nodes, ["contract_id"], "features", mean=("mean", None), max=("max", None))


def path_pool(paths: DataFrame, index: DataFrame, dims: int) -> DataFrame:
    """contract_id, dim, attention, mean, max of the path vectors; zeros for a contract without paths.

    paths are (contract_id, length, score, features); paths of length 0 are skipped. The softmax of the scores is taken
    in two steps, largest score first, so it is stable and its sums are partial aggregates.
    """
    used = paths.where(F.col("length") > 0)
    top = used.groupBy("contract_id").agg(F.max("score").alias("top"))
    weighted = used.join(top, "contract_id").select("contract_id", F.exp(F.col("score") - F.col("top")).alias("w"), "features")
    pooled = _pooled(weighted, ["contract_id"], "features", attention=("mean", F.col("w")), mean=("mean", None), max=("max", None))
    every = index.select("contract_id", F.explode(F.sequence(F.lit(0), F.lit(dims - 1))).alias("dim"))
    return every.join(pooled, ["contract_id", "dim"], "left").select("contract_id", "dim", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("attention", "mean", "max")])


def gated_fusion(both: Column, weights: list[list[float]], bias: list[float]) -> Column:
    """The concatenated vector times a sigmoid gate of it, by given weights."""
    gates = F.array(*[F.struct(F.array(*map(F.lit, map(float, w))).alias("w"), F.lit(float(b)).alias("b")) for w, b in zip(weights, bias, strict=True)])

    def gate(g: Column) -> Column:
        z = F.aggregate(F.zip_with(g["w"], both, lambda a, x: a * x), g["b"], lambda s, v: s + v)
        return 1 / (1 + F.exp(-z))

    return F.zip_with(F.transform(gates, gate), both, lambda g, x: g * x)


@dataclass(frozen=True)
class Classifier:
    """A fitted logistic regression: weights, intercept, and how many steps the fit took."""

    weights: np.ndarray
    intercept: float
    steps: int


#: Strength of the penalty on weights, most steps of a fit, and the largest change of a weight that ends it.
PENALTY, STEPS, SMALL = 0.01, 30, 1e-9


def _slopes(rows: DataFrame, at: np.ndarray, weight: dict[int, float]) -> tuple[np.ndarray, np.ndarray, float]:
    """Gradient and Hessian of the weighted log loss at some coefficients (the intercept last), and the loss: sums over all rows.

    A task adds up its rows and gives one row of sums; these are added by dimension, so the driver gets as many numbers as there are coefficients squared.
    """
    d = len(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d * d + d + 1)
        for batch in batches:
            if not len(batch):
                continue
            x = np.ones((len(batch), d))
            x[:, :-1] = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), d - 1)
            y = batch.column("y").to_numpy(zero_copy_only=False)
            w, z = np.where(y == 1, weight[1], weight[0]), x @ at
            p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            total[: d * d] += ((x * (w * p * (1 - p))[:, None]).T @ x).ravel()
            total[d * d : -1] += x.T @ (w * (p - y))
            total[-1] += (w * (np.logaddexp(0, z) - y * z)).sum()
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], type=pa.list_(pa.float64()))], names=["sums"])

    parts = rows.mapInArrow(run, "sums array<double>")
    sums = np.array(parts.select(Summarizer.sum(array_to_vector("sums")).alias("s")).first().s.toArray())
    return sums[d * d : -1], sums[: d * d].reshape(d, d), float(sums[-1])


def train_classifier(rows: DataFrame, features: str = "features") -> Classifier:
    """A logistic regression on contract vectors, each class weighted by total / (2 n).

    It minimises the mean weighted log loss plus PENALTY / 2 times the squared weights (the intercept is free), by Newton steps whose sums are
    aggregates over all rows: the minimum is unique, so anyone finds the same numbers. A step that would raise the loss is halved. Rows without a
    label of 0 or 1 or without a vector take no part; both classes must be there.
    """
    own = rows.where(F.col("label").isin(0, 1) & F.col(features).isNotNull()).select(F.col(features).cast("array<double>").alias("x"), F.col("label").cast("int").alias("y"))
    sizes = {r.y: (r.n, r.d) for r in own.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d")).collect()}
    if set(sizes) != {0, 1}:
        raise ValueError("both classes are needed to fit")
    total, dims = sum(n for n, _ in sizes.values()), max(d for _, d in sizes.values())
    weight = {y: total / (2 * n) for y, (n, _) in sizes.items()}
    penalty = np.append(np.full(dims, PENALTY), 0.0)
    at, step, size = np.zeros(dims + 1), None, 1.0
    best, steps = np.inf, 0
    for steps in range(1, STEPS + 1):
        point = at if step is None else at - size * step
        gradient, hessian, loss = _slopes(own, point, weight)
        loss = loss / total + (penalty * point**2).sum() / 2
        if loss > best + 1e-12:  # too far
            size /= 2
            continue
        at, best, size = point, loss, 1.0
        step = np.linalg.solve(hessian / total + np.diag(penalty), gradient / total + penalty * at)
        if np.abs(step).max() < SMALL:
            break
    return Classifier(at[:-1], float(at[-1]), steps)


def score(model: Classifier, rows: DataFrame, features: str = "features") -> DataFrame:
    """rows with prob, the probability of class 1; null without a vector."""
    weights = F.array(*[F.lit(float(w)) for w in model.weights])
    z = F.aggregate(F.zip_with(weights, F.col(features).cast("array<double>"), lambda w, x: w * x), F.lit(model.intercept), lambda s, v: s + v)
    return rows.withColumn("prob", 1 / (1 + F.exp(-z)))

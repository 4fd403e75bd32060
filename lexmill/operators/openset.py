"""Open-set scorers, calibration and reject rules over vectors and logits."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import vec
from lexmill.operators.sized import BROADCAST_BYTES, broadcast_if_small

EPSILON = 1e-12


def centroids(rows: DataFrame, label: str, vec_col: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean vector of each label, per group of ``keys``, scaled to length one: ``label``, ``n``, ``centroid``."""
    long = rows.select(*keys, label, F.posexplode(vec_col).alias("pos", "x")).groupBy(*keys, label, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    means = long.groupBy(*keys, label).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("v"))
    return means.select(*keys, label, "n", vec.unit(F.col("v")).alias("centroid"))


def with_logits(rows: DataFrame, centers: DataFrame, label: str, vec_col: str, scale: float = 1.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``names`` (labels in order) and ``logits``: scaled dot products with each centroid, of the row's own group of ``keys``.

    The centroids of a group travel as one row, so rows neither multiply nor move.
    """
    table = F.array_sort(F.collect_list(F.struct(F.col(label).alias("label"), F.col("centroid").alias("c"))))
    bank = broadcast_if_small(centers.groupBy(*keys).agg(table.alias("_bank")), most_bytes=BROADCAST_BYTES)
    joined = rows.join(bank, list(keys)) if keys else rows.crossJoin(bank)
    own = vec.doubles(F.col(vec_col))
    logits = F.transform("_bank", lambda b: vec.dot(own, b["c"]) * F.lit(float(scale)))
    return joined.withColumn("names", F.transform("_bank", lambda b: b["label"])).withColumn("logits", logits).drop("_bank")


def msp(logits: Column, temperature: float = 1.0) -> Column:
    """Negative largest probability; all scorers grow with strangeness."""
    return -F.array_max(vec.softmax(logits, temperature))


def max_logit(logits: Column) -> Column:
    return -F.array_max(logits)


def energy(logits: Column) -> Column:
    return -vec.logsumexp(logits)


def cross_entropy(logits: Column, target: Column, temperature: float = 1.0) -> Column:
    """Negative log-probability of class ``target`` (from 0)."""
    scaled = F.transform(logits, lambda z: z / F.lit(float(temperature)))
    return vec.logsumexp(scaled) - F.element_at(scaled, target + 1)


def group_cross_entropy(logits: Column, members: Column) -> Column:
    """Negative log-probability of a set of classes given as positions from 0: of a parent, by its children."""
    return vec.logsumexp(logits) - vec.logsumexp(F.transform(members, lambda i: F.element_at(logits, i + 1)))


def uniform_term(logits: Column) -> Column:
    """Loss of an outlier against the uniform distribution: least, and ln k, when all logits are equal."""
    return vec.logsumexp(logits) - F.aggregate(logits, F.lit(0.0), lambda s, x: s + x) / F.size(logits)


def nll_by_temperature(rows: DataFrame, logits: str, target: str, temperatures: list[float]) -> DataFrame:
    """Mean negative log-likelihood at each temperature, in one pass."""
    table = F.array(*[F.struct(F.lit(float(t)).alias("temperature"), cross_entropy(F.col(logits), F.col(target), t).alias("nll")) for t in temperatures])
    return rows.select(F.explode(table).alias("r")).groupBy("r.temperature").agg(F.avg("r.nll").alias("nll"))


def fit_temperature(rows: DataFrame, logits: str, target: str, lo: float = 0.05, hi: float = 20.0, rounds: int = 4, points: int = 15) -> tuple[float, float]:
    """Temperature with the least negative log-likelihood, by ever finer grids of its logarithm; also that likelihood."""
    a, b = math.log(lo), math.log(hi)
    best = (1.0, math.inf)
    for _ in range(rounds):
        grid = [math.exp(a + (b - a) * i / (points - 1)) for i in range(points)]
        found = nll_by_temperature(rows, logits, target, grid).orderBy("nll", "temperature").first()
        best = (found["temperature"], found["nll"])
        step, centre = (b - a) / (points - 1), math.log(best[0])
        a, b = centre - step, centre + step
    return best


def score_record(rows: DataFrame, tau: float, temperature: float = 1.0, unknown: str = "unknown") -> DataFrame:
    """Label, confidence, best known label and top three of each row of ``names`` and ``logits``; a confidence below ``tau`` is unknown."""
    probs = vec.softmax(F.col("logits"), temperature)
    made = rows.withColumn("probs", probs).withColumn("confidence", F.array_max("probs")).withColumn("best", F.element_at("names", vec.argmax(F.col("probs")) + 1).cast("string"))
    label = F.when(F.col("confidence") < tau, unknown).otherwise(F.col("best"))
    return made.withColumn("decision", label).withColumn("top3", vec.top_k(F.transform("names", lambda n: n.cast("string")), F.col("probs"), 3))


def pooled_shrunk_precision(rows: DataFrame, label: str, vec_col: str) -> tuple[dict[object, np.ndarray], np.ndarray, float]:
    """Class means, inverse of the pooled covariance shrunk towards a scaled identity, and the shrinkage.

    Sums of vectors and of outer products by label are d and d*d numbers a
    partition, so the driver sees a matrix, not rows. The shrinkage needs the
    mean fourth-order term as well, summed in a second pass.
    """

    def moments(batches):
        for pdf in batches:
            for name, part in pdf.groupby("label"):
                x = np.stack(part["v"].to_numpy()).astype(float)
                yield pd.DataFrame({"label": [name], "n": [len(x)], "s": [x.sum(axis=0).tolist()], "o": [(x.T @ x).ravel().tolist()]})

    base = rows.select(F.col(label).cast("string").alias("label"), vec.doubles(F.col(vec_col)).alias("v"))
    total: dict[str, list] = {}
    for r in base.mapInPandas(moments, "label string, n long, s array<double>, o array<double>").toLocalIterator():
        had = total.setdefault(r["label"], [0, 0.0, 0.0])
        had[0], had[1], had[2] = had[0] + r["n"], had[1] + np.array(r["s"]), had[2] + np.array(r["o"])
    n = sum(t[0] for t in total.values())
    means = {k: t[1] / t[0] for k, t in total.items()}
    d = len(next(iter(means.values())))
    pooled = sum(t[2].reshape(d, d) - t[0] * np.outer(means[k], means[k]) for k, t in total.items()) / n
    send = base.sparkSession.sparkContext.broadcast(means)

    def fourth(batches):
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["v"].to_numpy()).astype(float) - np.stack([send.value[k] for k in pdf["label"]])
                yield pd.DataFrame({"b": [float(((x * x).sum(axis=1) ** 2).sum())]})

    quartic = base.mapInPandas(fourth, "b double").agg(F.sum("b")).first()[0]
    mu = np.trace(pooled) / d
    spread = ((pooled - mu * np.eye(d)) ** 2).sum() / d
    noise = max(0.0, (quartic / n - (pooled**2).sum()) / n / d)
    shrink = 1.0 if spread == 0 else min(1.0, noise / spread)
    return means, np.linalg.inv((1 - shrink) * pooled + shrink * mu * np.eye(d) + EPSILON * np.eye(d)), shrink


def mahalanobis(rows: DataFrame, id_col: str, vec_col: str, means: dict[object, np.ndarray], precision: np.ndarray) -> DataFrame:
    """``id`` and ``distance``: the least squared distance to a class mean under the shared precision."""
    send = rows.sparkSession.sparkContext.broadcast((np.stack(list(means.values())), precision))

    def run(batches):
        centers, p = send.value
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["v"].to_numpy()).astype(float)
                gap = x[:, None, :] - centers[None, :, :]
                yield pd.DataFrame({"id": pdf["id"], "distance": np.einsum("nkd,de,nke->nk", gap, p, gap).min(axis=1)})

    return rows.select(F.col(id_col).cast("long").alias("id"), vec.doubles(F.col(vec_col)).alias("v")).mapInPandas(run, "id long, distance double")

"""Quality scores by positive-unlabelled learning.

Trusted positives and unlabelled web text train a small network on features of
the text alone. The share of positives among the unlabelled (the class prior) is
estimated first; training then minimises the non-negative unbiased risk

    prior * E_pos[loss(+)] + max(0, E_unl[loss(-)] - prior * E_pos[loss(-)])

and, where the part in max() falls below zero, takes a step against it. No
negative label is used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm._labels import drawn, fold, labels_of, texts_of
from lexmill.llm._words import hash_words, text_slices
from lexmill.sources.shared import bounded_batches

MOST_POSITIVES = 4000
MOST_UNLABELLED = 6000
MOST_BYTES = 50_000
HIDDEN = 24
EPOCHS = 60
BATCH = 256
RATE = 0.005
SEED = 29
CUT = 0.7
#: The prior is sought among regions that hold this share of the positives at least.
LEAST_SHARE = 0.3
LOWEST_PRIOR, HIGHEST_PRIOR = 0.05, 0.98

_LINE = ord("\n")
# Byte classes: letters below and above 127 are told apart, marks are counted one by one.
_UPPER, _LOWER, _DIGIT, _SPACE, _HIGH = range(5)
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_CLASS = np.full(256, _HIGH + 1 + len(_MARKS), dtype=np.int64)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[[9, 10, 11, 12, 13, 32]], _CLASS[128:] = _UPPER, _LOWER, _DIGIT, _SPACE, _HIGH
for _i, _m in enumerate(_MARKS):
    _CLASS[_m] = _HIGH + 1 + _i
_CLASSES = int(_CLASS.max()) + 1
N_FEATURES = _CLASSES + 8


def features(texts: pa.Array) -> np.ndarray:
    """Features of whole texts, one row each: shares of byte classes, repetition, word and line lengths."""
    bounds, (words,) = hash_words(texts)
    out = np.zeros((len(texts), N_FEATURES))
    for i, text in enumerate(texts):
        data = text.as_buffer() if text.is_valid else None
        if data is None or not data.size:
            continue
        b = np.frombuffer(data, dtype=np.uint8)
        counts = np.bincount(_CLASS[b], minlength=_CLASSES)
        mine = words[bounds[i] : bounds[i + 1]]
        n = max(1, len(mine))
        lines = bytes(data).split(b"\n")
        long_lines = [x for x in lines if len(x) > 2]
        pairs = mine[:-1] * np.uint64(3) + mine[1:]
        letters = counts[_UPPER] + counts[_LOWER] + counts[_HIGH]
        out[i, :_CLASSES] = np.sqrt(counts / len(b))
        out[i, _CLASSES:] = (
            np.log1p(n),
            len(b) / n,
            len(np.unique(mine)) / n,
            len(np.unique(pairs)) / max(1, len(pairs)),
            len(set(long_lines)) / max(1, len(long_lines)),
            np.log1p(n / len(lines)),
            counts[_UPPER] / max(1, letters),
            np.bincount(np.unique(mine, return_counts=True)[1]).argmax() if len(mine) else 0,
        )
    return out


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    prior: float = 0.5

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.raw(x))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def risk(sp: np.ndarray, su: np.ndarray, prior: float) -> tuple[float, float]:
    """Both parts of the unbiased risk under logistic loss: of positives, and of negatives, which may fall below zero."""
    minus = lambda s: -np.log(1 - s + 1e-9)
    return prior * float(-np.log(sp + 1e-9).mean()), float(minus(su).mean() - prior * minus(sp).mean())


def descent(sp: np.ndarray, su: np.ndarray, prior: float) -> np.ndarray:
    """Direction of a step by the logits of positives and unlabelled: the gradient of the risk, or, where the negative part is below zero, that which lifts it."""
    if risk(sp, su, prior)[1] >= 0:
        return np.concatenate((np.full(len(sp), -prior / len(sp)), su / len(su)))
    return np.concatenate((prior * sp / len(sp), -su / len(su)))


def _train(pos: np.ndarray, unl: np.ndarray, prior: float | None, seed: int) -> Network:
    """Minimise the non-negative risk; without a prior, tell positives from unlabelled."""
    rng = np.random.default_rng(seed)
    every = np.concatenate((pos, unl))
    d = every.shape[1]
    net = Network(every.mean(axis=0), every.std(axis=0) + 1e-6, rng.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.1, HIDDEN), np.zeros(1), prior or 0.5)
    params = [net.w1, net.b1, net.w2, net.b2]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    x = np.clip((every - net.mean) / net.scale, -6, 6)
    n_pos, steps = len(pos), max(1, len(unl) // BATCH)
    t = 0
    for epoch in range(EPOCHS):
        order_p, order_u = rng.permutation(n_pos), n_pos + rng.permutation(len(unl))
        for k in range(steps):
            p, u = order_p[k * n_pos // steps : (k + 1) * n_pos // steps], order_u[k * len(unl) // steps : (k + 1) * len(unl) // steps]
            if not len(p):
                p = order_p
            at = np.concatenate((p, u))
            hidden = np.tanh(x[at] @ net.w1 + net.b1)
            s = _sigmoid(hidden @ net.w2 + net.b2[0])
            sp, su = s[: len(p)], s[len(p) :]
            if prior is None:
                back = np.concatenate(((sp - 1) / len(p), su / len(u)))
            else:
                back = descent(sp, su, prior)
            into = back[:, None] * net.w2[None, :] * (1 - hidden * hidden)
            grads = [x[at].T @ into + 2e-3 * net.w1, into.sum(axis=0), hidden.T @ back + 2e-3 * net.w2, np.array([back.sum()])]
            t += 1
            rate = RATE * (1 - 0.9 * epoch / EPOCHS)
            for a, g, mm, vv in zip(params, grads, m, v, strict=True):
                mm += 0.1 * (g - mm)
                vv += 0.001 * (g * g - vv)
                a -= rate * (mm / (1 - 0.9**t)) / (np.sqrt(vv / (1 - 0.999**t)) + 1e-8)
    return net


def estimate_prior(pos_scores: np.ndarray, unl_scores: np.ndarray) -> float:
    """Share of positives among the unlabelled: the least ratio of both tails.

    Where only positives score, the unlabelled hold ``prior`` times the share
    that the positives hold, so the smallest ratio over the upper tails bounds
    the prior from above. Ratios carry one row's worth of slack.
    """
    cuts = np.quantile(pos_scores, np.linspace(0.02, 1 - LEAST_SHARE, 50))
    p = np.array([(pos_scores >= c).mean() for c in cuts])
    u = np.array([((unl_scores >= c).sum() + 1) / (len(unl_scores) + 1) for c in cuts])
    return float(np.clip((u / p).min(), LOWEST_PRIOR, HIGHEST_PRIOR))


def train(pos: np.ndarray, unl: np.ndarray, seed: int = SEED) -> Network:
    """Estimate the prior out of fold, then fit."""
    half_p, half_u = np.arange(len(pos)) % 2 == 0, np.arange(len(unl)) % 2 == 0
    scores_p, scores_u = np.zeros(len(pos)), np.zeros(len(unl))
    for side in (True, False):
        net = _train(pos[half_p == side], unl[half_u == side], None, seed)
        scores_p[half_p != side], scores_u[half_u != side] = net.raw(pos[half_p != side]), net.raw(unl[half_u != side])
    return _train(pos, unl, estimate_prior(scores_p, scores_u), seed + 1)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in text_slices(batch.column(2)):
            part = batch.slice(lo, hi - lo)
            made = features(part.column(2))
            ends = pa.array(np.arange(len(made) + 1, dtype=np.int32) * N_FEATURES)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(ends, pa.array(made.ravel()))], names=["doc_id", "label", "made"])


def fit(docs: DataFrame, labels: DataFrame, held_out_fold: int = 2, folds: int = 4) -> Network | None:
    """Train on bounded samples outside the held-out fold; None without positives or unlabelled texts.

    Features are made where the texts lie; only they come to the driver.
    """
    bounded_batches(docs.sparkSession)
    open_fold = fold(F.col("doc_id"), folds) != held_out_fold
    positives = drawn(labels_of(labels, "quality").where(open_fold & (F.col("label") == 1)), MOST_POSITIVES, SEED)
    web = drawn(docs.select("doc_id").where(open_fold & F.col("doc_id").isNotNull()).distinct(), MOST_UNLABELLED, SEED + 1).withColumn("label", F.lit(-1))
    rows = texts_of(docs.select("doc_id", "text"), positives.unionByName(web), MOST_BYTES).select("doc_id", "label", "text")
    found = sorted(rows.mapInArrow(_featured, "doc_id long, label int, made array<double>").collect())  # some 400 bytes a row
    made = np.array([r["made"] for r in found]).reshape(-1, N_FEATURES)
    trusted = np.array([r["label"] == 1 for r in found], dtype=bool)
    if trusted.sum() < 2 or (~trusted).sum() < 2:
        return None
    return train(made[trusted], made[~trusted])


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Quality of every whole text: ``doc_id`` and ``score`` (0 to 1), one row per input row.

    Null and empty texts share one score, that of all features at zero. Without
    positives every score is 0.5. Repeated rows score alike, an empty table gives an
    empty result, texts are read whole; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    send = bounded_batches(docs.sparkSession).sparkContext.broadcast(fit(rows, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = send.value
        for batch in batches:
            for lo, hi in text_slices(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                score = np.full(hi - lo, 0.5) if use is None else use.score(features(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score)], names=["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id long, score double")


def op9_nonneg_pu_quality(spark, sf_dir: str) -> DataFrame:
    """All of ``documents`` scored where they lie, by a model of the positives outside the held-out quarter."""
    scored = quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))

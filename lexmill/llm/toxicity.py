"""Toxicity scores by a small convolutional text classifier trained in numpy.

Words are embedded by hashing (the word, and two lengths of its beginning),
filters of several widths slide over a text, each filter's largest response goes
into a logistic layer. Embeddings start from smoothed log-odds of the training
texts. Scores are calibrated on the sample, each part scored by a model trained
on the others; on those scores a threshold is calibrated for each language.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm._labels import drawn, fold, labels_of, texts_of
from lexmill.llm._words import hash_words, slices, text_slices
from lexmill.llm.spans import over_batches
from lexmill.sources.shared import bounded_batches

HEADS = (7, 6, 4)
"""Bytes of a word's beginning that are hashed as well."""
ROWS = 1 << 15
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
EPOCHS = 8
BATCH = 64
RATE = 0.02
DROPPED = 0.2
EMBED_RATE = 0.2
#: Rows of each class in the training sample, and the longest text in it.
MOST_PER_CLASS = 2000
MOST_BYTES = 20_000
#: Calibration scores every sampled row by a model trained on the other parts.
CROSS_PARTS = 3
#: Words whose responses are held at once when texts are scored.
SCORED_WORDS = 200_000
SEED = 13
CUT = 0.7
LOWEST_CUT, HIGHEST_CUT = 0.4, 0.9
LEAST_TOXIC_ROWS = 10


@dataclass
class Texts:
    """Hashed words of many texts: offsets by text, and table rows of each word."""

    bounds: np.ndarray
    rows: list[np.ndarray]


def hashed(texts: pa.Array) -> Texts:
    bounds, parts = [np.zeros(1, dtype=np.int64)], []
    for lo, hi in text_slices(texts):
        some, hashes = hash_words(texts.slice(lo, hi - lo), heads=HEADS)
        bounds.append(some[1:] + bounds[-1][-1])
        parts.append([(h % np.uint64(ROWS)).astype(np.uint16) for h in hashes])
    tables = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, dtype=np.uint16)] * (1 + len(HEADS))
    return Texts(np.concatenate(bounds), tables)


@dataclass
class Classifier:
    tables: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    weights: np.ndarray
    offset: float
    slope: float = 1.0
    shift: float = 0.0
    cuts: dict[str, float] = field(default_factory=dict)

    def pooled(self, texts: Texts, places: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of every filter to every text (0 if none), and with ``places`` the word it starts at (-1)."""
        n = len(texts.bounds) - 1
        words = sum(self.tables[k][r] for k, r in enumerate(texts.rows))
        best = np.zeros((n, len(self.weights)), dtype=np.float32)
        where = np.full(best.shape, -1, dtype=np.int64) if places else best
        counts = np.diff(texts.bounds)
        for k, width in enumerate(WIDTHS):
            at = slice(k * FILTERS, (k + 1) * FILTERS)
            long = np.flatnonzero(counts >= width)
            if not len(long):
                continue
            m = len(words) - width + 1
            out = np.repeat(self.biases[k][None, :], m, axis=0)
            for j in range(width):
                out += words[j : j + m] @ self.filters[k][j]
            for back in range(1, width):  # windows that reach into the next text respond to nothing
                over = texts.bounds[1:-1] - back
                out[over[(over >= 0) & (over < m)]] = 0
            first = texts.bounds[:-1][long]
            best[long, at] = np.maximum(np.maximum.reduceat(out, first, axis=0), 0)
            if places:
                for i, a in zip(long, first, strict=True):
                    where[i, at] = a + out[a : a + counts[i] - width + 1].argmax(axis=0)
        if places:
            where[best <= 0] = -1
        return best, where

    def raw(self, texts: Texts) -> np.ndarray:
        out = [np.zeros(0)]
        for lo, hi in slices(texts.bounds, SCORED_WORDS):
            a, b = texts.bounds[lo], texts.bounds[hi]
            part = Texts(texts.bounds[lo : hi + 1] - a, [r[a:b] for r in texts.rows])
            out.append(self.pooled(part)[0].astype(np.float64) @ self.weights + self.offset)
        return np.concatenate(out)

    def score(self, texts: Texts) -> np.ndarray:
        return _sigmoid(self.slope * self.raw(texts) + self.shift)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _some(texts: Texts, chosen: np.ndarray) -> Texts:
    parts = [np.arange(texts.bounds[i], texts.bounds[i + 1]) for i in chosen]
    at = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
    return Texts(np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64), [r[at] for r in texts.rows])


def _log_odds(rows: np.ndarray, bounds: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smoothed log-odds of the label by table row, from document counts; rare rows stay near 0."""
    owner = np.repeat(np.arange(len(y)), np.diff(bounds))
    pairs = np.unique(owner.astype(np.int64) * ROWS + rows.astype(np.int64))
    doc, row = pairs // ROWS, pairs % ROWS
    toxic = np.bincount(row[y[doc] == 1], minlength=ROWS)
    clean = np.bincount(row[y[doc] == 0], minlength=ROWS)
    base = (y.sum() + 1) / (len(y) + 2)
    odds = np.log((toxic + 4 * base) / (clean + 4 * (1 - base))) - np.log(base / (1 - base))
    odds[toxic + clean < 3] = 0
    return odds


class _Adam:
    def __init__(self, *arrays: np.ndarray):
        self.m, self.v, self.t = [np.zeros_like(a) for a in arrays], [np.zeros_like(a) for a in arrays], 0

    def step(self, arrays: list[np.ndarray], grads: list[np.ndarray], rate: float) -> None:
        self.t += 1
        for a, g, m, v in zip(arrays, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            a -= rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-7)


def gradients(model: Classifier, texts: Texts, y: np.ndarray, share: np.ndarray, keep: np.ndarray) -> tuple[float, list[np.ndarray], list[tuple[int, np.ndarray, np.ndarray]]]:
    """Logistic loss of a batch, each text weighted by its ``share``, and its gradients.

    ``keep`` marks the filters of each text that are not dropped. The gradients are
    those of filters, biases, weights and offset, then for each table the rows that
    a largest response read and what their change costs.
    """
    best, where = model.pooled(texts, places=True)
    scale = keep / (1 - DROPPED)
    p = _sigmoid((best * scale).astype(np.float64) @ model.weights + model.offset)
    loss = float(-(share * (y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12))).sum())
    error = (p - y) * share
    back = (error[:, None] * model.weights[None, :] * scale).astype(np.float32)
    filters, biases, changes = [np.zeros_like(f) for f in model.filters], [np.zeros_like(b) for b in model.biases], []
    for k, width in enumerate(WIDTHS):
        for c in range(FILTERS):
            at = where[:, k * FILTERS + c]
            hit = np.flatnonzero(at >= 0)
            g = back[hit, k * FILTERS + c]
            biases[k][c] = g.sum()
            for j in range(width):
                rows = [r[at[hit] + j].astype(np.int64) for r in texts.rows]
                filters[k][j, :, c] = g @ sum(model.tables[i][w] for i, w in enumerate(rows))
                changes += [(i, w, g[:, None] * model.filters[k][j, :, c][None, :]) for i, w in enumerate(rows)]
    return loss, [*filters, *biases, (best * scale).T @ error, np.array([error.sum()])], changes


def train(texts: Texts, y: np.ndarray, seed: int = SEED) -> Classifier:
    """Fit on hashed texts; needs both classes."""
    rng = np.random.default_rng(seed)
    kinds = 1 + len(HEADS)
    tables = rng.normal(0, 0.05, (kinds, ROWS, DIM)).astype(np.float32)
    for k in range(kinds):
        tables[k, :, k] = _log_odds(texts.rows[k], texts.bounds, y)
    filters = [rng.normal(0, 0.2 / w, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for k in range(kinds):
        filters[0][0, :, k] = 0
        filters[0][0, k, k] = 1
    filters[0][0, :, kinds] = [1] * kinds + [0] * (DIM - kinds)
    biases = [np.zeros(FILTERS, dtype=np.float32) for _ in WIDTHS]
    weights, offset = np.full(len(WIDTHS) * FILTERS, 0.1), np.array([0.0])
    model = Classifier(tables, filters, biases, weights, 0.0)
    dense = [*filters, *biases, weights, offset]
    adam = _Adam(*dense)
    balance = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), BATCH):
            chosen = order[lo : lo + BATCH]
            batch = _some(texts, chosen)
            keep = rng.random((len(chosen), len(weights))) >= DROPPED  # drop out whole filters of a text
            model.offset = float(offset[0])
            _, grads, changes = gradients(model, batch, y[chosen], balance[chosen] / len(chosen), keep)
            grads[-2] += 1e-4 * weights
            for i, at, change in changes:
                np.add.at(tables[i], at, -EMBED_RATE * change)
            adam.step(dense, grads, RATE * (1 - epoch / EPOCHS))
    model.offset = float(offset[0])
    return model


def calibrate(model: Classifier, raw: np.ndarray, y: np.ndarray, langs: list[str | None], prior_shift: float) -> None:
    """Logistic calibration of raw scores (for the share of label 1 outside the sample), then a cut for each language."""
    slope, shift = 1.0, 0.0
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    for _ in range(50):  # Newton steps on the two parameters, kept near 1 and 0 by a weak penalty
        p = _sigmoid(slope * raw + shift)
        w = p * (1 - p) + 1e-6
        g = np.array([((p - target) * raw).sum() + 0.1 * (slope - 1), (p - target).sum() + 0.1 * shift])
        h = np.array([[(w * raw * raw).sum() + 0.1, (w * raw).sum()], [(w * raw).sum(), w.sum() + 0.1]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 1.0 / (np.abs(step).max() + 1e-9))
        slope, shift = slope - step[0], shift - step[1]
        if np.abs(step).max() < 1e-8:
            break
    model.slope, model.shift = float(max(slope, 0.05)), float(shift + prior_shift)
    score = _sigmoid(model.slope * raw + model.shift)
    names = np.array([x or "" for x in langs])
    for lang in sorted(set(names)):
        mine = names == lang
        if y[mine].sum() < LEAST_TOXIC_ROWS:
            continue
        grid = np.linspace(LOWEST_CUT, HIGHEST_CUT, 26)
        f1 = [2 * ((score[mine] >= c) & (y[mine] == 1)).sum() / max(1, (score[mine] >= c).sum() + y[mine].sum()) for c in grid]
        best = np.flatnonzero(np.array(f1) >= max(f1) - 1e-9)
        model.cuts[str(lang)] = float(grid[best[np.argmin(np.abs(grid[best] - CUT))]])


def _hashed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Table rows of each text's words: two bytes for each word and hash, less than the text."""
    for batch in batches:
        for lo, hi in text_slices(batch.column(3)):
            part = batch.slice(lo, hi - lo)
            texts = hashed(part.column(3))
            words = [np.stack([r[a:b] for r in texts.rows]).tobytes() for a, b in zip(texts.bounds[:-1], texts.bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(words, pa.binary())], names=["doc_id", "label", "lang", "words"])


def _trained(spark, texts: Texts, y: np.ndarray, part: np.ndarray) -> tuple[Classifier, np.ndarray]:
    """A model of the whole sample, and for every row the raw score of a model that has not seen its part.

    The trainings do not depend on each other: each is a task. A part without which
    a class is missing is scored by the whole sample's model.
    """
    send = spark.sparkContext.broadcast((texts, y, part))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, y, part = send.value
        for batch in batches:
            for k in batch.column(0).to_pylist():
                mine = part == k
                sees = 0 < y[~mine].sum() < (~mine).sum()
                made = train(_some(texts, np.flatnonzero(~mine)), y[~mine]) if sees else None
                made = made if k == CROSS_PARTS or made is None else made.raw(_some(texts, np.flatnonzero(mine)))
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([pickle.dumps(made)], pa.binary())], names=["k", "made"])

    # Number CROSS_PARTS is no row's part, so that model sees them all.
    tasks = spark.range(CROSS_PARTS + 1, numPartitions=CROSS_PARTS + 1).mapInArrow(run, "k long, made binary")
    found = {r["k"]: pickle.loads(r["made"]) for r in tasks.collect()}  # a model of 4 MB and a number a sampled row
    model, raw = found[CROSS_PARTS], np.zeros(len(y))
    for k in range(CROSS_PARTS):
        mine = part == k
        raw[mine] = found[k] if found[k] is not None else model.raw(_some(texts, np.flatnonzero(mine)))
    return model, raw


def fit(docs: DataFrame, labels: DataFrame, held_out_fold: int = 1, folds: int = 3, most_per_class: int = MOST_PER_CLASS) -> Classifier | None:
    """Train on a bounded sample of labelled rows outside the held-out fold; None without both classes.

    Words are hashed where the texts lie; only their table rows come to the driver.
    """
    usable = labels_of(labels, "toxic").where(fold(F.col("doc_id"), folds) != held_out_fold)
    totals = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not totals.get(0) or not totals.get(1):
        return None
    sample = drawn(usable.where("label = 1"), most_per_class, SEED).unionByName(drawn(usable.where("label = 0"), most_per_class, SEED))
    bounded_batches(docs.sparkSession)
    rows = texts_of(docs, sample, MOST_BYTES).select("doc_id", "label", "lang", "text")
    found = sorted(rows.mapInArrow(_hashed_rows, "doc_id long, label int, lang string, words binary").collect(), key=lambda r: r["doc_id"])
    y = np.array([r["label"] for r in found], dtype=np.int64)
    if not 0 < y.sum() < len(y):
        return None
    langs, words = [r["lang"] for r in found], [np.frombuffer(r["words"], dtype=np.uint16).reshape(1 + len(HEADS), -1) for r in found]
    texts = Texts(np.concatenate(([0], np.cumsum([w.shape[1] for w in words]))).astype(np.int64), list(np.concatenate(words, axis=1)))
    del found, words
    rank = np.empty(len(y), dtype=np.int64)
    for label in (0, 1):
        mine = np.flatnonzero(y == label)
        rank[mine] = np.arange(len(mine))
    model, raw = _trained(docs.sparkSession, texts, y, rank % CROSS_PARTS)
    shift = np.log(totals[1] / totals[0]) - np.log(y.sum() / (len(y) - y.sum()))
    calibrate(model, raw, y, langs, float(shift))
    return model


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Toxicity of every whole text.

    Returns ``doc_id``, ``score`` (0 to 1), ``cut`` (of the row's language, else
    ``CUT``) and ``toxic`` (score at or above the cut), one row per input row.
    Null, empty and blank texts score what no response of any filter gives. The
    language chooses the cut, never the score; without a language, or a column of
    them, it is ``CUT``. Without labels of both classes every score is 0. Repeated
    rows score alike, an empty table gives an empty result, texts are read whole;
    other columns are ignored.
    """
    docs = docs if lang_col in docs.columns else docs.withColumn(lang_col, F.lit(None).cast("string"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    model = fit(rows, labels)
    bounded_batches(docs.sparkSession)
    send = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = send.value
        for batch in batches:
            for lo, hi in text_slices(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                score = np.zeros(hi - lo) if use is None else use.score(hashed(part.column(1)))
                cuts = [use.cuts.get(x, CUT) if use else CUT for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array(cuts, pa.float64())], names=["doc_id", "score", "cut"])

    return rows.mapInArrow(run, "doc_id long, score double, cut double").withColumn("toxic", F.col("score") >= F.col("cut"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs``, all columns, whose score stays below its language's cut and below ``CUT``.

    Rows are judged where they lie, without a shuffle; null and empty texts are judged
    like any other, and rows without a language, or a column of them, by ``CUT``.
    Without labels of both classes all rows stay. Repeated rows fare alike, an empty
    table stays empty, and other columns may have any names, with dots too.
    """
    if lang_col not in docs.columns:
        return drop_toxic(docs.withColumn(lang_col, F.lit(None).cast("string")), labels, id_col, text_col, lang_col).drop(lang_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    send = bounded_batches(docs.sparkSession).sparkContext.broadcast(fit(rows, labels))
    text_at, lang_at = docs.columns.index(text_col), docs.columns.index(lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = send.value
        for batch in batches:
            for lo, hi in text_slices(batch.column(text_at)):
                part = batch.slice(lo, hi - lo)
                if use is not None:
                    cuts = np.array([min(CUT, use.cuts.get(x, CUT)) for x in part.column(lang_at).to_pylist()])
                    part = part.filter(pa.array(use.score(hashed(part.column(text_at))) < cuts))
                yield part

    return over_batches(docs, run)


def op6_conv_toxicity(spark, sf_dir: str) -> DataFrame:
    """All of ``documents`` scored where they lie, by a model of the labels outside the held-out third."""
    scored = toxicity_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = fold(F.col("doc_id"), 3) == 1
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "cut", "toxic")

"""Bounded samples of labelled texts for classifiers that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def labels_of(labels: DataFrame, column: str) -> DataFrame:
    """One label a document: repeated ids take the largest, nulls are dropped."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
    return rows.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))


def drawn(ids: DataFrame, most: int, seed: int) -> DataFrame:
    """``most`` rows of ``ids`` at most, chosen by a seeded hash of ``doc_id``: the same on every run."""
    return ids.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(most)


def texts_of(docs: DataFrame, ids: DataFrame, most_bytes: int) -> DataFrame:
    """Rows of ``ids`` (a bounded sample, so it is broadcast) with their texts, those above ``most_bytes`` left out.

    An id that repeats gives one row, the least of its texts, so no more rows come than there are in ``ids``.
    """
    texts = docs.where(F.octet_length("text") <= most_bytes)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    least = F.min(F.struct("text", *others)).alias("_row")
    return texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(least).select("doc_id", "label", "_row.*")

"""Expressions over ``array<double>`` columns.

Higher-order functions are interpreted, so these suit short arrays (logits).
Long vectors against many others go through :mod:`lexmill.operators.neighbours`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: x / F.when(n == 0, 1.0).otherwise(n))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def rbf(a: Column, b: Column, gamma: Column) -> Column:
    return F.exp(-gamma * squared_distance(a, b))


def logsumexp(z: Column) -> Column:
    m = F.array_max(z)
    return m + F.ln(F.aggregate(F.transform(z, lambda x: F.exp(x - m)), F.lit(0.0), lambda s, x: s + x))


def softmax(z: Column, temperature: float = 1.0) -> Column:
    scaled = F.transform(z, lambda x: x / F.lit(float(temperature)))
    total = logsumexp(scaled)
    return F.transform(scaled, lambda x: F.exp(x - total))


def argmax(z: Column) -> Column:
    """Position of the first largest element, from 0."""
    return (F.array_position(z, F.array_max(z)) - 1).cast("int")


def masked_mean(vectors: Column, mask: Column) -> Column:
    """Mean over the positions of an array of vectors where ``mask`` is 1."""
    kept = F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda r: r["m"] == 1)
    n = F.size(kept)
    width = F.size(F.element_at(vectors, 1))
    return F.transform(F.sequence(F.lit(1), width), lambda i: F.aggregate(kept, F.lit(0.0), lambda s, r: s + F.element_at(r["v"], i)) / n)


def top_k(labels: Column, values: Column, k: int) -> Column:
    """The ``k`` largest values with their labels, ties by label."""
    pairs = F.arrays_zip(labels.alias("label"), values.alias("prob"))
    by = lambda a, b: F.when(a["prob"] > b["prob"], -1).when(a["prob"] < b["prob"], 1).when(a["label"] < b["label"], -1).when(a["label"] > b["label"], 1).otherwise(0)
    return F.slice(F.array_sort(pairs, by), 1, k)

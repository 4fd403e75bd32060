"""Cumulative sums over a total order, without one task that holds it all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 64


def cumulative(rows: DataFrame, order: str, sums: dict[str, str], keys: tuple[str, ...] = (), buckets: int = BUCKETS) -> DataFrame:
    """``rows`` with running sums (name -> column) in ascending ``order``, per group of ``keys``.

    ``order`` must be unique within a group; combine ties beforehand. Values are
    dealt into ranges by approximate quantiles; each range is summed by itself
    and starts from the total of the ranges before it, a table of ``buckets`` rows a group.
    """
    shares = [i / buckets for i in range(1, buckets)]
    cuts = rows.agg(F.percentile_approx(order, F.array(*[F.lit(s) for s in shares]), 10_000)).first()[0] or []
    edges = F.array(*[F.lit(c) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<double>")
    dealt = rows.withColumn("_b", F.size(F.filter(edges, lambda e: e < F.col(order))))
    totals = dealt.groupBy(*keys, "_b").agg(*[F.sum(c).alias(f"_t{i}") for i, c in enumerate(sums.values())])
    before = Window.partitionBy(*keys, F.lit(1)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, "_b", *[F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"_s{i}") for i in range(len(sums))])
    inside = Window.partitionBy(*keys, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = dealt.join(starts, [*keys, "_b"])
    return joined.select(*rows.columns, *[(F.col(f"_s{i}") + F.sum(c).over(inside)).alias(name) for i, (name, c) in enumerate(sums.items())])


def by_score(rows: DataFrame, score: str, positive: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows combined by distinct score: ``n_pos`` and ``n_neg`` by the 0/1 column ``positive``."""
    return rows.groupBy(*keys, score).agg(F.sum(positive).cast("long").alias("n_pos"), F.sum(1 - F.col(positive)).cast("long").alias("n_neg"))

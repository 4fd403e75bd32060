"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from lexmill.sources.shared import cut, forget


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Label every node of ``edges`` with the smallest node it can reach.

    Returns ``node``, ``component``. Self-loops and nulls are dropped, repeated
    edges count once, an empty table gives an empty result. Rounds grow with the
    logarithm of the longest path; each is written to the shared folder, where it
    replaces the one before.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    now, state = _written(both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        if state == before or not state["n"]:
            return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before, last = state, now
        around = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = around.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now, state = _written(small.unionByName(root.withColumnRenamed("m", "v")).distinct())
        forget(last)


def _written(edges: DataFrame) -> tuple[DataFrame, Row]:
    """The table written and read again, with its count and checksum.

    They are read from the written table: an observed query would leave its
    manager in the session, which then cannot be sent along with a fitted model.
    """
    table = cut(edges, "edges")
    return table, table.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")).first()

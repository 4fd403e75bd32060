"""Integrity of keyed tables, as rows that count violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_report(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Repeated keys of both sides and keys without a partner: all 0 for a one-to-one join."""
    sides = left.groupBy(on).agg(F.count("*").alias("l")).join(right.groupBy(on).agg(F.count("*").alias("r")), on, "full_outer")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return sides.agg(
        F.count_if(n("l") > 1).alias("left_repeats"), F.count_if(n("r") > 1).alias("right_repeats"), F.count_if(n("r") == 0).alias("left_only"), F.count_if(n("l") == 0).alias("right_only"), F.count_if((n("l") > 0) & (n("r") > 0)).alias("both")
    )


def one_to_one(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Join that fails at run time if a key repeats on either side. Rows without a key meet nothing and may be many."""

    def single(side: DataFrame, name: str) -> DataFrame:
        others = [c for c in side.columns if c != on]
        rows = side.groupBy(on, F.when(F.col(on).isNull(), F.monotonically_increasing_id()).alias("_row")) if name == "left" else side.where(F.col(on).isNotNull()).groupBy(on)
        once = rows.agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in others])
        failure = F.raise_error(F.concat(F.lit(f"repeated {on} on the {name}: "), F.col(on).cast("string"))).cast("boolean")
        return once.where(F.when(F.col("_n") > 1, failure).otherwise(True)).select(side.columns)

    return single(left, "left").join(single(right, "right"), on, how)


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``rule`` and the number of rows that break it; a rule is the condition that rows must meet."""
    counts = rows.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("broken")) for n in rules])).alias("r")).select("r.*")


def mixed_groups(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Groups with more than one value."""
    return rows.groupBy(group).agg(F.min(value).alias("least"), F.max(value).alias("most"), F.count("*").alias("n")).where("least <> most")


def same_keys(*tables: DataFrame, on: str) -> DataFrame:
    """How many keys are in all tables, and how many in some but not all."""
    marked = [t.select(on).distinct().withColumn("_m", F.lit(1)) for t in tables]
    counts = reduce(DataFrame.unionByName, marked).groupBy(on).agg(F.sum("_m").alias("n"))
    return counts.agg(F.count_if(F.col("n") == len(tables)).alias("in_all"), F.count_if(F.col("n") < len(tables)).alias("in_some"))

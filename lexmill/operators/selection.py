"""Picks from pools of any size, without an order of any whole pool."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bins of each pool; one of them is sorted.
BINS = 1024


def smallest(rows: DataFrame, keys: list[str], value: str, id_col: str, want: DataFrame, count: str, bins: int = BINS) -> DataFrame:
    """``keys`` and ``id_col`` of as many rows of each group as ``want`` says (``keys`` and ``count``), least ``value`` first, ties by id.

    A histogram of each group tells in which bin its cut falls: rows below are taken
    as they are, and those of the bin alone are put in order. A null value comes
    last; a group that wants more than it has is taken whole, one that wants none or
    is not in ``want`` is left out. Values of the cut's bin that are all equal are
    ordered in one task.
    """
    v = F.coalesce(F.col(value).cast("double"), F.lit(float("inf")))
    held = rows.select(*keys, id_col, v.alias("_v"))
    finite = F.when(F.abs("_v") < float("inf"), F.col("_v"))
    ends = held.groupBy(*keys).agg(F.min(finite).alias("_lo"), F.max(finite).alias("_hi"))  # a row a group
    step = F.floor((F.col("_v") - F.col("_lo")) / F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(1.0) * bins)
    # Beyond the bins: infinite and null values.
    number = F.when(F.col("_v") == float("inf"), F.lit(bins)).when(F.col("_v") == float("-inf"), F.lit(-1)).otherwise(F.least(step, F.lit(bins - 1))).cast("int")
    binned = held.join(ends, keys).select(*keys, id_col, "_v", number.alias("_bin"))
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_bin"))  # a row a bin
    counts = binned.groupBy(*keys, "_bin").agg(F.count("*").alias("_c")).withColumn("_upto", upto)
    wanted = want.where(F.col(count) > 0).select(*keys, F.col(count).alias("_want"))
    cuts = counts.join(wanted, keys).where(F.col("_upto") - F.col("_c") < F.col("_want"))
    last = cuts.groupBy(*keys).agg(F.max("_bin").alias("_last"), F.max_by(F.col("_want") - F.col("_upto") + F.col("_c"), "_bin").alias("_rest"))
    met = binned.join(last, keys).where(F.col("_bin") <= F.col("_last"))
    order = F.row_number().over(Window.partitionBy(*keys).orderBy("_v", id_col))
    edge = met.where(F.col("_bin") == F.col("_last")).withColumn("_n", order).where(F.col("_n") <= F.col("_rest"))
    return met.where(F.col("_bin") < F.col("_last")).select(*keys, id_col).unionByName(edge.select(*keys, id_col))

"""Counts, copies and heads of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.operators.sized import broadcast_if_small
from lexmill.sources.shared import cut


def numbered(rows: DataFrame, order: list[Column], name: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with their number from 1 in a total order, within ``keys``, without one task that holds them all.

    Rows are dealt into ranges of the order; each range is numbered by itself and
    starts after the rows of the ranges before it, a table of one row a range and group.
    """
    dealt = cut(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy(*keys, "_range").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*keys, F.lit(1)).orderBy("_range")
    starts = sizes.select(*keys, "_range", (F.sum("_c").over(before) - F.col("_c")).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order))
    return dealt.join(starts, [*keys, "_range"]).withColumn(name, (F.col("_start") + inside).cast("long")).select(*rows.columns, name)


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    """``n``, ``share`` and ``rank`` (largest first, ties by value) of each value."""
    counts = numbered(rows.groupBy(column).agg(F.count("*").alias("n")), [F.col("n").desc(), F.col(column).asc()], "rank")
    total = rows.agg(F.count("*").alias("_all"))
    return counts.crossJoin(F.broadcast(total)).select(column, "n", (F.col("n").cast("double") / F.col("_all")).alias("share"), "rank")


def later_copies(rows: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """``rows`` with a flag: another row has the same key and a smaller ``order``.

    The first of each key comes from an aggregate, so a key that holds much of
    the table is combined before it is shuffled.
    """
    firsts = rows.groupBy(key).agg(F.min(order).alias("_first"), F.count("*").alias("_n")).where("_n > 1").select(key, "_first")
    return rows.join(firsts, key, "left").withColumn(name, F.coalesce(F.col(order) > F.col("_first"), F.lit(False))).drop("_first")


def head_per_group(rows: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "place") -> DataFrame:
    """The first ``k`` rows of each group, numbered; the limit is applied before the shuffle."""
    numbered = rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)
    return numbered.withColumn(name, F.col(name).cast("long"))


def dense_ids(rows: DataFrame, column: str, name: str = "id") -> DataFrame:
    """Distinct values in sorted order with numbers from 0."""
    return numbered(rows.select(column).distinct(), [F.col(column).asc()], name).withColumn(name, F.col(name) - 1)


def with_ids(rows: DataFrame, column: str, name: str = "id") -> DataFrame:
    """``rows`` with the dense number of their value."""
    return rows.join(broadcast_if_small(dense_ids(rows, column, name)), column)


def counts_in_order(rows: DataFrame, row: str, column: str, row_values: list, column_values: list) -> DataFrame:
    """Counts over the given rows and columns in the given order, zeros kept; ``place`` is a row's number. Other values are left out."""
    order = rows.sparkSession.createDataFrame(list(enumerate(row_values)), f"place int, {row} {rows.schema[row].dataType.simpleString()}")
    counts = rows.groupBy(row).pivot(column, column_values).count()
    return order.join(counts, row, "left").na.fill(0, [str(v) for v in column_values])


def transposed(table: DataFrame, key: str, keys: list, columns: list[str], name: str = "metric") -> DataFrame:
    """A small table turned round: one row for each of ``columns``, one column for each of ``keys``."""
    return table.unpivot([key], columns, name, "_v").groupBy(name).pivot(key, keys).agg(F.first("_v"))

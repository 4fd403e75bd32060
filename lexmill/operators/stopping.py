"""Early stopping over the logs of many runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def early_stops(log: DataFrame, keys: list[str], epoch: str, score: str, patience: int, least_gain: float = 0.0) -> DataFrame:
    """``best_epoch``, ``best_score``, ``last_epoch``, ``epochs`` and ``stopped`` of every run.

    An epoch improves if its score is above the best before by more than
    ``least_gain``; a run stops at the epoch that is the ``patience``-th in a row
    without. What its log has beyond does not count. A null score never improves; of
    rows that repeat an epoch the best counts. A run is folded in order of its
    epochs, one array of its scores; runs may be any number.
    """
    once = log.groupBy(*keys, F.col(epoch).cast("long").alias("_e")).agg(F.max(F.col(score).cast("double")).alias("_s"))
    runs = once.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_e", "_s"))).alias("_log"))
    none = F.lit(None)
    start = F.struct(none.cast("long").alias("best_epoch"), none.cast("double").alias("best_score"), none.cast("long").alias("last_epoch"), F.lit(0).alias("epochs"), F.lit(0).alias("waited"), F.lit(False).alias("stopped"))

    def step(state: Column, row: Column) -> Column:
        better = row["_s"].isNotNull() & (state["best_score"].isNull() | (row["_s"] > state["best_score"] + F.lit(float(least_gain))))
        waited = F.when(better, F.lit(0)).otherwise(state["waited"] + 1)
        after = F.struct(
            F.when(better, row["_e"]).otherwise(state["best_epoch"]).alias("best_epoch"),
            F.when(better, row["_s"]).otherwise(state["best_score"]).alias("best_score"),
            row["_e"].alias("last_epoch"),
            (state["epochs"] + 1).alias("epochs"),
            waited.alias("waited"),
            (waited >= patience).alias("stopped"),
        )
        return F.when(state["stopped"], state).otherwise(after)

    made = runs.select(*keys, F.aggregate("_log", start, step).alias("_x"))
    return made.select(*keys, "_x.best_epoch", "_x.best_score", "_x.last_epoch", F.col("_x.epochs").cast("long").alias("epochs"), "_x.stopped")

"""Live monitoring: every day of a stream is judged once, when it is over, against a reference."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.sources.tables import exists

Judge = Callable[[DataFrame], DataFrame]


class Monitor:
    """Below ``base``: the rows that came, by batch and day, and what was found, by day.

    Each batch is written under its number and each judged day under its date, both
    replacing what a run that was stopped may have left: a restart adds nothing twice.
    ``judge`` gets the rows of the days that are over, with ``day``, and returns rows
    with ``day``. A day is over when the newest row is ``late`` past its end.
    """

    def __init__(self, spark: SparkSession, base: str, judge: Judge, schema: str, time: str = "ts", late: datetime.timedelta = datetime.timedelta(days=1)):
        self.spark, self.base, self.judge, self.schema, self.time, self.late = spark, base, judge, schema, time, late

    def found(self) -> DataFrame:
        """What was found so far, a row for each ``day``."""
        if not exists(self.spark, f"{self.base}/found"):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.base}/found")

    def _rows(self, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.base}/rows")

    def _settle(self, like: DataFrame, all_days: bool) -> None:
        rows = self._rows(like)
        days = {r["day"] for r in rows.select("day").distinct().collect()}  # partitions, a row a day
        newest = rows.where(F.col("day") == max(days)).agg(F.max(F.col(self.time).cast("timestamp_ntz"))).first()[0] if days else None
        done = {r["day"] for r in self.found().select("day").distinct().collect()}
        over = lambda d: all_days or datetime.datetime.combine(d, datetime.time()) + datetime.timedelta(days=1) + self.late <= newest
        if closed := [d for d in sorted(days - done) if over(d)]:
            judged = self.judge(rows.where(F.col("day").isin(closed)))
            judged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{self.base}/found")

    def take(self, batch: DataFrame, number: int) -> None:
        """One batch, for ``foreachBatch``."""
        dated = batch.withColumn("day", F.to_date(self.time))
        if not dated.isEmpty():
            dated.write.mode("overwrite").partitionBy("day").parquet(f"{self.base}/rows/batch={number}")
            self._settle(dated, False)

    def run(self, stream: DataFrame, last: bool = False) -> DataFrame:
        """Take all that there is and return what was found; ``last`` says that no more comes, so that all days are over."""
        writer = stream.writeStream.foreachBatch(self.take).option("checkpointLocation", f"{self.base}/state")
        writer.trigger(availableNow=True).start().awaitTermination()
        if last and exists(self.spark, f"{self.base}/rows"):
            self._settle(stream.withColumn("day", F.to_date(self.time)), True)
        return self.found()

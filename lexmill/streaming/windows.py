"""Event-time windows over a stream of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.sources.shared import fresh_path
from lexmill.streaming.latest import keyed_state

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files: str = "events.parquet") -> DataFrame:
    """A stream of the event files of a folder, their time as an instant (watermarks need one)."""
    rows = spark.readStream.schema(EVENTS).option("pathGlobFilter", files).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def window_counts(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Count, distinct users and mean value of each tumbling window; rows later than ``late`` are too late."""
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("users"), F.avg("value").alias("mean_value"))


def first_answers(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark: a log replayed after a stop adds nothing twice."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def replay(counts: DataFrame, name: str = "windows") -> DataFrame:
    """Run a windowed stream over all that is there, then return its last full result as a table."""
    spark = counts.sparkSession
    base = fresh_path(spark, name)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/result")

    run = counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{base}/result")


def resumed(rows: DataFrame, base: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is new since it last ran below ``base``, and return all that it gave. A batch that is run again replaces its own rows."""
    spark = rows.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/result/batch={number}")

    with keyed_state(spark):
        run = rows.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{base}/result")


def replay_append(rows: DataFrame, name: str = "rows", mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and return what it gave."""
    return resumed(rows, fresh_path(rows.sparkSession, name), mode)

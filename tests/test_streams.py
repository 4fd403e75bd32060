"""Streams that are stopped, fed and started again give what a table would."""

from __future__ import annotations

import datetime
import math

import numpy as np
from pyspark.sql import functions as F

from lexmill.operators import drift
from lexmill.plans.drift import _FOUND, judged_days, marked_events
from lexmill.sources.tables import latest
from lexmill.streaming import monitor, windows
from lexmill.streaming.latest import latest_rows

START = datetime.datetime(2024, 3, 1)


def events(spark, rows, folder, name):
    made = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    made.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def row(i, hours, user, kind="a", value=1.0):
    return (i, START + datetime.timedelta(hours=hours), user, kind, value, "{}")


def stream(spark, folder):
    return spark.readStream.schema(windows.EVENTS).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(folder)).withColumn("ts", F.col("ts").cast("timestamp"))


def test_latest_rows_survive_restarts(spark, tmp_path):
    kept = lambda: latest_rows(stream(spark, tmp_path / "in").select("user_id", "ts", "event_id", "value"), ["user_id"], ["ts", "event_id"], "ts", quiet_days=2)
    events(spark, [row(1, 5, 1, value=1.0), row(2, 5, 1, value=2.0), row(3, 1, 2, value=3.0)], tmp_path / "in", "a")
    one = windows.resumed(kept(), f"{tmp_path}/out", "update")
    assert {(r["user_id"], r["event_id"]) for r in latest(one, ["user_id"], ["ts", "event_id"]).collect()} == {(1, 2), (2, 3)}
    # Older rows change nothing, newer ones do, and a key that was quiet for long is begun anew.
    events(spark, [row(4, 4, 1, value=4.0), row(5, 9, 2, value=5.0), row(6, 300, 3)], tmp_path / "in", "b")
    windows.resumed(kept(), f"{tmp_path}/out", "update")
    events(spark, [row(7, 301, 1, value=7.0)], tmp_path / "in", "c")
    last = windows.resumed(kept(), f"{tmp_path}/out", "update")
    again = windows.resumed(kept(), f"{tmp_path}/out", "update")
    assert {(r["user_id"], r["event_id"], r["value"]) for r in latest(again, ["user_id"], ["ts", "event_id"]).collect()} == {(1, 7, 7.0), (2, 5, 5.0), (3, 6, 1.0)}
    assert last.count() == again.count() == 5


def test_days_are_judged_once_and_as_the_table_says(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows, days = [], 6
    for d in range(days):
        for i in range(80):
            shifted = d == 4
            rows.append(row(d * 1000 + i, 24 * d + rng.random() * 24, int(rng.integers(0, 40)), "xyz"[int(rng.integers(0, 3))] if not shifted else "x", float(rng.exponential(50) * (6 if shifted else 1))))
    first = spark.createDataFrame([r for r in rows if r[0] < 2000], "event_id long, ts timestamp, user_id long, event_type string, value double, props string").withColumn("day", F.to_date("ts"))
    judge, calls = judged_days(marked_events(first).drop("day"), 0.75), []

    def counted(df):
        calls.append(sorted(r["day"] for r in df.select("day").distinct().collect()))
        return judge(df)

    live = monitor.Monitor(spark, f"{tmp_path}/m", counted, _FOUND)
    for part in range(3):
        events(spark, [r for r in rows if r[0] // 1000 in (2 * part, 2 * part + 1)], tmp_path / "in", f"p{part}")
        live.run(stream(spark, tmp_path / "in"))
    assert [len(c) for c in calls] == [2, 2] and live.found().count() == 4  # the last day and the one before it may still get rows
    found = monitor.Monitor(spark, f"{tmp_path}/m", counted, _FOUND).run(stream(spark, tmp_path / "in"), last=True)
    assert [len(c) for c in calls] == [2, 2, 2] and live.run(stream(spark, tmp_path / "in"), last=True).count() == days and len(calls) == 3
    whole = judge(spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").withColumn("day", F.to_date("ts")))
    order = lambda df: sorted(map(tuple, df.select("day", "n", "ks", "ks_p", "unknown_p", "mix_p", "share_p", "alerts").collect()))
    got, want = order(found), order(whole)
    assert [g[:2] + g[7:] for g in got] == [w[:2] + w[7:] for w in want] and np.allclose([g[2:7] for g in got], [w[2:7] for w in want])
    assert [d for d, alerts in enumerate(g[7] for g in got) if "values" in alerts and "mix" in alerts] == [4]


def test_chi_square_tails():
    for x, df, p in ((3.841458820694124, 1, 0.05), (9.487729036781154, 4, 0.05), (11.344866730144373, 3, 0.01), (18.307038053275146, 10, 0.05), (24.99579013972863, 15, 0.05)):
        assert math.isclose(drift.chi_square_tail(x, df), p, rel_tol=1e-9)
    assert drift.chi_square_tail(0.0, 3) == drift.chi_square_tail(5.0, 0) == 1.0

"""The last row of each key of a stream, by keyed state."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DateType, StructType, TimestampNTZType, TimestampType

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state where values and timers can be kept; the session's own setting comes back."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


class _Last(StatefulProcessor):
    """The place in the order of each key's last row. A timer drops the state of a key that has been quiet for long."""

    def __init__(self, columns: list[str], places: StructType, quiet_ms: int):
        self.columns, self.places, self.quiet_ms = columns, places, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", self.places)

    @staticmethod
    def _comparable(place: tuple) -> tuple:
        return tuple((x is not None, 0 if x is None else x) for x in place)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        place = lambda r: tuple(r[c] for c in self.places.names)
        best = max(rows, key=lambda r: self._comparable(place(r)))
        if self.last.exists() and self._comparable(tuple(self.last.get())) >= self._comparable(place(best)):
            return
        self.last.update(place(best))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if best["_ms"] is not None:
            self.handle.registerTimer(best["_ms"] + self.quiet_ms)
        yield Row(**{c: best[c] for c in self.columns})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def latest_rows(rows: DataFrame, keys: list[str], order: list[str], time: str, late: str = "1 day", quiet_days: float = 7) -> DataFrame:
    """A stream of every row that becomes the last of its key by ``order`` (numbers, strings, times), among them ``time``.

    What is kept of a key is the place of its last row in the order. It is dropped
    when the watermark of ``time`` is ``quiet_days`` past it, so the state grows with the
    keys of that time, not with all; an older row that comes after that is given once
    more, and readers that take the last row of each key are none the wiser. Nulls in
    ``order`` come first; of equal rows the first that arrives counts.
    """
    # Times are compared as numbers: what comes back from the state has no zone.
    place = {f"_o{k}": F.unix_micros(F.col(c).cast("timestamp")) if isinstance(rows.schema[c].dataType, (TimestampType, TimestampNTZType, DateType)) else F.col(c) for k, c in enumerate(order)}
    marked = rows.withWatermark(time, late).withColumns(place | {"_ms": F.unix_millis(time)})
    places = StructType([marked.schema[c] for c in place])
    return marked.groupBy(*keys).transformWithState(_Last(rows.columns, places, int(quiet_days * 86_400_000)), rows.schema, "Update", "EventTime")

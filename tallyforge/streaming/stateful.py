"""Keyed state with an end: reviews folded from events, and lifecycles with timeouts.

Both are stateful processors over a watermark. Their state is in the state
store, by key, so it survives lost executors and restarts; it ends by itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ms(text: str, spark) -> int:
    """An interval such as '12 hours' in milliseconds."""
    return int(spark.range(1).select(F.expr(f"unix_millis(timestamp_millis(0) + INTERVAL {text})")).first()[0])


def once(stream: DataFrame, event_id: str, ts: str, late: str) -> DataFrame:
    """The stream with a watermark; an event id that comes again within the delay is dropped, and forgotten after it."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark([event_id])


def _only_timer(handle, at: int, after_ms: int) -> None:
    """One timer, in place of those that the key has. at: microseconds, as all times of the states."""
    for timer in list(handle.listTimers()):
        handle.deleteTimer(timer)
    handle.registerTimer(at // 1000 + after_ms)


class _Fold(StatefulProcessor):
    """The newest value of each field of an item, and how many events it had."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.values = handle.getMapState("values", "field string", "value string, at long, event_id long")
        self.events = handle.getValueState("events", "n long")

    def handleInputRows(self, key, rows, timerValues):
        n = self.events.get()[0] if self.events.exists() else 0
        changed = {}
        for row in rows:
            n += 1
            own = changed.get(row.field)
            if own is None or (row.at, row.event_id) > own[1:]:
                changed[row.field] = (row.value, row.at, row.event_id)
        for field, new in changed.items():
            old = self.values.getValue((field,)) if self.values.containsKey((field,)) else None
            if old is None or (old[1], old[2]) < new[1:]:
                self.values.updateValue((field,), new)
        self.events.update((n,))
        fields = {k[0]: tuple(v) for k, v in self.values.iterator()}
        last = max(v[1] for v in fields.values())
        _only_timer(self.handle, last, self.keep_ms)
        yield Row(item=key[0], fields={f: v[0] for f, v in fields.items()}, last_us=last, n_events=n)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.values.clear()
        self.events.clear()
        return iter(())

    def close(self) -> None:
        pass


def folded_reviews(stream: DataFrame, key: str, field: str, value: str, *, ts: str = "ts", event_id: str = "event_id", late: str = "1 day", keep: str = "90 days") -> DataFrame:
    """(key, fields, last_ts, n_events) of each item whenever it has new events: the newest value of each field that any of its events set.

    A status, an override of a field and a note are all fields. An event sets one
    field; the newest by time and then by id wins, in whatever order they come. A
    repeated event id changes neither the fields nor the count. An item's state
    ends when the watermark passes its newest event by ``keep``.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = once(stream, event_id, ts, late).where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(key).alias("item"), F.col(field).alias("field"), F.col(value).cast("string").alias("value"), F.col(ts).alias("ts"), F.unix_micros(ts).alias("at"), F.col(event_id).cast("long").alias("event_id"))
    kind = stream.schema[key].dataType.simpleString()
    folded = rows.groupBy("item").transformWithState(_Fold(_ms(keep, spark)), f"item {kind}, fields map<string,string>, last_us long, n_events long", "Update", "EventTime")
    return folded.select(F.col("item").alias(key), "fields", F.timestamp_micros("last_us").alias("last_ts"), "n_events")


class _Lifecycle(StatefulProcessor):
    """The newest event of a task and a timer for when it is overdue."""

    def __init__(self, final: frozenset[str], timeout_ms: int):
        self.final, self.timeout_ms = final, timeout_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "event string, at long, event_id long")

    def handleInputRows(self, key, rows, timerValues):
        newest = tuple(self.last.get()) if self.last.exists() else None
        for row in rows:
            one = (row.event, row.at, row.event_id)
            if newest is None or one[1:] > newest[1:]:
                newest = one
        _only_timer(self.handle, newest[1], self.timeout_ms)
        self.last.update(newest)
        yield Row(task=key[0], event=newest[0], last_us=newest[1], finished=newest[0] in self.final, timed_out=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        event, at, _ = self.last.get()
        self.last.clear()
        if event not in self.final:
            yield Row(task=key[0], event=event, last_us=at, finished=False, timed_out=True)

    def close(self) -> None:
        pass


def lifecycles(stream: DataFrame, key: str, event: str, final: Sequence[str], timeout: str, *, ts: str = "ts", event_id: str = "event_id", late: str = "1 hour") -> DataFrame:
    """(key, event, last_ts, finished, timed_out): a task's newest event whenever it has new ones, and once more when it times out.

    A task that isn't finished times out when the watermark passes its newest
    event by ``timeout``. Its state, as that of a finished task, ends then; a later
    event begins a new lifecycle.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)  # late rows are known by this column, so it stays
    rows = timed.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(key).alias("task"), F.col(event).alias("event"), F.col(ts).alias("ts"), F.unix_micros(ts).alias("at"), F.col(event_id).cast("long").alias("event_id"))
    kind = stream.schema[key].dataType.simpleString()
    found = rows.groupBy("task").transformWithState(_Lifecycle(frozenset(final), _ms(timeout, spark)), f"task {kind}, event string, last_us long, finished boolean, timed_out boolean", "Update", "EventTime")
    return found.select(F.col("task").alias(key), F.col("event").alias(event), F.timestamp_micros("last_us").alias("last_ts"), "finished", "timed_out")

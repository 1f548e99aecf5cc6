"""Streams over several runs: repeated and late events, state that ends, timers."""

import pytest
from pyspark.sql import functions as F

from tallyforge.sources._folder import new_folder
from tallyforge.streaming import events, stateful

SCHEMA = "task string, kind string, value string, event_id long, at string"


class Feed:
    """Events written batch by batch, each batch taken by one run."""

    def __init__(self, spark, make):
        self.spark, self.make, self.path, self.out = spark, make, new_folder(spark, "feed"), new_folder(spark, "fed")

    def put(self, *rows, mode="update"):
        df = self.spark.createDataFrame([(t, k, v, i, f"2024-01-{d:02} {h:02}:00:00") for t, k, v, i, d, h in rows], SCHEMA)
        df.select("task", "kind", "value", "event_id", F.col("at").cast("timestamp_ntz").alias("ts")).coalesce(1).write.mode("append").parquet(self.path)
        events.run(self.make(events.read_stream(self.spark, self.path)), self.out, mode=mode)
        rows = self.spark.read.parquet(f"{self.out}/table")
        last = rows.agg(F.max("batch")).first()[0]
        return rows, last


@pytest.fixture
def lifecycles(spark):
    return Feed(spark, lambda s: stateful.lifecycles(s, "task", "kind", ["done"], "12 hours", late="1 hour"))


def test_lifecycles_time_out_in_the_stream(spark, lifecycles):
    def states():
        return {r["task"]: (r["kind"], r["finished"], r["timed_out"]) for r in events.newest(spark, lifecycles.out, ["task"]).collect()}

    lifecycles.put(("a", "start", None, 1, 1, 0), ("b", "start", None, 2, 1, 1), ("c", "start", None, 3, 1, 2), ("c", "done", None, 4, 1, 3))
    assert states() == {"a": ("start", False, False), "b": ("start", False, False), "c": ("done", True, False)}
    # b goes on; the watermark is 12:30 o'clock at most, past a's timeout but not b's
    lifecycles.put(("b", "work", None, 5, 1, 13), ("b", "start", None, 0, 1, 1))
    assert states() == {"a": ("start", False, True), "b": ("work", False, False), "c": ("done", True, False)}
    # a row that is late beyond the watermark is dropped; c's later event is a new lifecycle; b times out
    lifecycles.put(("a", "late", None, 6, 1, 2), ("c", "start", None, 7, 3, 0))
    assert states() == {"a": ("start", False, True), "b": ("work", False, True), "c": ("start", False, False)}
    timed_out = spark.read.parquet(f"{lifecycles.out}/table").where("timed_out").groupBy("task").count().collect()
    assert {r["task"]: r["count"] for r in timed_out} == {"a": 1, "b": 1}


def test_repeated_events_change_nothing(spark):
    feed = Feed(spark, lambda s: stateful.folded_reviews(s, "task", "kind", "value", late="2 days", keep="20 days"))

    def states():
        return {r["task"]: (r["fields"], r["n_events"]) for r in events.newest(spark, feed.out, ["task"]).collect()}

    one = [("a", "status", "open", 1, 1, 0), ("a", "override:unit", "EA", 2, 1, 1), ("b", "note", "look", 3, 1, 1)]
    feed.put(*one, one[0])
    assert states() == {"a": ({"status": "open", "override:unit": "EA"}, 2), "b": ({"note": "look"}, 1)}
    # repeated in the next run, an older event that comes late, a newer status
    feed.put(*one, ("a", "override:unit", "SF", 4, 1, 0), ("a", "status", "approved", 5, 1, 2))
    assert states() == {"a": ({"status": "approved", "override:unit": "EA"}, 4), "b": ({"note": "look"}, 1)}
    # the watermark passes: b's state ends, so that it begins anew
    feed.put(("c", "status", "open", 6, 30, 0))
    feed.put(("b", "status", "open", 7, 29, 0))
    assert states()["b"] == ({"status": "open"}, 1)


def test_latest_state_takes_an_event_once(spark):
    feed = Feed(spark, lambda s: events.latest_state(s, "task", ["kind"]))
    feed.put(("a", "x", None, 1, 1, 0), ("a", "x", None, 1, 1, 0))
    feed.put(("a", "x", None, 1, 1, 0), ("a", "y", None, 2, 1, 0), ("a", "w", None, 0, 1, 0))
    assert [(r["kind"], r["n_events"]) for r in events.newest(spark, feed.out, ["task"]).collect()] == [("y", 3)]


def test_sessions_come_once_when_they_are_closed(spark):
    feed = Feed(spark, lambda s: events.session_counts(s, "task", gap="2 hours", late="1 hour"))
    feed.put(("a", "x", None, 1, 1, 0), ("a", "x", None, 2, 1, 1), ("b", "x", None, 3, 1, 0), mode="append")
    assert events.appended(spark, feed.out).count() == 0
    feed.put(("a", "x", None, 4, 1, 4), ("b", "x", None, 5, 1, 9), mode="append")  # a's session had ended at 3 o'clock
    got = sorted((r["task"], r["session_start"].hour, r["n"]) for r in events.appended(spark, feed.out).collect())
    assert got == [("a", 0, 2), ("a", 4, 1), ("b", 0, 1)]
    feed.put(("a", "x", None, 6, 1, 1), ("b", "x", None, 7, 2, 9), mode="append")  # too late for a; b's second one closes
    got = sorted((r["task"], r["session_start"].hour, r["n"]) for r in events.appended(spark, feed.out).collect())
    assert got == [("a", 0, 2), ("a", 4, 1), ("b", 0, 1), ("b", 9, 1)]

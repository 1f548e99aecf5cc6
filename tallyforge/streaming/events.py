"""Event streams: latest state, windowed counts, counters, lifecycles and imports.

Aggregates run in update mode; every micro-batch's changed rows are written under
the batch's number (written again if the batch is retried), and a reader takes the
newest row of each key. So what is written follows the changes, not the state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.streaming.stateful import once


def read_stream(spark: SparkSession, path: str, *, files_per_batch: int = 1000) -> DataFrame:
    """New Parquet files under a path (a folder or one file), each once."""
    # A file source takes single files only by a pattern.
    pattern = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)


def latest_state(stream: DataFrame, key: str, fields: Sequence[str], ts: str = "ts", event_id: str = "event_id", late: str = "30 days") -> DataFrame:
    """The newest event's fields and the number of events per key.

    An event id that comes again within ``late`` changes nothing; events later
    than that are not taken.
    """
    stream = once(stream, event_id, ts, late)
    newest = F.max_by(F.struct(*fields, F.col(ts).alias("last_ts")), F.struct(ts, event_id)).alias("last")
    return stream.groupBy(key).agg(newest, F.count("*").alias("n_events")).select(key, "last.*", "n_events")


def event_counts(stream: DataFrame, kind: str, *, size: str, slide: str | None = None, late: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Counts by tumbling (or, with ``slide``, sliding) window and kind. State ends ``late`` after a window's end."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    counts = timed.groupBy(F.window(ts, size, slide) if slide else F.window(ts, size), kind).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("window_start"), kind, "n")


def session_counts(stream: DataFrame, key: str, *, gap: str, late: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Events of each session of a key, a session ending after ``gap`` without one.

    For append mode: a session comes once, when the watermark passes its end, and
    leaves the state.
    """
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("session_start"), key, "n")


def usage_counters(stream: DataFrame, key: str, kinds: Sequence[str], kind: str) -> DataFrame:
    """Totals of each kind per key."""
    return stream.groupBy(key).agg(F.count("*").alias("uses"), *(F.count_if(F.col(kind) == k).alias(k) for k in kinds))


def import_status(stream: DataFrame, key: str, failure: Column) -> DataFrame:
    """(key, status, reason) of each new source row."""
    return stream.select(key, F.when(failure.isNotNull(), "failed").otherwise("processed").alias("status"), failure.alias("reason"))


def run(out: DataFrame, folder: str, *, mode: str = "update") -> None:
    """Takes all that is new into ``folder``, and ends. Called again, it goes on where it ended."""
    table = f"{folder}/table"
    spark = out.sparkSession
    first = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/batch=-1")
    if not first.getFileSystem(spark._jsc.hadoopConfiguration()).exists(first):  # so that a stream without rows has a table too
        spark.createDataFrame([], out.schema).write.parquet(f"{table}/batch=-1")

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={n}")

    out.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()


def appended(spark: SparkSession, folder: str) -> DataFrame:
    """All rows that run() wrote in append mode."""
    return spark.read.parquet(f"{folder}/table").drop("batch")


def newest(spark: SparkSession, folder: str, keys: Sequence[str]) -> DataFrame:
    """The newest row of each key that run() wrote in update mode."""
    rows = spark.read.parquet(f"{folder}/table")
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("row")).select(*keys, "row.*")


def closing_event(spark: SparkSession, path: str, folder: str, *, after: str, ts: str = "ts") -> DataFrame:
    """A stream of one event ``after`` the newest under a path, with nulls but for its time: unioned with it, it lets the watermark pass all others."""
    rows = spark.read.parquet(path)
    last = rows.agg((F.max(F.col(ts).cast("timestamp")) + F.expr(f"INTERVAL {after}")).cast(rows.schema[ts].dataType).alias(ts))
    last.select(*(F.col(ts) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema)).write.parquet(folder)
    return spark.readStream.schema(rows.schema).parquet(folder)


def unfinished(states: DataFrame, kind: str, final: Sequence[str], timeout: str, ts: str = "last_ts") -> DataFrame:
    """Adds ``finished`` and ``timed_out``: not finished, and older than the newest state by more than ``timeout``."""
    now = states.agg(F.max(ts).alias("now"))  # one row
    done = F.col(kind).isin(list(final))
    late = F.col(ts) < F.col("now") - F.expr(f"INTERVAL {timeout}")
    return states.join(F.broadcast(now), F.lit(True), "left").withColumns({"finished": done, "timed_out": ~done & F.coalesce(late, F.lit(False))}).drop("now")

"""Readers, writers and streams over small files."""

import hashlib

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallyforge.sources import tables
from tallyforge.sources._folder import new_folder
from tallyforge.streaming import events


def test_document_store_hashes_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "One File.txt").write_bytes(b"alpha")
    (tmp_path / "deep" / "two.txt").write_bytes(b"alpha")
    got = {r["slug"]: r["sha"] for r in tables.read_document_store(spark, str(tmp_path)).collect()}
    assert got == dict.fromkeys(("one_file", "two"), hashlib.sha256(b"alpha").hexdigest())
    assert tables.read_document_store(spark, str(tmp_path), recursive=False).count() == 1


def test_catalog_header_must_match(spark, tmp_path):
    (tmp_path / "c.csv").write_text("name,label\na,b\n")
    records, _ = tables.read_catalog_csv(spark, str(tmp_path), spark.createDataFrame([], "name string, brand string").schema, required=["name"], identity=["name"])
    with pytest.raises((PySparkException, Py4JJavaError)):
        records.collect()


def test_import_skips_what_is_done_unless_forced(spark):
    source = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id long, text string")
    done = spark.createDataFrame([(1, "processed"), (3, "failed")], "id long, status string")
    failure = F.when(F.col("text").isNull(), "no text")
    status = lambda **o: {r["id"]: r["status"] for r in tables.incremental_import(source, done, "id", failure, **o).collect()}
    assert status() == {1: "skipped", 2: "failed", 3: "processed"}
    assert status(force=True) == {1: "processed", 2: "failed", 3: "processed"}


def test_existing_output_is_left_alone(spark):
    path = new_folder(spark, "ignore")
    tables.write_if_absent(spark.range(3), path)
    tables.write_if_absent(spark.range(9), path)
    assert spark.read.parquet(path).count() == 3


def test_stream_goes_on_where_it_ended(spark):
    rows = "user long, kind string, event_id long, ts timestamp_ntz"
    path, folder = new_folder(spark, "in"), new_folder(spark, "out")
    first = [(1, "view", 1, "2024-01-01 00:00:00"), (2, "buy", 2, "2024-01-02 00:00:00")]
    later = [(1, "buy", 3, "2024-01-03 00:00:00")]
    for part in (first, later):
        spark.createDataFrame([(a, b, c) for a, b, c, _ in part], "user long, kind string, event_id long").join(
            spark.createDataFrame([(c, d) for _, _, c, d in part], "event_id long, at string"), "event_id"
        ).select("user", "kind", "event_id", F.col("at").cast("timestamp_ntz").alias("ts")).coalesce(1).write.mode("append").parquet(path)
        stream = events.read_stream(spark, path)
        assert stream.schema.simpleString() == spark.createDataFrame([], rows).schema.simpleString()
        events.run(events.latest_state(stream, "user", ["kind"]), folder)
    got = {r["user"]: (r["kind"], r["n_events"]) for r in events.newest(spark, folder, ["user"]).collect()}
    assert got == {1: ("buy", 2), 2: ("buy", 1)}
    states = events.unfinished(events.newest(spark, folder, ["user"]), "kind", ["view"], "12 HOURS")
    assert {r["user"]: r["timed_out"] for r in states.collect()} == {1: False, 2: True}


def test_versions_are_numbered_across_ranges(spark):
    rows = spark.createDataFrame([(k, "same" if k % 3 else "Other one") for k in range(40)], "id long, name string")
    found = {r["id"]: r["version_slug"] for r in tables.version_slugs(rows, F.col("name"), "id", width=7).collect()}
    same = [k for k in range(40) if k % 3]
    assert [found[k] for k in same] == ["same"] + [f"same-v{i}" for i in range(2, len(same) + 1)]
    assert found[0] == "other_one" and found[39] == "other_one-v14"

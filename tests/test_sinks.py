"""Sinks over repeated and half-written batches, and the order of reading files."""

import pytest
from pyspark.sql import functions as F

from flowsight.operators import features as ft
from flowsight.sources import flows as fl, tables
from flowsight.streaming import sinks
from tests.test_features import SCHEMA, random_flows


def test_a_batch_counts_once_and_whole(spark, tmp_path):
    path = str(tmp_path / "sink")
    rows = spark.range(10).withColumn("v", F.col("id") * 2)
    for batch in (0, 1, 2):
        sinks.put_batch(rows.filter(F.col("id") % 3 == batch), path, batch)
    before = sinks.read_committed(spark, path, rows.schema)
    sinks.put_batch(rows.filter("id % 3 = 1 AND id > 4"), path, 1)  # tried again, with other rows
    sinks.write_attempt(rows, path, 2)
    sinks.write_attempt(rows, path, 3)
    assert sorted(r.id for r in sinks.read_committed(spark, path, rows.schema).collect()) == [0, 2, 3, 5, 6, 7, 8, 9]
    assert sorted(r.id for r in before.collect()) == list(range(10))  # as it was listed
    sinks.write_version(rows, str(tmp_path / "table"))
    sinks.write_version(rows.limit(0), str(tmp_path / "table"))
    assert sinks.read_committed(spark, str(tmp_path / "table"), rows.schema).count() == 0


def test_a_stream_that_fails_in_a_batch_loses_and_doubles_nothing(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "sink")
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(source)
    failures = [True]

    def put(rows, batch):
        attempt = sinks.write_attempt(rows, path, batch)
        if batch == 1 and failures:
            failures.pop()
            raise RuntimeError("lost")
        sinks.commit(rows.sparkSession, path, batch, attempt)
        if batch == 2 and not failures:
            failures.append(True)
            failures.append(True)
            raise RuntimeError("lost after the commit")

    def run(function):
        stream.writeStream.foreachBatch(function).option("checkpointLocation", f"{path}-c").trigger(availableNow=True).start().awaitTermination()

    for function in (put, put, lambda rows, batch: sinks.put_batch(rows, path, batch)):
        try:
            run(function)
        except Exception as error:
            assert "lost" in str(error)
    found = sinks.read_committed(spark, path, stream.schema)
    assert sorted(r.id for r in found.collect()) == list(range(30))


def test_split_folders(spark, tmp_path):
    parts = spark.createDataFrame([("a", 1.0, "train"), ("b", 2.0, "test"), ("c", 3.0, "test")], "source_file string, x double, part string")
    for _ in range(2):
        tables.write_split(parts, str(tmp_path), parts.filter("part = 'train'").select("x"))
    assert [r.x for r in spark.read.parquet(str(tmp_path / "train")).collect()] == [1.0]
    held = spark.read.parquet(str(tmp_path / "holdout"))
    assert sorted((r.source_file, r.x) for r in held.collect()) == [("b", 2.0), ("c", 3.0)]


def events(spark, rows):
    return fl.as_events(spark.createDataFrame(rows, SCHEMA))


@pytest.mark.parametrize("files", [1, 4])
def test_reading_order_does_not_depend_on_files(spark, tmp_path, files):
    rows = random_flows(31, 300)
    path = str(tmp_path / "events")
    for i in range(files):
        own = rows[i * len(rows) // files : (i + 1) * len(rows) // files]
        events(spark, own).coalesce(1).write.mode("append").json(path)
    for size in ("134217728", "2000"):
        old = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            read = fl.read_flows(spark, path).orderBy("arrival_seq").collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        assert len({r.arrival_seq for r in read}) == 300
        assert [(r.ts, r.src) for r in read] == [(r[2].replace(tzinfo=None), r[3]) for r in rows]
    flows = fl.read_flows(spark, path).withColumn("sensor_id", F.col("sensor_id").cast("long"))
    indexed = ft.assign_arrival_windows(flows, ft.sensor_anchors(flows), 10)
    given = spark.createDataFrame([(r[0], i, *r[2:]) for i, r in enumerate(rows)], SCHEMA)
    wanted = ft.assign_arrival_windows(given, ft.sensor_anchors(given), 10)
    columns = ["sensor_id", "ts", "src", "window_index"]
    assert indexed.select(columns).exceptAll(wanted.select(columns)).isEmpty()


def test_rejected_lines(spark):
    good = events(spark, random_flows(1, 1)).toJSON().first()
    lines = [good, "", "  ", good[:30], "[1]", "7", '{"event_type": "dns"}', '{"event_type": "flow"}', '{"src_ip": "x"}', '{"event_type": "flow", "timestamp": "soon"}']
    found = fl.rejected_lines(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert sorted((r.value, r.reason) for r in found.collect()) == sorted(
        [(good[:30], "broken line"), ("[1]", "broken line"), ("7", "broken line"), (lines[6], "not a flow"),
         (lines[7], "no timestamp"), (lines[8], "no event type"), (lines[9], "unreadable timestamp")]
    )

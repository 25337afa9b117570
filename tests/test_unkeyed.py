"""Flows without a sensor: one implicit stream when read, and null keys that no join drops."""

import json

import pytest
from pyspark.sql import functions as F

from flowsight.operators import enrich, features, policy
from flowsight.schema import Policy
from flowsight.sources.flows import DEFAULT_SENSOR, read_flows


def line(i):
    return json.dumps(
        {
            "event_type": "flow",
            "timestamp": f"2024-01-01T00:{i // 60:02d}:{i % 60:02d}Z",
            "src_ip": f"10.0.0.{i % 5}",
            "dest_ip": "10.1.0.1",
            "proto": "tcp",
            "flow": {"bytes_toserver": i, "bytes_toclient": 1, "pkts_toserver": 1, "pkts_toclient": 1, "state": "new"},
        }
    )


@pytest.fixture
def flows(spark, tmp_path):
    (tmp_path / "eve.json").write_text("\n".join(line(i) for i in range(400)))
    return read_flows(spark, str(tmp_path / "eve.json"))


def both(flows):
    """The flows of the implicit sensor, and the same with a null sensor."""
    return flows, flows.withColumn("sensor_id", F.lit(None).cast("string"))


def test_read_flows_belong_to_the_default_sensor(flows):
    assert {r.sensor_id for r in flows.collect()} == {DEFAULT_SENSOR}


def test_decisions(flows):
    for rows in both(flows):
        windows = features.window_features(rows, "10 seconds").withColumn("score", F.lit(0.99))
        assert windows.count() == 40
        decided = policy.decide(windows, Policy(), chunk_rows=7).collect()
        assert len(decided) == 40
        assert sorted(r["index"] for r in decided) == list(range(40))


def test_windows_gaps_and_context(flows):
    for rows in both(flows):
        anchors = rows.groupBy("sensor_id").agg(F.min("ts").alias("anchor"))
        anchored = features.assign_anchored_windows(rows, anchors, 10)
        assert anchored.count() == 400
        arrived = features.assign_arrival_windows(rows, anchors, 10, bucket_rows=9)
        assert arrived.count() == 400
        assert features.closed_windows(features.window_features(rows, "10 seconds")).count() == 39
        gaps = [r.gap_sec for r in features.interarrival_gaps(rows, 60).collect()]
        assert sorted(gaps, key=lambda g: (g is not None, g)) == [None] + [1.0] * 399
        context = features.window_features(rows, "60 seconds").select("sensor_id", "window_end", "top_src_ip")
        known = enrich.attach_context_asof(
            rows.select("sensor_id", "ts"), context, context_at="window_end", bucket_sec=100
        ).collect()
        assert len(known) == 400
        assert sum(r.context_at is None for r in known) == 60


def test_policy_of_the_null_sensor(spark):
    rows = spark.createDataFrame([(None, 0.5), ("a", 0.5)], "sensor_id string, score double")
    table = spark.createDataFrame([(None, 0.1), ("a", 0.9)], "sensor_id string, threshold double")
    out = {r.sensor_id: r.threshold for r in policy.attach_policy(rows, table).collect()}
    assert out == {None: 0.1, "a": 0.9}


def test_no_threat_without_a_source(spark):
    rows = spark.createDataFrame([(None,), ("",), ("45.33.22.11",)], "top_src_ip string")
    out = {r.top_src_ip: r.threat for r in enrich.enrich_threat(rows).collect()}
    assert out[None] is None and out[""] is None
    assert out["45.33.22.11"].threat == "Mass Scanner"


def test_building_plans_starts_no_job(spark, flows):
    tracker, group = spark.sparkContext.statusTracker(), "plans-only"
    spark.sparkContext.setJobGroup(group, "building")
    anchors = flows.groupBy("sensor_id").agg(F.min("ts").alias("anchor"))
    features.assign_arrival_windows(flows, anchors, 10)
    features.closed_windows(features.window_features(flows, "10 seconds"))
    policy.decide(features.window_features(flows, "10 seconds").withColumn("score", F.lit(0.99)))
    assert list(tracker.getJobIdsForGroup(group)) == []
    spark.sparkContext.setJobGroup("other", "")

import json
from datetime import datetime, timezone

from pyspark.sql import functions as F

from flowsight.sources import flows as src


def write(path, lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


LINES = [
    json.dumps(
        {
            "event_type": "flow",
            "timestamp": "2024-01-01T00:00:00.5+0000",
            "src_ip": "1.1.1.1",
            "dest_ip": "2.2.2.2",
            "proto": "tcp",
            "app_proto": "HTTP",
            "flow": {"bytes_toserver": 10, "pkts_toserver": 1, "state": "new"},
        }
    ),
    "{broken",
    "[1, 2]",
    "",
    json.dumps({"event_type": "alert", "timestamp": "2024-01-01T00:00:00Z"}),
    json.dumps({"event_type": "flow", "timestamp": "2024-01-01T02:00:00+02:00", "flow": None}),
    json.dumps({"event_type": "flow", "timestamp": "yesterday", "flow": {}}),
    json.dumps({"event_type": "flow", "timestamp": "2024"}),
    json.dumps({"event_type": "flow", "src_ip": "3.3.3.3"}),
]


def test_flow_scan_keeps_only_timed_flows(spark, tmp_path):
    rows = src.read_flows(spark, write(tmp_path / "eve.json", LINES)).orderBy(F.desc("src")).collect()
    assert len(rows) == 2
    first, second = rows
    assert (first.src, first.proto, first.app_proto, first.state) == ("1.1.1.1", "TCP", "http", "new")
    assert (first.bytes_toserver, first.bytes_toclient, first.pkts_toclient) == (10, 0, 0)
    assert (second.src, second.proto, second.state, second.bytes_toserver) == (None, "", "", 0)
    midnight = datetime(2024, 1, 1, tzinfo=timezone.utc).timestamp()
    seconds = [r.s for r in src.read_flows(spark, str(tmp_path / "eve.json")).select(F.unix_micros("ts").alias("s")).collect()]
    assert sorted(seconds) == [midnight * 1e6, midnight * 1e6 + 500_000]


def test_lenient_scan_keeps_untimed_flows(spark, tmp_path):
    path = write(tmp_path / "eve.json", LINES)
    rows = src.read_flows(spark, path, on_bad_ts="now").collect()
    assert len(rows) == 5
    assert all(r.ts is not None for r in rows)
    assert sorted(r.src for r in rows) == ["0.0.0.0", "0.0.0.0", "0.0.0.0", "1.1.1.1", "3.3.3.3"]
    assert [(r.bytes_total, r.pkts_total, r.is_syn) for r in rows if r.src == "1.1.1.1"] == [(10, 1, 0)]


def test_single_events_become_feature_rows(spark, tmp_path):
    lines = [
        json.dumps({"pktcnt": 4, "packet_count": 9, "bytecnt": 1001, "tcp": {"flags": "S"}}),
        json.dumps({"packet_count": 2, "bytes": 1}),
        json.dumps({"tcp": {}}),
        "nonsense",
    ]
    df = src.event_to_features(src.read_simple_events(spark, write(tmp_path / "e.json", lines)))
    rows = sorted(
        (r.pkts_total, r.bytes_total, r.mean_bytes_flow, r.syn_ratio, r.tcp_ratio) for r in df.collect()
    )
    assert rows == [(1, 200, 200, 0.1, 1.0), (2, 1, 1, 0.1, 0.0), (4, 1001, 250, 1.0, 1.0)]


def test_events_survive_a_round_trip(spark, sf_dir, tmp_path):
    from flowsight.plans import adapters

    flows = adapters.flows(spark, sf_dir).withColumn("sensor_id", F.col("sensor_id").cast("string"))
    src.as_events(flows).write.json(str(tmp_path / "events"))
    back = src.read_flows(spark, str(tmp_path / "events")).drop("arrival_seq")
    assert back.exceptAll(flows.select(back.columns)).isEmpty()
    assert back.count() == flows.count()

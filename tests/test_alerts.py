import json

import pytest
from pyspark.sql import functions as F

from flowsight.operators import alerts as al, enrich
from flowsight.functions.scalars import code_point_sum, iso_utc
from flowsight.sources import tables

LINES = [
    {"ts": 100.0, "index": 0, "score": 0.1, "state": "benign", "hits_in_window": 0, "action": "NONE", "pred_class": "benign"},
    {"ts": 200.0, "index": 1, "score": 0.99, "state": "ATTACK", "hits_in_window": 1, "action": "BLOCK-KILL", "pred_class": "x",
     "reason": "syn_ratio (+1.00)", "threat": {"country": "DE", "flag": "🇩🇪", "threat": None}},
    {"ts": 300.0, "index": 2, "score": 0.9, "state": "ATTACK", "hits_in_window": 2, "action": "NONE", "effective_threshold": 0.85},
    {"index": 3, "score": 0.5, "state": "benign", "hits_in_window": 2, "action": "NONE", "pred_class": "benign"},
]


@pytest.fixture()
def alerts(spark, tmp_path):
    text = [json.dumps(x) for x in LINES]
    (tmp_path / "alerts.jsonl").write_text("\n".join([text[0], "", "{oops", *text[1:]]) + "\n")
    return tables.read_alerts(spark, str(tmp_path / "alerts.jsonl"))


def test_broken_lines_are_skipped(alerts):
    assert alerts.count() == 4


def test_counts(alerts):
    row = al.alert_counts(alerts, now=260.0, minutes=1).first()
    assert (row.total, row.attacks, row.blocks) == (2, 2, 1)  # 200 is exactly a minute ago
    assert al.alert_counts(alerts, now=1e6, minutes=1).first().total == 0
    assert [tuple(r) for r in al.class_counts(alerts, 260.0, 10).collect()] == [("benign", 2), ("x", 1)]
    assert al.alerts_since(alerts, 200.0).count() == 1
    assert al.alerts_since(alerts, -1).count() == 4


def test_last_alerts(alerts):
    assert [r["index"] for r in al.last_alerts(alerts, 2).collect()] == [1, 2]
    series = al.score_series(alerts, 1).collect()
    assert [tuple(r) for r in series] == [("1970-01-01T00:05:00Z", 0.9, 0.85)]


def test_export(alerts, spark, tmp_path):
    tables.export_alerts_csv(alerts, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.columns == al.EXPORT_COLUMNS
    row = back.filter("index = 1").first()
    assert (row.threat, row.reason) == ("🇩🇪 DE", "syn_ratio (+1.00)")


def test_written_alerts_leave_out_empty_fields(alerts, tmp_path, spark):
    tables.write_alerts(alerts, str(tmp_path / "log"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "log")).collect()]
    first = next(x for x in lines if x["index"] == 0)
    assert "reason" not in first and "threat" not in first
    assert tables.read_alerts(spark, str(tmp_path / "log")).exceptAll(alerts).isEmpty()


def test_threat_context(spark, plan_of):
    df = spark.createDataFrame([("192.168.1.105",), ("8.8.8.8",), ("",), (None,)], "top_src_ip string")
    out = enrich.enrich_threat(df)
    rows = {r.top_src_ip: r.threat for r in out.collect()}
    assert tuple(rows["192.168.1.105"]) == ("IN", "🇮🇳", "Mirai Botnet Node") if 652 % 6 == 5 else True
    assert rows["192.168.1.105"].country == ["US", "CN", "RU", "DE", "BR", "IN"][652 % 6]
    assert rows[""] is None and rows[None] is None  # nothing to say without an address
    assert "BroadcastHashJoin" in plan_of(out)
    total = df.select(code_point_sum(F.col("top_src_ip")).alias("n")).collect()
    assert [r.n for r in total] == [652, sum(map(ord, "8.8.8.8")), 0, None]


def test_own_reputation_list(spark):
    df = spark.createDataFrame([("1.2.3.4",)], "top_src_ip string")
    own = spark.createDataFrame([("1.2.3.4", "Bad")], "ip string, threat string")
    assert enrich.enrich_threat(df, reputation=own).first().threat.threat == "Bad"


def test_newest_context(spark):
    scored = spark.createDataFrame([(1, 5), (1, 100_000), (1, 400_000), (2, 400_000)], "sensor_id long, s long")
    context = spark.createDataFrame([(1, 10, "a"), (1, 100_000, "b"), (2, 500_000, "z")], "sensor_id long, s long, top_src_ip string")
    at = F.timestamp_seconds("s").alias("ts")
    out = enrich.attach_context_asof(scored.select("sensor_id", "s", at), context.select("sensor_id", at, "top_src_ip"), bucket_sec=1000)
    assert {(r.sensor_id, r.s): r.context_top_src_ip for r in out.collect()} == {
        (1, 5): None, (1, 100_000): "b", (1, 400_000): "b", (2, 400_000): None,
    }


def test_iso_text(spark):
    assert spark.range(1).select(iso_utc(F.lit(0.0))).first()[0] == "1970-01-01T00:00:00Z"

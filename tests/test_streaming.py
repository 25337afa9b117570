import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowsight.operators import features as ft, policy as po
from flowsight.plans import adapters
from flowsight.schema import FEATURES, Policy
from flowsight.sources import tables
from flowsight.sources.flows import as_events, read_flows_stream
from flowsight.streaming import arrival as sa, decisions as sd, features as sf
from tests.test_features import SCHEMA, flow, random_flows

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


class Feed:
    """A folder that receives files, and a query run over it until it is read."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema = spark, folder, schema
        self.number = 0

    def put(self, rows):
        df = rows if hasattr(rows, "write") else self.spark.createDataFrame(rows, self.schema)
        df.coalesce(1).write.mode("append").parquet(str(self.folder / "in"))

    def stream(self):
        schema = self.spark.createDataFrame([], self.schema).schema if isinstance(self.schema, str) else self.schema
        return self.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(self.folder / "in"))

    def run(self, result, name="out"):
        job = (
            result.writeStream.option("checkpointLocation", str(self.folder / f"{name}-checkpoint"))
            .trigger(availableNow=True)
            .format("parquet")
            .outputMode("append")
            .start(str(self.folder / name))
        )
        job.awaitTermination()
        return self.spark.read.schema(result.schema).parquet(str(self.folder / name))


def test_windows_over_restarts_equal_the_batch(spark, tmp_path):
    rows = random_flows(11, 300)
    feed = Feed(spark, tmp_path, SCHEMA)
    for part in (rows[:100], rows[100:220], rows[220:]):
        feed.put(part)
        out = feed.run(sf.stream_window_features(feed.stream(), lateness="0 seconds"))
    df = spark.createDataFrame(rows, SCHEMA)
    newest = max(r[2] for r in rows)
    batch = ft.window_features(df).filter(F.col("window_end") <= F.lit(newest))
    assert out.count() == batch.count() > 10
    assert out.exceptAll(batch).isEmpty()


def test_trailing_state_is_few_values_a_slice(spark, tmp_path):
    feed = Feed(spark, tmp_path, SCHEMA)
    feed.put([flow(i, i % 30) for i in range(300)])
    result = sf.stream_trailing_features(feed.stream(), 30, lateness="0 seconds")
    job = result.writeStream.option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).format("noop").start()
    job.awaitTermination()
    rows = max(s["numRowsUpdated"] for p in job.recentProgress for s in p["stateOperators"])
    # 30 different times in each of two slices, and the sums of a slice in one value
    assert rows <= 2 * (30 + 1)


def test_json_lines_of_a_batch_lie_in_files_of_bounded_size(spark, sf_dir, monkeypatch):
    from flowsight.plans import streaming_queries as sq

    monkeypatch.setattr(sq, "FILE_LINES", 100)
    asked, read = [], sq.read_events_stream
    monkeypatch.setattr(sq, "read_events_stream", lambda spark, path, files_per_trigger: asked.append((path, files_per_trigger)) or read(spark, path, files_per_trigger=files_per_trigger))
    flows = adapters.flows(spark, sf_dir).count()
    assert sq.stream_json_trailing(spark, sf_dir).count() == flows
    (path, files), = asked
    assert files == -(-flows // 300) > 1
    assert len(spark.read.text(path).inputFiles()) == 3 * files


def test_feature_stream_keeps_flows_once_until_their_window_closes(spark, tmp_path):
    feed = Feed(spark, tmp_path, SCHEMA)
    feed.put(random_flows(21, 200))
    result = sf.stream_window_features(feed.stream(), lateness="0 seconds")
    job = result.writeStream.option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).format("noop").start()
    job.awaitTermination()
    kept = [[s["numRowsUpdated"] for s in p["stateOperators"]] for p in job.recentProgress]
    # a state of sources and protocols and one of windows, with none of finer rows before them
    assert kept and all(len(state) == 2 for state in kept)


def test_late_flows_within_the_allowance_count(spark, tmp_path):
    feed = Feed(spark, tmp_path, SCHEMA)
    feed.put([flow(0, 1), flow(1, 12)])
    feed.put([flow(2, 3)])  # late, its window is still open
    feed.put([flow(3, 60)])
    feed.put([flow(4, 61)])  # flows are checked against the watermark of the batch before
    feed.put([flow(5, 2)])  # too late
    out = feed.run(sf.stream_window_features(feed.stream(), lateness="20 seconds"))
    counts = {r.window_start.astimezone(timezone.utc).second: r.flows for r in out.collect()}
    assert counts == {0: 2, 10: 1}


def test_trailing_features_over_restarts(spark, tmp_path):
    rows = random_flows(12, 240)
    feed = Feed(spark, tmp_path, SCHEMA)
    for part in (rows[:80], rows[80:81], rows[81:]):
        feed.put(part)
        out = feed.run(sf.stream_trailing_features(feed.stream(), 30, lateness="5 seconds"))
    batch = ft.trailing_features(spark.createDataFrame(rows, SCHEMA), 30)
    stream = {r.arrival_seq: r for r in out.collect()}
    assert len(stream) == 240
    by_seq = {r[1]: r for r in rows}
    for r in batch.collect():
        # A stream cannot see flows of the same instant that come in a later file.
        peers = [o for o in rows if o[0] == r.sensor_id and o[2] == by_seq[r.arrival_seq][2] and o[1] > r.arrival_seq]
        part = lambda seq: (seq >= 80) + (seq >= 81)
        if all(part(o[1]) == part(r.arrival_seq) for o in peers):
            assert tuple(stream[r.arrival_seq]) == tuple(r)


class Stored:
    """A map state that counts what is read from it."""

    def __init__(self):
        self.values, self.read = {}, 0

    def iterator(self):
        return iter(self.values.items())

    def containsKey(self, key):
        return key in self.values

    def getValue(self, key):
        self.read += len(self.values[key][0])
        return self.values[key]

    def updateValue(self, key, value):
        self.values[key] = value


def test_a_batch_reads_only_the_edges_it_needs():
    seconds, rng = 64, np.random.default_rng(1)
    processor = sf.TrailingWindow("k", seconds)
    processor.sums, processor.flows = Stored(), Stored()
    processor.handle = type("Handle", (), {"registerTimer": lambda self, at: None})()
    columns = ["at", "arrival_seq", "bytes", "pkts", "syn", "own"]
    at = np.sort(rng.integers(-seconds * 10**6, seconds * 10**6, 6400))
    history = pd.DataFrame(np.column_stack([at, np.arange(6400), rng.integers(0, 10**12, 6400), np.ones(6400), np.zeros(6400)]).astype("int64"), columns=columns[:-1])
    history["own"] = False
    list(processor.handleInputRows(("s", 0), iter([history]), None))
    assert len(processor.sums.values) == 128
    processor.flows.read = 0
    late = pd.DataFrame([(30_500_000, 6400, 7, 1, 1, True), (30_600_000, 6401, 8, 2, 0, True)], columns=columns)
    out = pd.concat(processor.handleInputRows(("s", 0), iter([late]), None))
    assert processor.flows.read <= 150  # two sub-slices of about fifty flows, of 6400
    for r in out.itertuples():
        seen = pd.concat([history, late])
        seen = seen[(seen["at"] <= r.at) & (seen["at"] >= r.at - seconds * 10**6)]
        assert (r.n, r.bytes, r.pkts, r.syn) == (len(seen), seen["bytes"].sum(), seen["pkts"].sum(), seen["syn"].sum())
        assert r.std == pytest.approx(seen["bytes"].astype(float).std())


def scored(spark, n):
    rows = []
    for sensor in (1, 2):
        for i in range(n):
            score = ((i * 37 + sensor * 11) % 100) / 100 * 0.4 + 0.599
            at = START + timedelta(seconds=10 * i)
            rows.append((sensor, at, at + timedelta(seconds=10), round(score, 3), "1.1.1.1", *([0.0] * len(FEATURES))))
    schema = "sensor_id long, window_start timestamp, window_end timestamp, score double, top_src_ip string, "
    return spark.createDataFrame(rows, schema + ", ".join(f"{c} double" for c in FEATURES))


@pytest.mark.parametrize("policy", [Policy(cooldown_sec=35), Policy(cooldown_sec=35, use_adaptive=True, adaptive_window=12, adaptive_sensitivity=0.2, threshold=0.7)])
def test_decisions_over_restarts_equal_the_batch(spark, tmp_path, policy):
    rows = scored(spark, 60)
    feed = Feed(spark, tmp_path, rows.schema)
    for low, high in [(0, 25), (25, 26), (26, 60)]:
        part = rows.filter((F.col("window_start") >= F.lit(START + timedelta(seconds=10 * low))) & (F.col("window_start") < F.lit(START + timedelta(seconds=10 * high))))
        feed.put(part)
        out = feed.run(sd.decide_stream(feed.stream(), policy))
    wanted = po.decide(rows, policy)
    columns = ["sensor_id", "index", "severity", "action", "hits_in_window", "no_block_reason", "state", "pred_class"]
    assert out.count() == 120
    assert out.select(columns).exceptAll(wanted.select(columns)).isEmpty()


@pytest.mark.parametrize("policy", [Policy(cooldown_sec=35), Policy(cooldown_sec=35, use_adaptive=True, adaptive_window=12, adaptive_sensitivity=0.2, threshold=0.7)])
def test_rows_wait_for_earlier_ones(spark, tmp_path, policy):
    rows = scored(spark, 60)
    feed = Feed(spark, tmp_path, rows.schema)
    number = F.unix_seconds("window_start") / 10 % 60
    # two files change places, single rows come a file late, and the last file moves the time on
    place = F.when(number.between(15, 24), 2).when(number.between(25, 34), 1).otherwise(F.when(number < 15, 0).otherwise(3))
    place = F.when(number % 7 == 3, F.least(place + 1, F.lit(3))).otherwise(place)
    for i in range(4):
        feed.put(rows.filter(place == i))
        out = feed.run(sd.decide_stream(feed.stream(), policy, lateness="300 seconds"))
    columns = ["sensor_id", "index", "severity", "action", "hits_in_window", "no_block_reason", "state", "pred_class", "window_start"]
    wanted = po.decide(rows, policy).filter(F.col("window_start") < F.lit(START + timedelta(seconds=290)))
    assert out.count() == wanted.count() == 58
    assert out.select(columns).exceptAll(wanted.select(columns)).isEmpty()
    assert out.filter("out_of_order").isEmpty()


def test_rows_too_late_are_decided_and_marked(spark, tmp_path):
    rows = scored(spark, 40)
    feed = Feed(spark, tmp_path, rows.schema)
    early = F.col("window_start") < F.lit(START + timedelta(seconds=50))
    for part in (~early, early):
        feed.put(rows.filter(part))
        feed.run(sd.decide_stream(feed.stream(), Policy(), lateness="20 seconds"), "waited")
        feed.run(sd.decide_stream(feed.stream(), Policy()), "at-once")
    for name, decided in (("waited", 2 * (32 + 5)), ("at-once", 80)):
        out = spark.read.parquet(str(tmp_path / name))
        assert out.count() == decided
        assert out.filter("out_of_order").count() == 10
        late = out.filter("out_of_order").select("sensor_id", "window_start")
        assert late.exceptAll(rows.filter(early).select("sensor_id", "window_start")).isEmpty()
        assert {r.n for r in out.groupBy("sensor_id").agg(F.count_distinct("index").alias("n")).collect()} == {decided // 2}


def test_running_arrays_equal_loops():
    rng = np.random.default_rng(3)
    scores, before = rng.random(50).round(3), rng.random(7)
    frame, weight = rng.choice([1, 5, 11, 20, 90], 50), rng.random(50)
    got = po.lifted_thresholds(scores, before, frame, weight)
    hits = po.running_hits((scores > 0.5).astype(int), (before > 0.5).astype(int), frame)
    for i in range(50):
        seen = np.concatenate([before, scores])[: 7 + i + 1][-frame[i] :]
        assert hits[i] == (seen > 0.5).sum()
        assert got[i] == (pytest.approx(seen.mean() + weight[i] * seen.std()) if len(seen) > 10 else -np.inf)


def test_arrival_windows_over_restarts_equal_the_batch(spark, tmp_path):
    rows = random_flows(21, 400)
    rng = random.Random(5)
    rows = [(r[0], i, *r[2:]) for i, r in enumerate(sorted(rows, key=lambda r: r[1] + rng.choice([0, 0, 0, 90])))]
    feed = Feed(spark, tmp_path, SCHEMA)
    for part in (rows[:1], rows[1:150], rows[150:151], rows[151:330], rows[330:]):
        feed.put(list(reversed(part)))  # the order in a file does not matter, arrival_seq does
        out = feed.run(sa.stream_arrival_features(feed.stream(), 10))
    df = spark.createDataFrame(rows, SCHEMA)
    batch = ft.window_features_by(ft.assign_arrival_windows(df, ft.sensor_anchors(df), 10), 10, drop_open=True)
    assert out.count() == batch.count() > 20
    assert out.select(batch.columns).exceptAll(batch).isEmpty()
    by_time = ft.window_features(df)
    assert by_time.count() != batch.count()


def test_policy_is_read_for_every_batch(spark, tmp_path):
    rows = scored(spark, 4)
    feed = Feed(spark, tmp_path, rows.schema)
    policies = iter([Policy(threshold=0.5), Policy(threshold=0.9)])
    for _ in range(2):
        feed.put(rows)
        writer = sd.attach_policy_each_batch(feed.stream(), lambda s: next(policies), str(tmp_path / "with_policy"))
        writer.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    stored = spark.read.parquet(str(tmp_path / "with_policy"))
    assert {(r.batch, r.threshold) for r in stored.select("batch", "threshold").distinct().collect()} == {(0, 0.5), (1, 0.9)}
    carried = spark.readStream.schema(stored.schema).parquet(str(tmp_path / "with_policy"))
    assert Feed(spark, tmp_path, None).run(sd.decide_stream(carried, None), "decided").count() == 16


def test_repeated_windows_are_decided_once(spark, tmp_path):
    rows = scored(spark, 5)
    feed = Feed(spark, tmp_path, rows.schema)
    feed.put(rows)
    feed.put(rows)
    assert feed.run(sf.once_per_window(feed.stream())).count() == 10


def test_incomplete_input_waits(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = read_flows_stream(spark, str(tmp_path / "in"))
    feed = Feed(spark, tmp_path, None)
    out = feed.run(sf.stream_window_features(stream.withColumn("arrival_seq", F.lit(0)), lateness="0 seconds"))
    assert out.count() == 0
    (tmp_path / "in" / "a.json").write_text('{"event_type":"flow"}\n{"src_ip":"x"}\n')
    assert feed.run(sf.stream_window_features(read_flows_stream(spark, str(tmp_path / "in")), lateness="0 seconds")).count() == 0


def test_alert_stream_sinks(spark, sf_dir, tmp_path):
    path = str(tmp_path / "events")
    as_events(adapters.flows(spark, sf_dir)).write.json(path)
    windows = sf.stream_window_features(read_flows_stream(spark, path), "6 hours", lateness="0 seconds")
    job = tables.write_features(windows, "").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start(str(tmp_path / "features"))
    job.awaitTermination()
    stored = tables.read_features_stream(spark, str(tmp_path / "features"), windows.schema)
    from flowsight.operators.alerts import as_alerts

    alerts = as_alerts(sd.decide_stream(stored.withColumn("score", adapters.fixed_score())))
    tables.write_alerts(alerts, "").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start(str(tmp_path / "alerts")).awaitTermination()
    log = tables.read_alerts(spark, str(tmp_path / "alerts"))
    assert log.count() == spark.read.parquet(str(tmp_path / "features")).count() > 0
    assert tables.read_alerts_stream(spark, str(tmp_path / "alerts")).isStreaming


def test_approximate_endpoint_stream(spark, tmp_path):
    feed = Feed(spark, tmp_path, SCHEMA)
    feed.put([flow(0, 1, src="a"), flow(1, 2, src="b"), flow(2, 30)])
    out = feed.run(sf.stream_unique_endpoints(feed.stream(), lateness="0 seconds")).collect()
    assert [(r.uniq_src, r.uniq_dst) for r in out] == [(2, 1)]

import math
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from flowsight.operators import features as ft

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = (
    "sensor_id long, arrival_seq long, ts timestamp, src string, dst string, bytes_toserver long, "
    "bytes_toclient long, pkts_toserver long, pkts_toclient long, state string, proto string, app_proto string"
)


def flow(seq, seconds, sensor=1, src="a", dst="x", size=(10, 5), pkts=(1, 1), state="", proto="TCP", app=""):
    return (sensor, seq, START + timedelta(seconds=seconds), src, dst, *size, *pkts, state, proto, app)


def random_flows(seed, n, sensors=3, hot=0.6, spread=200.0, late=0.0):
    """Flows of which one sensor has most, with equal times and late arrivals mixed in."""
    rng = random.Random(seed)
    rows, clock = [], 0.0
    for seq in range(n):
        clock += rng.choice([0, 0, rng.random() * spread / n * 3])
        at = clock - (rng.random() * 40 if rng.random() < late else 0)
        rows.append(
            flow(
                seq,
                round(max(at, 0.0), 6),
                sensor=1 if rng.random() < hot else rng.randrange(2, 2 + sensors),
                src=rng.choice("abcd"),
                size=(rng.randrange(1000), rng.randrange(1000)),
                state=rng.choice(["SYN_SENT", "ACK", ""]),
            )
        )
    return rows


def test_one_flow_window(spark):
    df = spark.createDataFrame([flow(0, 3, state="established|ACK", app="http")], SCHEMA)
    row = ft.window_features(df).first()
    assert (row.flows, row.bytes_total, row.std_bytes, row.iat_mean) == (1, 15, 0.0, 0.0)
    assert (row.ack_ratio, row.http_ratio, row.protocol_diversity, row.app_protos) == (1.0, 1.0, 2, ["http"])
    assert (row.window_end - row.window_start).total_seconds() == 10


def test_top_source_ties_and_missing_sources(spark):
    rows = [flow(0, 0, src="b"), flow(1, 1, src="a"), flow(2, 2, src=None), flow(3, 3, src=None)]
    assert ft.window_features(spark.createDataFrame(rows, SCHEMA)).first().top_src_ip == "a"
    lonely = spark.createDataFrame([flow(0, 0, src=None)], SCHEMA)
    assert ft.window_features(lonely).first().top_src_ip is None


def test_no_protocols_and_diversity_limit(spark):
    rows = [flow(i, 0, proto="", app="") for i in range(2)]
    row = ft.window_features(spark.createDataFrame(rows, SCHEMA)).first()
    assert (row.protocol_diversity, row.app_protos) == (0, [])
    rows = [flow(i, 0, src=f"s{i}", proto=f"P{i}", app=f"a{i}") for i in range(9)]
    assert ft.window_features(spark.createDataFrame(rows, SCHEMA)).first().protocol_diversity == 12


def test_equal_sizes_have_no_spread(spark):
    big = 10**12 + 1
    rows = [flow(i, i, size=(big, 0)) for i in range(7)]
    assert ft.window_features(spark.createDataFrame(rows, SCHEMA)).first().std_bytes == 0.0


def test_windows_count_every_flow(spark):
    rows = random_flows(3, 500)
    df = spark.createDataFrame(rows, SCHEMA)
    out = ft.window_features(df).collect()
    assert sum(r.flows for r in out) == 500
    for r in out:
        for c in ["syn_ratio", "ack_ratio", "fin_ratio", "rst_ratio", "http_ratio", "tcp_ratio"]:
            assert 0 <= r[c] <= 1


@pytest.mark.parametrize("seed", [1, 2])
def test_trailing_features_match_a_scan(spark, seed):
    rows = random_flows(seed, 400)
    out = ft.trailing_features(spark.createDataFrame(rows, SCHEMA), 30).collect()
    assert len(out) == 400
    by_seq = {r[1]: r for r in rows}
    for r in out:
        me = by_seq[r.arrival_seq]
        near = [o for o in rows if o[0] == me[0] and timedelta(0) <= me[2] - o[2] <= timedelta(seconds=30)]
        sizes = [o[5] + o[6] for o in near]
        mean = sum(sizes) / len(sizes)
        std = math.sqrt(sum((s - mean) ** 2 for s in sizes) / (len(sizes) - 1)) if len(sizes) > 1 else 0.0
        assert (r.flows, r.bytes_total) == (len(near), sum(sizes))
        assert r.std_bytes == pytest.approx(std, abs=0.006)
        syn = sum("SYN" in o[9] for o in near) / len(near)
        assert r.syn_ratio == pytest.approx(syn, abs=1e-6) and r.tcp_ratio == r.syn_ratio


def test_trailing_window_edges(spark):
    # 30 seconds back is inside, a microsecond more is not; slice borders do not matter.
    rows = [flow(0, 0), flow(1, 30), flow(2, 30.000001), flow(3, 59.999999), flow(4, 60), flow(5, 90)]
    out = {r.arrival_seq: r.flows for r in ft.trailing_features(spark.createDataFrame(rows, SCHEMA), 30).collect()}
    assert out == {0: 1, 1: 2, 2: 2, 3: 3, 4: 4, 5: 2}


@pytest.mark.parametrize("seed", [4, 5])
def test_trailing_unique_matches_a_scan(spark, seed):
    rows = random_flows(seed, 300)
    out = ft.trailing_unique(spark.createDataFrame(rows, SCHEMA), "src", 30).collect()
    by_seq = {r[1]: r for r in rows}
    assert len(out) == 300
    for r in out:
        me = by_seq[r.arrival_seq]
        near = {o[3] for o in rows if o[0] == me[0] and timedelta(0) <= me[2] - o[2] <= timedelta(seconds=30)}
        assert r.uniq_src == len(near)


@pytest.mark.parametrize("seed,bucket", [(6, 7), (7, 50), (8, 10_000)])
def test_arrival_windows_match_the_loop(spark, seed, bucket):
    rows = random_flows(seed, 400, late=0.2)
    df = spark.createDataFrame(rows, SCHEMA)
    out = ft.assign_arrival_windows(df, ft.sensor_anchors(df), 10, bucket_rows=bucket)
    found = {r.arrival_seq: r.window_index for r in out.collect()}
    start, current = {}, {}
    for r in rows:
        sensor, seq, at = r[:3]
        start.setdefault(sensor, at)
        current.setdefault(sensor, 0)
        while at >= start[sensor] + timedelta(seconds=10 * (current[sensor] + 1)):
            current[sensor] += 1
        assert found[seq] == current[sensor]


def test_open_window_can_be_dropped(spark):
    df = spark.createDataFrame([flow(0, 0), flow(1, 12), flow(2, 25)], SCHEMA)
    indexed = ft.assign_anchored_windows(df, ft.sensor_anchors(df), 10)
    assert [r.window_index for r in ft.window_features_by(indexed, 10, drop_open=True).orderBy("window_index").collect()] == [0, 1]


def test_gaps_reach_over_slices(spark):
    df = spark.createDataFrame([flow(0, 0), flow(1, 5), flow(2, 100), flow(3, 100)], SCHEMA)
    out = {r.arrival_seq: r.gap_sec for r in ft.interarrival_gaps(df, seconds=10).collect()}
    assert out == {0: None, 1: 5.0, 2: 95.0, 3: 0.0}


def test_busy_window_is_aggregated_before_it_meets(spark, plan_of):
    plan = plan_of(ft.window_features(spark.createDataFrame([flow(0, 0)], SCHEMA)))
    assert "SinglePartition" not in plan
    first_exchange = plan.index("Exchange")
    assert "HashAggregate" in plan[first_exchange:]
    for rows in (
        ft.trailing_features(spark.createDataFrame([flow(0, 0)], SCHEMA)),
        ft.interarrival_gaps(spark.createDataFrame([flow(0, 0)], SCHEMA)),
    ):
        assert "SinglePartition" not in plan_of(rows)


def test_approximate_endpoints(spark):
    df = spark.createDataFrame(random_flows(9, 200), SCHEMA)
    exact = {(r.sensor_id, r.window_start): r.uniq_src for r in ft.unique_endpoints(df).collect()}
    for r in ft.approx_unique_endpoints(df).collect():
        assert abs(r.uniq_src - exact[(r.sensor_id, r.window_start)]) <= 1
    assert df.filter(F.col("src").isNull()).isEmpty()


def test_split_squares_are_exact(spark):
    from flowsight.functions.scalars import join_square, split_square, squared

    values = [0, 1, 99_999, 100_000, 100_001, 2**31 + 7, 10**12 + 3, 987_654_321_012]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    parts = df.select("v", *[c.alias(n) for n, c in split_square(F.col("v")).items()])
    sums = parts.agg(F.sum("square_high").alias("square_high"), F.sum("square_low").alias("square_low"))
    assert int(sums.select(join_square()).first()[0]) == sum(v * v for v in values)
    assert [int(r[0]) for r in df.select(squared(F.col("v"))).collect()] == [v * v for v in values]


def test_one_busy_slice_is_worked_on_in_parts(spark):
    """Nine tenths of the flows lie in one window of one sensor."""
    rng = random.Random(2)
    rows = [(1 if i % 10 else 2, i, START + timedelta(microseconds=rng.randrange(30_000_000) if i % 10 else i * 10**6), *flow(0, 0)[3:]) for i in range(4000)]
    df = spark.createDataFrame(rows, SCHEMA)
    seen = []
    for out in (ft.trailing_features(df, 30), ft.trailing_unique(df, "src", 30), ft.interarrival_gaps(df, 30)):
        assert out.count() == 4000
        seen.append(out)
    counts = {r.arrival_seq: r.flows for r in seen[0].collect()}
    gaps = {r.arrival_seq: r.gap_sec for r in seen[2].collect()}
    times = sorted((r[2], r[1]) for r in rows if r[0] == 1)
    for place, (at, seq) in enumerate(times):
        assert counts[seq] == sum(t <= at for t, _ in times)
        assert gaps[seq] == (None if not place else pytest.approx((at - times[place - 1][0]).total_seconds()))
    parts = df.select(F.floor(F.pmod(F.unix_micros("ts"), F.lit(30_000_000)) * ft.SLICE_PARTS / F.lit(30_000_000)).alias("p"))
    assert max(r["count"] for r in parts.groupBy("p").count().collect()) < 200

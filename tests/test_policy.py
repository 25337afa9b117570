import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowsight.operators import policy as po
from flowsight.schema import FEATURES, Policy

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "sensor_id long, window_start timestamp, window_end timestamp, score double, top_src_ip string, " + ", ".join(
    f"{c} double" for c in FEATURES
)


def rows_of(scores, sensor=1, step=10, ip="1.1.1.1", times=None):
    out = []
    for i, s in enumerate(scores):
        at = START + timedelta(seconds=times[i] if times else i * step)
        out.append((sensor, at, at + timedelta(seconds=step), float(s), ip, *([0.0] * len(FEATURES))))
    return out


def loop(scores, times, p):
    """The policy, one row after the other."""
    recent, history, last, out = [0] * p.window, [], None, []
    for s, t in zip(scores, times):
        history = (history + [s])[-p.adaptive_window :]
        thr = p.threshold
        if p.use_adaptive and len(history) > 10:
            thr = max(thr, np.mean(history) + p.adaptive_sensitivity * np.std(history), p.adaptive_min)
        attack = s >= thr
        recent = (recent + [int(attack)])[-p.window :]
        hits = sum(recent)
        ok = last is None or t - last > p.cooldown_sec
        level = "NONE"
        if attack:
            if s >= 0.98:
                level = "KILL"
            elif s >= p.instant_block:
                level = "HARD"
            elif hits >= p.grace and ok:
                level = "SOFT"
        why = None
        if level == "NONE":
            why = "benign" if not attack else "below" if ok else "cooldown"
        if level != "NONE":
            last = t
        out.append((attack, hits, level, why))
    return out


CASES = [
    (Policy(cooldown_sec=25), 7),
    (Policy(cooldown_sec=25), 50_000),
    (Policy(cooldown_sec=95, grace=1, window=3, adaptive_window=3), 4),
    (Policy(cooldown_sec=0, grace=3), 11),
    (Policy(cooldown_sec=500, instant_block=2.0, threshold=0.6), 60),
    (Policy(cooldown_sec=40, use_adaptive=True, adaptive_window=12, adaptive_sensitivity=0.3), 20),
    (Policy(cooldown_sec=40, use_adaptive=True, adaptive_sensitivity=0.1, threshold=0.3), 70),
]


@pytest.mark.parametrize("policy,chunk", CASES)
def test_decisions_match_the_loop(spark, policy, chunk):
    rng = random.Random(chunk)
    data, wanted = [], {}
    for sensor, n in [(1, 400), (2, 60), (3, 1), (4, 9)]:
        # Scores below one, so SOFT blocks depend on one another over many rows.
        top = 0.975 if sensor == 1 else 1.0
        scores = [round(rng.random() ** 0.3 * top, 6) for _ in range(n)]
        times, clock = [], 0
        for _ in range(n):
            clock += rng.choice([10, 10, 10, 20, 90])
            times.append(clock)
        data += rows_of(scores, sensor, times=times)
        for i, r in enumerate(loop(scores, [t + 10 for t in times], policy)):
            wanted[sensor, i] = r
    rng.shuffle(data)
    out = po.decide(spark.createDataFrame(data, SCHEMA), policy, chunk_rows=chunk).collect()
    assert len(out) == len(wanted)
    short = {"benign": "benign", "cooldown": "cooldown", "below": "below"}
    for r in out:
        attack, hits, level, why = wanted[r.sensor_id, r["index"]]
        assert (r.state == "ATTACK", r.hits_in_window, r.severity) == (attack, hits, level)
        assert r.action == ("NONE" if level == "NONE" else f"BLOCK-{level}")
        assert (r.no_block_reason or "").split()[:1] == ([short[why]] if why else [])


def test_staged_decisions_are_the_same(spark):
    rows = spark.createDataFrame(rows_of([0.9, 0.99, 0.9, 0.2, 0.9, 0.96]), SCHEMA)
    a = po.decide(rows, Policy(cooldown_sec=15))
    b = po.decide(rows, Policy(cooldown_sec=15), staged=True)
    assert a.collect() and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_cooldown_is_strict(spark):
    policy = Policy(grace=1, cooldown_sec=10)
    rows = spark.createDataFrame(rows_of([0.9, 0.9, 0.9]), SCHEMA)
    levels = [r.severity for r in po.decide(rows, policy).orderBy("index").collect()]
    assert levels == ["SOFT", "NONE", "SOFT"]  # 10 s after the first block is still inside


def test_kill_ignores_the_cooldown(spark):
    rows = spark.createDataFrame(rows_of([0.99, 0.985, 0.96, 0.9]), SCHEMA)
    out = po.decide(rows, Policy(cooldown_sec=1000)).orderBy("index").collect()
    assert [r.severity for r in out] == ["KILL", "KILL", "HARD", "NONE"]
    assert out[3].no_block_reason == "cooldown 1000s"
    assert [r.no_block_reason for r in out[:3]] == [None, None, None]  # blocked, cooldown or not


def test_adaptive_needs_more_than_ten_scores(spark):
    scores = [0.9] * 10 + [0.95]
    policy = Policy(use_adaptive=True, threshold=0.1, adaptive_sensitivity=0.0, adaptive_min=0.0)
    rows = spark.createDataFrame(rows_of(scores), SCHEMA)
    limits = [r.effective_threshold for r in po.adaptive_threshold(rows, policy).orderBy("index").collect()]
    assert limits[:10] == [0.1] * 10
    assert limits[10] == pytest.approx(np.mean(scores))


def test_reason_and_outcome_texts(spark):
    rows = spark.createDataFrame(rows_of([0.9, 0.5]) + rows_of([0.99], sensor=2, ip=None), SCHEMA)
    out = {(r.sensor_id, r["index"]): r for r in po.decide(rows, Policy()).collect()}
    assert out[1, 0].no_block_reason == "below criteria (hits=1<2, score=0.900<0.95)"
    assert out[1, 1].no_block_reason == "benign"
    assert (out[2, 0].block_ok, out[2, 0].block_how) == (False, "no-ip")
    wet = po.decide(spark.createDataFrame(rows_of([0.99]), SCHEMA), Policy(dry_run=False)).first()
    assert wet.block_how == "pending"


def test_policy_table_per_sensor(spark):
    rows = spark.createDataFrame(rows_of([0.7], sensor=1) + rows_of([0.7], sensor=2), SCHEMA)
    table = spark.createDataFrame([(1, 0.6)], "sensor_id long, threshold double")
    out = {r.sensor_id: r.state for r in po.decide(rows, table).collect()}
    assert out == {1: "ATTACK", 2: "benign"}


def test_no_sensor_is_worked_on_whole(spark, plan_of):
    rows = spark.createDataFrame(rows_of([0.9, 0.9]), SCHEMA)
    plan = plan_of(po.adaptive_threshold(rows, Policy()))
    assert "SinglePartition" not in plan
    frames = [line for line in plan.splitlines() if "stddev_pop" in line and "windowspecdefinition" in line]
    assert all("_chunk" in line for line in frames)


def test_block_list(spark):
    rows = [("a", "BLOCK-SOFT", 1.0), ("a", "BLOCK-KILL", 3.0), ("a", "NONE", 9.0), (None, "BLOCK-HARD", 2.0), ("b", "BLOCK-HARD", 2.0)]
    out = po.block_list(spark.createDataFrame(rows, "src_ip string, action string, ts double")).orderBy("src_ip").collect()
    assert [tuple(r) for r in out] == [("a", 1.0, 3.0, 2, "KILL"), ("b", 2.0, 2.0, 1, "HARD")]


def step_through(last, bounds, exits):
    """Last block time on leaving a chunk entered with ``last``."""
    return next((int(e) for b, e in zip(bounds, exits) if b > last), last)


def test_chunk_steps_pass_entries_through():
    at = np.array([10, 20, 30], dtype=np.int64)
    never = np.zeros(3, dtype=bool)
    bounds, exits = po.chunk_steps(at, never, np.full(3, 100, dtype=np.int64))
    assert step_through(po.NEVER, bounds, exits) == 10
    assert step_through(5, bounds, exits) == 5
    bounds, exits = po.chunk_steps(at, np.array([False, True, False]), np.full(3, 100, dtype=np.int64))
    assert step_through(5, bounds, exits) == 20
    assert step_through(0, *po.chunk_steps(at[:0], never[:0], at[:0])) == 0


def test_steps_are_followed_over_any_batches():
    rng = random.Random(8)
    rows, wanted = [], []
    for sensor in ("a", None, "c"):
        last = po.NEVER
        for chunk in range(rng.randint(1, 9)):
            steps = [(rng.randint(0, 50), rng.randint(0, 50)) for _ in range(rng.randint(1, 6))]
            wanted.append((sensor, chunk, last))
            last = step_through(last, *zip(*steps))
            rows += [(sensor, chunk, *s) for s in steps]
    table = pa.table({n: list(c) for n, c in zip(["k", "_chunk", "bound", "exit"], zip(*rows))})
    for size in (1, 2, 7, 100):
        found = [tuple(r.values()) for b in po.follow_steps(iter(table.to_batches(size)), "k") for r in b.to_pylist()]
        assert found == wanted


def test_cooldown_longer_than_chunks(spark):
    """Every possible block is a step of its own; no list of them is sent."""
    rng = random.Random(4)
    scores = [round(0.85 + 0.0999 * rng.random() + 0.05 * (rng.random() < 0.01), 6) for _ in range(600)]
    policy = Policy(cooldown_sec=700, grace=1)
    out = po.decide(spark.createDataFrame(rows_of(scores), SCHEMA), policy, chunk_rows=12).orderBy("index")
    ends = [(r[1] - START).total_seconds() for r in rows_of(scores)]
    assert [r.severity for r in out.collect()] == [level for _, _, level, _ in loop(scores, ends, policy)]
    assert "collect_list" not in out._jdf.queryExecution().toString()


def test_attack_type_ladder(spark):
    from flowsight.functions.decision import attack_type

    base = dict.fromkeys(FEATURES, 0.0)
    cases = [
        ({"http_ratio": 0.6, "syn_ratio": 0.9}, "Web Attack (HTTP)"),
        ({"syn_ratio": 0.61}, "DDoS: SYN Flood"),
        ({"rst_ratio": 0.51}, "Recon: Port Scan (RST)"),
        ({"pkts_total": 2.0, "flows": 21.0}, "Recon: Port Scan (Stealth)"),
        ({"bytes_total": 5_000_001.0, "pkts_total": 5.0}, "DDoS: Volumetric (Mirai/UDP)"),
        ({"pkts_total": 10_001.0}, "DDoS: Volumetric (Mirai/UDP)"),
        ({"mean_bytes_flow": 5001.0, "pkts_total": 5.0}, "Exfiltration / Upload"),
        ({"mean_bytes_flow": 5001.0, "pkts_total": 5.0, "syn_ratio": 0.1}, "General Anomaly"),
    ]
    df = spark.createDataFrame([(*{**base, **c}.values(),) for c, _ in cases], ", ".join(f"{c} double" for c in base))
    assert [r.t for r in df.select(attack_type().alias("t")).collect()] == [n for _, n in cases]
    assert df.select(F.count("*")).first()[0] == len(cases)


def test_scored_flows_with_equal_times(spark):
    """Single flows can be decided too; their arrival settles the order of equal times."""
    rng = random.Random(3)
    scores = [round(rng.random() ** 0.3, 6) for _ in range(200)]
    times = sorted(rng.randrange(300) for _ in range(200))
    data = [(1, i, START + timedelta(seconds=t), s, *([0.0] * len(FEATURES))) for i, (s, t) in enumerate(zip(scores, times))]
    schema = "sensor_id long, arrival_seq long, ts timestamp, score double, " + ", ".join(f"{c} double" for c in FEATURES)
    policy = Policy(cooldown_sec=7)
    out = po.decide(
        spark.createDataFrame(data, schema), policy, order=("ts", "arrival_seq"), clock="ts", chunk_rows=9
    ).orderBy("index").collect()
    assert [r.arrival_seq for r in out] == list(range(200))
    assert [r.severity for r in out] == [level for _, _, level, _ in loop(scores, times, policy)]


def test_frame_lengths_per_sensor(spark):
    rng = np.random.default_rng(6)
    policies = {
        1: Policy(threshold=0.6, window=1, cooldown_sec=15),
        2: Policy(threshold=0.6, window=7, use_adaptive=True, adaptive_window=12, adaptive_sensitivity=0.4),
        3: Policy(threshold=0.6, window=3, use_adaptive=True, adaptive_window=70, adaptive_sensitivity=0.2),
    }
    rows = [r for s in policies for r in rows_of(rng.random(120).tolist(), sensor=s)]
    df = spark.createDataFrame(rows, SCHEMA)
    table = spark.createDataFrame([{"sensor_id": s, **{c: getattr(p, c) for c in Policy.columns()}} for s, p in policies.items()])
    columns = ["sensor_id", "index", "hits_in_window", "severity", "action", "no_block_reason"]
    decided = po.decide(df, table, chunk_rows=100).select(columns).collect()
    found = {(r.sensor_id, r["index"]): tuple(r) for r in decided}
    for s, p in policies.items():
        for r in po.decide(df.filter(F.col("sensor_id") == s), p, chunk_rows=100).select(columns).collect():
            assert found[s, r["index"]] == tuple(r)

"""Queries over flows: windowed, trailing and arrival-order features."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsight.functions.decision import attack_type
from flowsight.operators import features as ft
from flowsight.plans import adapters
from flowsight.plans.adapters import WINDOW, WINDOW_SEC
from flowsight.plans.reference_sql import CONTEXT, COUNTED, FLOWS, ROUNDED, WINDOWED, features
from flowsight.plans.registry import query, rounded
from flowsight.sources.flows import event_to_features

# As in functions/decision.py.
ATTACK_TYPE_SQL = """
CASE WHEN http_ratio > 0.5 THEN 'Web Attack (HTTP)'
     WHEN syn_ratio > 0.6 THEN 'DDoS: SYN Flood'
     WHEN rst_ratio > 0.5 THEN 'Recon: Port Scan (RST)'
     WHEN pkts_total < 3 AND flows > 20 THEN 'Recon: Port Scan (Stealth)'
     WHEN bytes_total > 5000000 OR pkts_total > 10000 THEN 'DDoS: Volumetric (Mirai/UDP)'
     WHEN mean_bytes_flow > 5000 AND syn_ratio < 0.1 THEN 'Exfiltration / Upload'
     ELSE 'General Anomaly' END"""


@query(f"""
WITH {WINDOWED}
SELECT {ATTACK_TYPE_SQL} AS attack_type, count(*) AS windows, CAST(sum(flows) AS BIGINT) AS flows,
       CAST(sum(bytes_total) AS BIGINT) AS bytes_total
FROM features GROUP BY 1""")
def attack_types(spark, sf_dir):
    rows = ft.window_features(adapters.flows(spark, sf_dir), WINDOW)
    return rows.groupBy(attack_type().alias("attack_type")).agg(
        F.count(F.lit(1)).alias("windows"),
        F.sum("flows").alias("flows"),
        F.sum("bytes_total").alias("bytes_total"),
    )


@query(f"""
WITH {WINDOWED}
SELECT sensor_id, window_start, window_start + INTERVAL '6 hours' AS window_end,
       {COUNTED}, {ROUNDED}, {CONTEXT}
FROM features""")
def window_features(spark, sf_dir):
    return rounded(ft.window_features(adapters.flows(spark, sf_dir), WINDOW))


@query(f"""
WITH {WINDOWED}, last AS (SELECT sensor_id, max(window_start) AS last FROM features GROUP BY 1)
SELECT sensor_id, window_start, {COUNTED}, {ROUNDED}
FROM features JOIN last USING (sensor_id) WHERE window_start < last""")
def closed_window_features(spark, sf_dir):
    rows = ft.closed_windows(ft.window_features(adapters.flows(spark, sf_dir), WINDOW))
    return rounded(rows.drop("window_end", *ft.CONTEXT))


@query(f"""
WITH {FLOWS}, shifted AS (
  SELECT *, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01 01:00:00') AS window_start FROM flows
), {features("shifted", "sensor_id, window_start", "features")}
SELECT sensor_id, window_start, {COUNTED}, {ROUNDED} FROM features""")
def shifted_window_features(spark, sf_dir):
    rows = ft.window_features(adapters.flows(spark, sf_dir), WINDOW, start="1 hour")
    return rounded(rows.drop("window_end", *ft.CONTEXT))


ANCHORED = f"""
{FLOWS}, anchors AS (SELECT sensor_id, arg_min(ts, arrival_seq) AS anchor FROM flows GROUP BY 1),
indexed AS (
  SELECT f.*, anchor,
         CAST(floor((epoch_us(ts) - epoch_us(anchor)) / {WINDOW_SEC * 1_000_000}.0) AS BIGINT) AS window_index
  FROM flows f JOIN anchors USING (sensor_id)
), {features("indexed", "sensor_id, anchor, window_index", "features")}"""


@query(f"""
WITH {ANCHORED}
SELECT sensor_id, window_index, anchor + to_microseconds(window_index * {WINDOW_SEC * 1_000_000}) AS window_start,
       {COUNTED}, {ROUNDED}, {CONTEXT}
FROM features""")
def anchored_window_features(spark, sf_dir):
    flows = adapters.flows(spark, sf_dir)
    indexed = ft.assign_anchored_windows(flows, ft.sensor_anchors(flows), WINDOW_SEC)
    return rounded(ft.window_features_by(indexed, WINDOW_SEC).drop("window_end"))


ARRIVAL = f"""
{FLOWS}, arrivals AS (
  SELECT * REPLACE (2 * (event_id + CASE WHEN k % 10 = 0 THEN 25 ELSE 0 END)
                    + CASE WHEN k % 10 = 0 THEN 0 ELSE 1 END AS arrival_seq) FROM flows
), anchors AS (SELECT sensor_id, arg_min(ts, arrival_seq) AS anchor FROM arrivals GROUP BY 1),
own AS (
  SELECT f.*, anchor,
         CAST(floor((epoch_us(ts) - epoch_us(anchor)) / {WINDOW_SEC * 1_000_000}.0) AS BIGINT) AS own_index
  FROM arrivals f JOIN anchors USING (sensor_id)
), indexed AS (
  SELECT *, max(own_index) OVER (PARTITION BY sensor_id ORDER BY arrival_seq) AS window_index FROM own
)"""


@query(f"WITH {ARRIVAL} SELECT sensor_id, arrival_seq, ts, own_index, window_index FROM indexed")
def arrival_windows(spark, sf_dir):
    flows = adapters.late_flows(spark, sf_dir)
    rows = ft.assign_arrival_windows(flows, None, WINDOW_SEC, bucket_rows=500)
    own = ft.anchored_index(F.col("ts"), F.col("anchor"), WINDOW_SEC)
    return rows.select("sensor_id", "arrival_seq", "ts", own.alias("own_index"), "window_index")


@query(f"""
WITH {ARRIVAL}, {features("indexed", "sensor_id, anchor, window_index", "features")},
last AS (SELECT sensor_id, max(window_index) AS last FROM features GROUP BY 1)
SELECT sensor_id, window_index, {COUNTED}, {ROUNDED}
FROM features JOIN last USING (sensor_id) WHERE window_index < last""")
def arrival_window_features(spark, sf_dir):
    flows = adapters.late_flows(spark, sf_dir)
    indexed = ft.assign_arrival_windows(flows, None, WINDOW_SEC)
    rows = ft.window_features_by(indexed, WINDOW_SEC, drop_open=True)
    return rounded(rows.drop("window_start", "window_end", *ft.CONTEXT))


@query(f"""
WITH {WINDOWED}
SELECT sensor_id, window_start, count(DISTINCT src) AS uniq_src, count(DISTINCT dst) AS uniq_dst
FROM windowed GROUP BY 1, 2""")
def unique_endpoints(spark, sf_dir):
    return ft.unique_endpoints(adapters.flows(spark, sf_dir), WINDOW)


TRAILING = f"""{FLOWS}, sized AS (
  SELECT *, bytes_toserver + bytes_toclient AS bytes, pkts_toserver + pkts_toclient AS pkts,
         CASE WHEN contains(upper(state), 'SYN') THEN 1.0 ELSE 0.0 END AS syn
  FROM flows
)"""


@query(f"""
WITH {TRAILING}
SELECT sensor_id, arrival_seq, ts, count(*) OVER w AS flows,
       CAST(sum(bytes) OVER w AS BIGINT) AS bytes_total, CAST(sum(pkts) OVER w AS BIGINT) AS pkts_total,
       round_even(avg(syn) OVER w, 6) AS syn_ratio,
       round_even(avg(CAST(bytes AS DOUBLE)) OVER w, 6) AS mean_bytes_flow,
       CAST(0 AS DOUBLE) AS ack_ratio, CAST(0 AS DOUBLE) AS fin_ratio, CAST(0 AS DOUBLE) AS rst_ratio,
       CAST(0 AS DOUBLE) AS http_ratio, round_even(avg(syn) OVER w, 6) AS tcp_ratio, 1 AS protocol_diversity,
       round_even(coalesce(stddev_samp(CAST(bytes AS DOUBLE)) OVER w, 0.0), 2) AS std_bytes,
       CAST(0 AS DOUBLE) AS iat_mean
FROM sized
WINDOW w AS (PARTITION BY sensor_id ORDER BY ts
             RANGE BETWEEN INTERVAL '6 hours' PRECEDING AND CURRENT ROW)""")
def trailing_features(spark, sf_dir):
    return ft.trailing_features(adapters.flows(spark, sf_dir), WINDOW_SEC)


@query(f"""
WITH {FLOWS}
SELECT sensor_id, arrival_seq, ts,
       count(DISTINCT src) OVER w AS uniq_src
FROM flows
WINDOW w AS (PARTITION BY sensor_id ORDER BY ts
             RANGE BETWEEN INTERVAL '6 hours' PRECEDING AND CURRENT ROW)""")
def trailing_unique_sources(spark, sf_dir):
    return ft.trailing_unique(adapters.flows(spark, sf_dir), "src", WINDOW_SEC)


@query(f"""
WITH {FLOWS}
SELECT sensor_id, arrival_seq, ts,
       (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY sensor_id ORDER BY ts, arrival_seq)) / 1e6 AS gap_sec
FROM flows""")
def interarrival_gaps(spark, sf_dir):
    return ft.interarrival_gaps(adapters.flows(spark, sf_dir), 3600)


@query(f"""
WITH {FLOWS}, single AS (
  SELECT event_id, k, event_type, CASE WHEN k % 3 > 0 THEN k % 9 END AS pktcnt, CASE WHEN k % 2 = 0 THEN k END AS packet_count,
         CASE WHEN k % 5 > 0 THEN k * 100 END AS bytecnt, CASE WHEN k % 4 = 0 THEN k + 1 END AS bytes
  FROM event_k
), filled AS (
  SELECT *, coalesce(pktcnt, packet_count, 1) AS p, coalesce(bytecnt, bytes, 200) AS b FROM single
), rows AS (
  SELECT event_type, p, b, greatest(1, b // greatest(1, p)) AS mean_bytes,
         CASE WHEN event_type = 'click' THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END AS syn,
         CASE WHEN event_type IN ('click', 'view') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS tcp
  FROM filled
)
SELECT syn AS syn_ratio, tcp AS tcp_ratio, mean_bytes AS mean_bytes_flow, count(*) AS rows,
       CAST(sum(p) AS BIGINT) AS pkts_total, CAST(sum(b) AS BIGINT) AS bytes_total
FROM rows GROUP BY 1, 2, 3""")
def single_event_features(spark, sf_dir):
    rows = event_to_features(adapters.simple_events(spark, sf_dir))
    return rows.groupBy("syn_ratio", "tcp_ratio", "mean_bytes_flow").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("pkts_total").alias("pkts_total"),
        F.sum("bytes_total").alias("bytes_total"),
    )

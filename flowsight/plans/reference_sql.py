"""Shared parts of the comparison SQL (DuckDB dialect)."""

FLOWS = """
event_k AS (
  SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events
), flows AS (
  SELECT user_id % 8 AS sensor_id, event_id AS arrival_seq, ts, event_id, k,
         '10.0.' || (user_id // 250) || '.' || (user_id % 250) AS src,
         '192.168.1.' || k AS dst,
         CAST(floor(value * 10) AS BIGINT) AS bytes_toserver, k * 10 AS bytes_toclient,
         1 + k % 7 AS pkts_toserver, k % 3 AS pkts_toclient,
         CASE event_type WHEN 'signup' THEN 'new' WHEN 'click' THEN 'SYN_SENT'
              WHEN 'view' THEN 'established|ACK' WHEN 'purchase' THEN 'FIN_WAIT ACK'
              WHEN 'error' THEN 'RST' END AS state,
         CASE WHEN k % 11 = 0 THEN '' WHEN k % 5 = 0 THEN 'UDP' ELSE 'TCP' END AS proto,
         CASE event_type WHEN 'view' THEN 'http' WHEN 'click' THEN 'tls' WHEN 'error' THEN 'dns'
              WHEN 'purchase' THEN 'http_proxy' WHEN 'signup' THEN '' END AS app_proto
  FROM event_k
)"""

# Feature columns over a group of rows of `flows`; `{by}` are the grouping columns.
FEATURE_COLUMNS = """
    count(*) AS flows,
    CAST(sum(bytes_toserver + bytes_toclient) AS BIGINT) AS bytes_total,
    CAST(sum(pkts_toserver + pkts_toclient) AS BIGINT) AS pkts_total,
    avg(CASE WHEN regexp_matches(state, 'new|syn', 'i') THEN 1.0 ELSE 0.0 END) AS syn_ratio,
    avg(CAST(bytes_toserver + bytes_toclient AS DOUBLE)) AS mean_bytes_flow,
    avg(CASE WHEN contains(upper(state), 'ACK') THEN 1.0 ELSE 0.0 END) AS ack_ratio,
    avg(CASE WHEN contains(upper(state), 'FIN') THEN 1.0 ELSE 0.0 END) AS fin_ratio,
    avg(CASE WHEN contains(upper(state), 'RST') THEN 1.0 ELSE 0.0 END) AS rst_ratio,
    avg(CASE WHEN app_proto IN ('http', 'http_proxy') OR proto = 'HTTP' THEN 1.0 ELSE 0.0 END) AS http_ratio,
    avg(CASE WHEN proto = 'TCP' THEN 1.0 ELSE 0.0 END) AS tcp_ratio,
    CAST(least(12, len(list_distinct(list_concat(
        list(proto) FILTER (proto <> ''),
        coalesce(list(app_proto) FILTER (app_proto <> ''), CAST([] AS VARCHAR[])))))) AS INTEGER)
      AS protocol_diversity,
    coalesce(stddev_samp(CAST(bytes_toserver + bytes_toclient AS DOUBLE)), 0.0) AS std_bytes,
    CASE WHEN count(*) > 1
         THEN (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 / (count(*) - 1) ELSE 0.0 END AS iat_mean,
    count(*) FILTER (app_proto IN ('http', 'http_proxy') OR proto = 'HTTP') AS http_flows,
    count(*) FILTER (app_proto = 'dns') AS dns_flows,
    count(*) FILTER (app_proto = 'tls') AS tls_flows,
    coalesce(array_to_string(list_sort(list_distinct(list(app_proto) FILTER (app_proto <> ''))), ','), '')
      AS app_protos"""


def features(source: str, by: str, name: str) -> str:
    """CTEs: `name` holds the features of `source` per `by`, with the top source address."""
    on = " AND ".join(f"a.{c.strip()} = b.{c.strip()}" for c in by.split(","))
    return f"""
{name}_src AS (
  SELECT {by}, src, row_number() OVER (PARTITION BY {by} ORDER BY count(*) DESC, src) AS place
  FROM {source} WHERE src IS NOT NULL GROUP BY {by}, src
), {name}_agg AS (
  SELECT {by}, {FEATURE_COLUMNS}
  FROM {source} GROUP BY {by}
), {name} AS (
  SELECT a.*, b.src AS top_src_ip
  FROM {name}_agg a LEFT JOIN {name}_src b ON {on} AND b.place = 1
)"""


WINDOWED = (
    FLOWS
    + """, windowed AS (
  SELECT *, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS window_start FROM flows
),"""
    + features("windowed", "sensor_id, window_start", "features")
)

ROUNDED = ", ".join(
    f"round_even({c}, {10 if c == 'iat_mean' else 6}) AS {c}"
    for c in [
        "syn_ratio", "mean_bytes_flow", "ack_ratio", "fin_ratio", "rst_ratio", "http_ratio",
        "tcp_ratio", "std_bytes", "iat_mean",
    ]
)
COUNTED = "flows, bytes_total, pkts_total, protocol_diversity"
CONTEXT = "top_src_ip, http_flows, dns_flows, tls_flows, app_protos"

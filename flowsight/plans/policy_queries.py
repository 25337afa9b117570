"""Queries over scored windows: thresholds, decisions, threat context, alert reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsight.functions.decision import threat_text
from flowsight.functions.scalars import code_point_sum
from flowsight.operators import alerts as al
from flowsight.operators import policy as po
from flowsight.operators.enrich import attach_context_asof, enrich_threat
from flowsight.operators.features import window_features
from flowsight.plans import adapters
from flowsight.plans.reference_sql import FLOWS, WINDOWED, features
from flowsight.plans.registry import query, rounded
from flowsight.plans.traffic_queries import ATTACK_TYPE_SQL
from flowsight.schema import Policy
from flowsight.session import materialize

# Windows are six hours long here, so the cooldown spans three of them.
POLICY = Policy(cooldown_sec=64_800)
ADAPTIVE = Policy(cooldown_sec=64_800, use_adaptive=True, adaptive_sensitivity=0.5)
NOW = 1_706_572_800.0  # 2024-01-30 00:00 UTC, near the end of the events

SCORED = f"""{WINDOWED}, scored AS (
  SELECT *, window_start + INTERVAL '6 hours' AS window_end,
         round(1 / (1 + exp(-(12 * syn_ratio + 6 * rst_ratio - 10 * ack_ratio))), 9) AS score,
         row_number() OVER (PARTITION BY sensor_id ORDER BY window_start) - 1 AS index
  FROM features
)"""


def state_sql(policy: Policy) -> str:
    frame = "PARTITION BY sensor_id ORDER BY index ROWS BETWEEN {} PRECEDING AND CURRENT ROW"
    history = frame.format(policy.adaptive_window - 1)
    lifted = "threshold"
    if policy.use_adaptive:
        lifted = f"""CASE WHEN count(*) OVER h > 10 THEN greatest(threshold,
             greatest(avg(score) OVER h + {policy.adaptive_sensitivity} * stddev_pop(score) OVER h,
                      CAST({policy.adaptive_min} AS DOUBLE))) ELSE threshold END"""
    return f"""{SCORED}, based AS (
  SELECT *, CAST({policy.threshold} AS DOUBLE) AS threshold FROM scored
), thresholded AS (
  SELECT *, {lifted} AS effective_threshold FROM based WINDOW h AS ({history})
), attacks AS (
  SELECT *, score >= effective_threshold AS is_attack FROM thresholded
), stated AS (
  SELECT *, CAST(sum(CAST(is_attack AS INTEGER)) OVER ({frame.format(policy.window - 1)}) AS INTEGER)
              AS hits_in_window
  FROM attacks
)"""


def decided_sql(policy: Policy) -> str:
    p = policy
    level = f"""CASE WHEN NOT s.is_attack THEN 'NONE' WHEN s.score >= 0.98 THEN 'KILL'
           WHEN s.score >= {p.instant_block} THEN 'HARD'
           WHEN s.hits_in_window >= {p.grace} AND {{ok}} THEN 'SOFT' ELSE 'NONE' END"""
    ok = f"(w.last_at IS NULL OR epoch_us(s.window_end) - w.last_at > {int(p.cooldown_sec * 1_000_000)})"
    states = state_sql(p)
    return f"""RECURSIVE {states}, walk AS (
  SELECT sensor_id, CAST(-1 AS BIGINT) AS index, CAST(NULL AS BIGINT) AS last_at,
         'NONE' AS severity, true AS cooled
  FROM stated WHERE index = 0
  UNION ALL
  SELECT s.sensor_id, s.index,
         CASE WHEN {level.format(ok=ok)} <> 'NONE' THEN epoch_us(s.window_end) ELSE w.last_at END,
         {level.format(ok=ok)}, {ok}
  FROM walk w JOIN stated s ON s.sensor_id = w.sensor_id AND s.index = w.index + 1
), decided AS (
  SELECT s.*, w.severity,
         CASE WHEN s.is_attack THEN 'ATTACK' ELSE 'benign' END AS state,
         CASE WHEN w.severity = 'NONE' THEN 'NONE' ELSE 'BLOCK-' || w.severity END AS action,
         CASE WHEN s.score >= s.threshold THEN {ATTACK_TYPE_SQL}
              WHEN s.score > 0.5 THEN 'attack' ELSE 'benign' END AS pred_class,
         CASE WHEN w.severity <> 'NONE' THEN NULL
              WHEN NOT s.is_attack THEN 'benign'
              WHEN NOT w.cooled THEN 'cooldown {int(p.cooldown_sec)}s'
              ELSE format('below criteria (hits={{}}<{p.grace}, score={{:.3f}}<{p.instant_block})',
                                                   s.hits_in_window, s.score) END AS no_block_reason,
         CASE WHEN w.severity <> 'NONE' THEN s.top_src_ip IS NOT NULL END AS block_ok,
         CASE WHEN w.severity <> 'NONE' THEN CASE WHEN s.top_src_ip IS NULL THEN 'no-ip'
              ELSE 'dry-run-' || lower(w.severity) END END AS block_how,
         epoch_us(s.window_end) / 1e6 AS ts, s.top_src_ip AS src_ip
  FROM stated s JOIN walk w ON s.sensor_id = w.sensor_id AND s.index = w.index
)"""


# As in operators/enrich.py.
COUNTRY_SQL = "['US', 'CN', 'RU', 'DE', 'BR', 'IN']"
FLAG_SQL = "['🇺🇸', '🇨🇳', '🇷🇺', '🇩🇪', '🇧🇷', '🇮🇳']"
REPUTATION_SQL = """CASE {ip} WHEN '192.168.1.105' THEN 'Mirai Botnet Node'
  WHEN '10.0.0.50' THEN 'Command & Control Server' WHEN '45.33.22.11' THEN 'Mass Scanner' END"""


def threat_sql(ip: str) -> str:
    """Columns code_sum, country, flag and threat of an address column."""
    place = f"CASE WHEN coalesce({ip}, '') <> '' THEN {{}}[1 + code_sum % 6] END"
    return (
        f"{place.format(COUNTRY_SQL)} AS country, {place.format(FLAG_SQL)} AS flag, "
        f"{REPUTATION_SQL.format(ip=ip)} AS threat"
    )


CODE_SUM_SQL = "CAST(list_sum(list_transform(string_split({ip}, ''), lambda x: unicode(x))) AS INTEGER)"


def scored(spark, sf_dir):
    """Scored windows as a stored table, which the policy operators go through more than once."""
    return materialize(adapters.scored_windows(spark, sf_dir), "scored")


def alerts(spark, sf_dir, policy=POLICY):
    """Alert events of the scored windows, with threat context."""
    return al.as_alerts(enrich_threat(po.decide(scored(spark, sf_dir), policy)))


@query(f"""
WITH {state_sql(POLICY)}
SELECT sensor_id, window_start, index, score, is_attack, hits_in_window, effective_threshold FROM stated""")
def window_hits(spark, sf_dir):
    rows = po.adaptive_threshold(scored(spark, sf_dir), POLICY)
    return rows.select(
        "sensor_id", "window_start", "index", "score", "is_attack", "hits_in_window", "effective_threshold"
    )


@query(f"""
WITH {state_sql(ADAPTIVE)}
SELECT sensor_id, window_start, index, score, is_attack, hits_in_window,
       round_even(effective_threshold, 6) AS effective_threshold FROM stated""")
def adaptive_threshold(spark, sf_dir):
    rows = po.adaptive_threshold(scored(spark, sf_dir), ADAPTIVE).select(
        "sensor_id", "window_start", "index", "score", "is_attack", "hits_in_window", "effective_threshold"
    )
    return rounded(rows, 6, ["effective_threshold"])


DECISION_COLUMNS = [
    "sensor_id", "window_start", "index", "score", "state", "hits_in_window", "severity", "action",
    "pred_class", "no_block_reason", "block_ok", "block_how",
]


@query(f"WITH {decided_sql(POLICY)} SELECT {', '.join(DECISION_COLUMNS)} FROM decided")
def decisions(spark, sf_dir):
    return po.decide(scored(spark, sf_dir), POLICY).select(*DECISION_COLUMNS)


@query(f"WITH {decided_sql(ADAPTIVE)} SELECT {', '.join(DECISION_COLUMNS)} FROM decided")
def adaptive_decisions(spark, sf_dir):
    return po.decide(scored(spark, sf_dir), ADAPTIVE).select(*DECISION_COLUMNS)


@query(f"""
WITH {SCORED}
SELECT sensor_id, window_start, score, 0.5::DOUBLE + sensor_id * 0.05::DOUBLE AS threshold,
       2 AS grace, 0.95::DOUBLE AS instant_block,
       score >= 0.5::DOUBLE + sensor_id * 0.05::DOUBLE AS is_attack
FROM scored""")
def sensor_policies(spark, sf_dir):
    rows = scored(spark, sf_dir)
    per_sensor = rows.select("sensor_id").distinct().withColumn(
        "threshold", F.col("sensor_id") * 0.05 + 0.5
    )
    out = po.attach_policy(rows, per_sensor)
    return out.select(
        "sensor_id", "window_start", "score", "threshold", "grace", "instant_block",
        (F.col("score") >= F.col("threshold")).alias("is_attack"),
    )


@query(f"""
WITH {FLOWS}, coded AS (
  SELECT *, {CODE_SUM_SQL.format(ip="dst")} AS code_sum FROM flows
), placed AS (SELECT *, {threat_sql("dst")} FROM coded)
SELECT arrival_seq, dst, code_sum, country, flag, threat,
       trim(concat_ws(' ', coalesce(flag, ''), coalesce(country, ''), coalesce(threat, ''))) AS threat_text
FROM placed""")
def threat_context(spark, sf_dir):
    rows = enrich_threat(adapters.flows(spark, sf_dir).select("arrival_seq", "dst"), "dst")
    return rows.select(
        "arrival_seq",
        "dst",
        code_point_sum(F.col("dst")).alias("code_sum"),
        "threat.country",
        "threat.flag",
        "threat.threat",
        threat_text(F.col("threat")).alias("threat_text"),
    )


@query(f"""
WITH {SCORED}, hourly AS (
  SELECT *, time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS hour_start FROM flows
), {features("hourly", "sensor_id, hour_start", "context")}
SELECT s.sensor_id, s.window_start, c.hour_start + INTERVAL '1 hour' AS context_at,
       c.top_src_ip AS context_top_src_ip, c.dns_flows AS context_dns_flows
FROM scored s ASOF LEFT JOIN context c
  ON s.sensor_id = c.sensor_id AND s.window_end >= c.hour_start + INTERVAL '1 hour'""")
def context_asof(spark, sf_dir):
    flows = adapters.flows(spark, sf_dir)
    context = window_features(flows, "1 hour").select(
        "sensor_id", "window_end", "top_src_ip", "dns_flows"
    )
    rows = scored(spark, sf_dir).select("sensor_id", "window_start", F.col("window_end").alias("ts"))
    return attach_context_asof(
        rows, context, context_at="window_end", fields=("top_src_ip", "dns_flows")
    ).drop("ts")


ALERTS = decided_sql(POLICY)


@query(f"""
WITH {ALERTS}, placed AS (
  SELECT *, {threat_sql("src_ip")}
  FROM (SELECT *, {CODE_SUM_SQL.format(ip="src_ip")} AS code_sum FROM decided)
)
SELECT ts, index, score, state, hits_in_window, action, pred_class, '' AS reason,
       trim(concat_ws(' ', coalesce(flag, ''), coalesce(country, ''), coalesce(threat, ''))) AS threat
FROM placed""")
def alert_export(spark, sf_dir):
    return al.export_rows(alerts(spark, sf_dir))


MINUTES = 10 * 24 * 60
RECENT = f"{ALERTS}, recent AS (SELECT * FROM decided WHERE ts >= {NOW} - {MINUTES} * 60)"


@query(f"""
WITH {RECENT}
SELECT count(*) AS total, count(*) FILTER (state = 'ATTACK') AS attacks,
       count(*) FILTER (action LIKE 'BLOCK%') AS blocks FROM recent""")
def alert_counts(spark, sf_dir):
    return al.alert_counts(alerts(spark, sf_dir), NOW, MINUTES)


@query(f"WITH {RECENT} SELECT pred_class, count(*) AS events FROM recent GROUP BY 1")
def class_counts(spark, sf_dir):
    return al.class_counts(alerts(spark, sf_dir), NOW, MINUTES)


@query(f"WITH {ALERTS} SELECT sensor_id, ts, index, state, action FROM decided WHERE ts > {NOW} - 172800")
def alerts_since(spark, sf_dir):
    rows = al.alerts_since(alerts(spark, sf_dir), NOW - 172_800)
    return rows.select(F.col("sensor_id").cast("long").alias("sensor_id"), "ts", "index", "state", "action")


@query(f"""
WITH {ALERTS}
SELECT sensor_id, ts, index, score, action FROM decided
ORDER BY ts DESC, index DESC, CAST(sensor_id AS VARCHAR) DESC LIMIT 200""")
def last_alerts(spark, sf_dir):
    rows = al.last_alerts(alerts(spark, sf_dir), 200)
    return rows.select(F.col("sensor_id").cast("long").alias("sensor_id"), "ts", "index", "score", "action")


@query(f"""
WITH {ALERTS}
SELECT strftime(make_timestamp(CAST(ts * 1000000 AS BIGINT)), '%Y-%m-%dT%H:%M:%SZ') AS time, score,
       effective_threshold
FROM decided ORDER BY ts DESC, index DESC, CAST(sensor_id AS VARCHAR) DESC LIMIT 100""")
def score_series(spark, sf_dir):
    return al.score_series(alerts(spark, sf_dir), 100)


@query(f"""
WITH {ALERTS}
SELECT src_ip, min(ts) AS first_block, max(ts) AS last_block, count(*) AS blocks,
       CASE max(CASE action WHEN 'BLOCK-KILL' THEN 3 WHEN 'BLOCK-HARD' THEN 2 ELSE 1 END)
            WHEN 3 THEN 'KILL' WHEN 2 THEN 'HARD' ELSE 'SOFT' END AS severity
FROM decided WHERE action LIKE 'BLOCK%' AND src_ip IS NOT NULL GROUP BY 1""")
def block_list(spark, sf_dir):
    return po.block_list(alerts(spark, sf_dir))

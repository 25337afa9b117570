"""Alert events: shape, recent counts, listings, export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsight.functions.decision import threat_text
from flowsight.functions.scalars import iso_utc
from flowsight.schema import KEY, THREAT_TYPE

EXPORT_COLUMNS = [
    "ts", "index", "score", "state", "hits_in_window", "action", "pred_class", "reason", "threat",
]  # fixed values: columns and order of the export


def as_alerts(decisions: DataFrame, key: str = KEY, clock: str = "window_end") -> DataFrame:
    """Decided windows as alert events; ``ts`` is the event time in epoch seconds.

    The row's own source address and context go with it.
    """
    have = set(decisions.columns)
    optional = lambda c, t: F.col(c) if c in have else F.lit(None).cast(t)
    return decisions.select(
        (F.unix_micros(clock) / F.lit(1e6)).alias("ts"),
        F.col("index").cast("long").alias("index"),
        F.col("score"),
        "state",
        "hits_in_window",
        "action",
        "effective_threshold",
        "pred_class",
        optional("reason", "string").alias("reason"),
        optional("threat", THREAT_TYPE).alias("threat"),
        F.col(key).cast("string").alias("sensor_id"),
        optional("top_src_ip", "string").alias("src_ip"),
    )


def is_block():
    """Blocks are written as BLOCK- and the severity, so the prefix is what counts."""
    return F.col("action").startswith("BLOCK")


def alerts_since(alerts: DataFrame, since: float) -> DataFrame:
    """Events strictly after ``since``; an event without a time counts as time 0."""
    return alerts.filter(F.coalesce("ts", F.lit(0.0)) > F.lit(float(since)))


def recent_alerts(alerts: DataFrame, now: float, minutes: float = 60) -> DataFrame:
    """Events from ``now - minutes`` on."""
    return alerts.filter(F.coalesce("ts", F.lit(0.0)) >= F.lit(float(now) - minutes * 60))


def alert_counts(alerts: DataFrame, now: float, minutes: float = 60) -> DataFrame:
    """One row: events, attacks and blocks of the last ``minutes``."""
    return recent_alerts(alerts, now, minutes).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.coalesce(F.col("state") == "ATTACK", F.lit(False))).alias("attacks"),
        F.count_if(F.coalesce(is_block(), F.lit(False))).alias("blocks"),
    )


def class_counts(alerts: DataFrame, now: float, minutes: float = 60) -> DataFrame:
    """Events per predicted class in the last ``minutes``, most frequent first."""
    return (
        recent_alerts(alerts, now, minutes)
        .filter(F.col("pred_class").isNotNull())
        .groupBy("pred_class")
        .agg(F.count(F.lit(1)).alias("events"))
        .orderBy(F.desc("events"), "pred_class")
    )


def last_alerts(alerts: DataFrame, n: int = 200) -> DataFrame:
    """The newest ``n`` events, oldest first."""
    newest = alerts.orderBy(F.desc("ts"), F.desc("index"), F.desc("sensor_id")).limit(n)
    return newest.orderBy("ts", "index", "sensor_id")


def score_series(alerts: DataFrame, n: int = 100) -> DataFrame:
    """Time, score and threshold of the newest ``n`` events, for a chart."""
    return last_alerts(alerts, n).select(
        iso_utc(F.col("ts")).alias("time"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        "effective_threshold",
    )


def export_rows(alerts: DataFrame) -> DataFrame:
    """The nine export columns, with the threat context as text."""
    return alerts.withColumns(
        {"threat": threat_text(F.col("threat")), "reason": F.coalesce("reason", F.lit(""))}
    ).select(*EXPORT_COLUMNS)

"""Column names, read schemas and the decision policy shared by every stage."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import types as T

# The 13 model features, in model order.
FEATURES = [
    "flows",
    "bytes_total",
    "pkts_total",
    "syn_ratio",
    "mean_bytes_flow",
    "ack_ratio",
    "fin_ratio",
    "rst_ratio",
    "http_ratio",
    "tcp_ratio",
    "protocol_diversity",
    "std_bytes",
    "iat_mean",
]

# Features that hold whole numbers; the others are doubles.
INTEGER_FEATURES = {
    "flows": T.LongType(),
    "pkts_total": T.LongType(),
    "protocol_diversity": T.IntegerType(),
}

# Protocol names counted at most once each, so the diversity never exceeds this (fixed value).
MAX_PROTOCOLS = 12

KEY = "sensor_id"


FEATURE_SCHEMA = T.StructType(
    [T.StructField(c, INTEGER_FEATURES.get(c, T.DoubleType())) for c in FEATURES]
)

FLOW_EVENT_SCHEMA = T.StructType(
    [
        T.StructField("sensor_id", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("dest_ip", T.StringType()),
        T.StructField("proto", T.StringType()),
        T.StructField("app_proto", T.StringType()),
        T.StructField(
            "flow",
            T.StructType(
                [
                    T.StructField("bytes_toserver", T.LongType()),
                    T.StructField("bytes_toclient", T.LongType()),
                    T.StructField("pkts_toserver", T.LongType()),
                    T.StructField("pkts_toclient", T.LongType()),
                    T.StructField("state", T.StringType()),
                ]
            ),
        ),
    ]
)

SIMPLE_EVENT_SCHEMA = T.StructType(
    [
        T.StructField("src_ip", T.StringType()),
        T.StructField("dest_ip", T.StringType()),
        T.StructField("pktcnt", T.LongType()),
        T.StructField("packet_count", T.LongType()),
        T.StructField("bytecnt", T.LongType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("tcp", T.StructType([T.StructField("flags", T.StringType())])),
    ]
)

THREAT_TYPE = T.StructType(
    [
        T.StructField("country", T.StringType()),
        T.StructField("flag", T.StringType()),
        T.StructField("threat", T.StringType()),
    ]
)

ALERT_SCHEMA = T.StructType(
    [
        T.StructField("ts", T.DoubleType()),
        T.StructField("index", T.LongType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("state", T.StringType()),
        T.StructField("hits_in_window", T.IntegerType()),
        T.StructField("action", T.StringType()),
        T.StructField("effective_threshold", T.DoubleType()),
        T.StructField("pred_class", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("threat", THREAT_TYPE),
        T.StructField("sensor_id", T.StringType()),
        T.StructField("src_ip", T.StringType()),
    ]
)


@dataclass(frozen=True)
class Policy:
    """Decision parameters. ``window`` and ``adaptive_window`` count scored rows."""

    threshold: float = 0.85
    grace: int = 2
    window: int = 5
    cooldown_sec: float = 5
    instant_block: float = 0.95
    dry_run: bool = True
    use_adaptive: bool = False
    adaptive_window: int = 50
    adaptive_sensitivity: float = 2.0
    adaptive_min: float = 0.50

    @classmethod
    def columns(cls) -> list[str]:
        return [f.name for f in fields(cls)]

    # Rows of history a scored row can depend on: hits reach back over `window` states,
    # and each of those states over `adaptive_window` scores.
    @property
    def reach(self) -> int:
        return max(self.window, 1) + max(self.adaptive_window, 1) - 2

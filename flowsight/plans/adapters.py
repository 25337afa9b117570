"""Derive the package's input shapes from star-schema and event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsight.operators.features import window_features
from flowsight.schema import KEY

# Events are minutes apart, so test windows are hours long.
WINDOW = "6 hours"
WINDOW_SEC = 6 * 3600

# Dataset names that label rows derived from lineitem, by supplier number.
DATASETS = [
    "BrowserHijacking",
    "CommandInjection",
    "DDoS-ACK_Fragmentation",
    "DDoS-HTTP_Flood-",
    "DDoS-ICMP_Flood",
    "DDoS-ICMP_Fragmentation",
    "DDoS-PSHACK_Flood",
    "DDoS-RSTFINFlood",
    "DDoS-SlowLoris",
    "DDoS-SYN_Flood",
    "DDoS-SynonymousIP_Flood",
    "DDoS-TCP_Flood",
    "DDoS-UDP_Flood",
    "DDoS-UDP_Fragmentation",
    "DictionaryBruteForce",
    "DNS_Spoofing",
    "DoS-HTTP_Flood",
    "DoS-SYN_Flood",
    "DoS-TCP_Flood",
    "DoS-UDP_Flood",
    "Mirai-greeth_flood",
    "Mirai-greip_flood",
    "Mirai-udpplain",
    "MITM-ArpSpoofing",
    "Recon-HostDiscovery",
    "Recon-OSScan",
    "Recon-PingSweep",
    "Recon-PortScan",
    "SqlInjection",
    "Uploading_Attack",
    "VulnerabilityScan",
    "XSS",
    "BenignTraffic",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_event(event_type: Column, choices: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(event_type == e, F.lit(v)) for e, v in choices.items()])


def flows_from_events(events: DataFrame, arrival: Column | None = None) -> DataFrame:
    """Events as network flows of eight sensors, numbered by event unless ``arrival`` says otherwise."""
    k = F.col("_k")
    user = F.col("user_id")
    kind = F.col("event_type")
    keyed = events.withColumn("_k", F.get_json_object("props", "$.k").cast("long"))
    return keyed.select(
        (user % 8).alias(KEY),
        (F.col("event_id") if arrival is None else arrival).alias("arrival_seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat_ws(
            ".", F.lit("10.0"), F.floor(user / 250).cast("string"), (user % 250).cast("string")
        ).alias("src"),
        F.concat(F.lit("192.168.1."), k.cast("string")).alias("dst"),
        F.floor(F.col("value") * 10).cast("long").alias("bytes_toserver"),
        (k * 10).alias("bytes_toclient"),
        (k % 7 + 1).alias("pkts_toserver"),
        (k % 3).alias("pkts_toclient"),
        by_event(
            kind,
            {
                "signup": "new",
                "click": "SYN_SENT",
                "view": "established|ACK",
                "purchase": "FIN_WAIT ACK",
                "error": "RST",
            },
        ).alias("state"),
        F.when(k % 11 == 0, "").when(k % 5 == 0, "UDP").otherwise("TCP").alias("proto"),
        by_event(
            kind,
            {"view": "http", "click": "tls", "error": "dns", "purchase": "http_proxy", "signup": ""},
        ).alias("app_proto"),
    )


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows_from_events(table(spark, sf_dir, "events"))


def late_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same flows, a tenth of them arriving 25 places late.

    ``arrival_seq`` orders by (place, event id) in one number.
    """
    late = F.get_json_object("props", "$.k").cast("long") % 10 == 0
    place = F.col("event_id") + F.when(late, F.lit(25)).otherwise(F.lit(0))
    # Equal places hold one late and one punctual event; the late one has the smaller id.
    order = place * 2 + F.when(late, F.lit(0)).otherwise(F.lit(1))
    return flows_from_events(table(spark, sf_dir, "events"), order)


def simple_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as flat packet events, with some of the alternative fields missing."""
    k, kind = F.col("_k"), F.col("event_type")
    flags = F.when(kind == "click", "S").when(kind == "view", "A")
    keyed = table(spark, sf_dir, "events").withColumn("_k", F.get_json_object("props", "$.k").cast("long"))
    return keyed.select(
        F.when(k % 3 > 0, k % 9).alias("pktcnt"),
        F.when(k % 2 == 0, k).alias("packet_count"),
        F.when(k % 5 > 0, k * 100).alias("bytecnt"),
        F.when(k % 4 == 0, k + 1).alias("bytes"),
        F.when(flags.isNotNull(), F.struct(flags.alias("flags"))).alias("tcp"),
    )


def fixed_score() -> Column:
    """A deterministic stand-in for the model score, so policy results have one right answer."""
    margin = 12 * F.col("syn_ratio") + 6 * F.col("rst_ratio") - 10 * F.col("ack_ratio")
    return F.round(1 / (1 + F.exp(-margin)), 9)


def scored_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_features(flows(spark, sf_dir), WINDOW).withColumn("score", fixed_score())


def dataset_name(number: Column) -> Column:
    names = F.array(*[F.lit(d) for d in DATASETS])
    return F.get(names, (number % len(DATASETS)).cast("int"))


def labelled_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a true class ``y``, a score with many ties, and a dataset name."""
    raw = F.col("l_discount") * 5 + F.col("l_tax") + F.col("l_quantity") / 200
    return table(spark, sf_dir, "lineitem").select(
        dataset_name(F.col("l_suppkey")).alias("source_file"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        F.round(F.least(F.lit(1.0), raw), 4).alias("score"),
    )


def packet_summaries(
    spark: SparkSession, sf_dir: str, variant: str = "A", more: dict[str, Column] | None = None
) -> DataFrame:
    """Raw packet summaries with the heterogeneous column names of the public captures."""
    extra = []
    if variant == "B":
        extra = [
            (F.col("l_extendedprice") / 10).alias("Std"),
            (F.col("l_tax") * 3).alias("IAT"),
        ]
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").alias("Number"),
        F.col("l_extendedprice").alias("Tot sum"),
        (F.col("l_discount") * 10).alias("syn_flag_number"),
        F.col("l_linenumber").alias("ack_count"),
        (F.col("l_linenumber") % 2).alias("HTTP"),
        F.lit(1).alias("TCP"),
        (F.col("l_partkey") % 2).alias("UDP"),
        F.col("l_tax").alias("Min"),
        F.col("l_extendedprice").alias("Max"),
        F.col("l_quantity").alias("Rate"),
        *extra,
        *[c.alias(n) for n, c in (more or {}).items()],
        dataset_name(F.col("l_suppkey")).alias("source_file"),
    )

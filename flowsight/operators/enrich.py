"""Threat context of source addresses, and the newest window context of a scored row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsight.functions.scalars import code_point_sum
from flowsight.operators.lookups import lookup
from flowsight.operators.ordering import time_bucket, with_running_max
from flowsight.schema import KEY

# Known addresses, and the countries an address is assigned to by its code sum.
REPUTATION = [
    ("192.168.1.105", "Mirai Botnet Node"),
    ("10.0.0.50", "Command & Control Server"),
    ("45.33.22.11", "Mass Scanner"),
]
COUNTRIES = [("US", "🇺🇸"), ("CN", "🇨🇳"), ("RU", "🇷🇺"), ("DE", "🇩🇪"), ("BR", "🇧🇷"), ("IN", "🇮🇳")]
UNKNOWN = ("Unknown", "🏳️")


def reputation_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REPUTATION, "ip string, threat string")


def place_of(ip: Column) -> Column:
    """(country, flag) struct of an address; unknown when it is missing or empty."""
    place = lambda c: F.struct(F.lit(c[0]).alias("country"), F.lit(c[1]).alias("flag"))
    known = F.get(F.array(*[place(c) for c in COUNTRIES]), code_point_sum(ip) % len(COUNTRIES))
    return F.when(F.coalesce(ip, F.lit("")) == "", place(UNKNOWN)).otherwise(known)


def enrich_threat(
    rows: DataFrame, ip: str = "top_src_ip", reputation: DataFrame | None = None
) -> DataFrame:
    """Adds ``threat`` (country, flag, threat label) for the address in ``ip``; null without one.

    ``reputation`` (ip, threat; one row per address) replaces the built-in list.
    """
    renamed = [F.col("ip").alias(ip), F.col("threat").alias("_threat")]
    if reputation is None:
        joined = rows.join(F.broadcast(reputation_table(rows.sparkSession).select(renamed)), [ip], "left")
    else:
        joined = lookup(rows, reputation.select(renamed), [ip])
    place = place_of(F.col(ip))
    return (
        joined.withColumn(
            "threat",
            F.when(
                F.coalesce(F.col(ip), F.lit("")) != "",
                F.struct(
                    place["country"].alias("country"),
                    place["flag"].alias("flag"),
                    F.col("_threat").alias("threat"),
                ),
            ),
        ).select(*rows.columns, "threat")
    )


def attach_context_asof(
    scored: DataFrame,
    context: DataFrame,
    at: str = "ts",
    context_at: str = "ts",
    fields: tuple[str, ...] = ("top_src_ip",),
    key: str = KEY,
    bucket_sec: int = 86_400,
) -> DataFrame:
    """Newest context at or before each scored row's time, per sensor."""
    seen = F.struct(F.col(context_at).alias("_seen_at"), *[F.col(f) for f in fields])
    left = scored.withColumn("_at", F.col(at)).withColumn("_context", F.lit(None).cast(
        context.select(seen.alias("c")).schema["c"].dataType
    )).withColumn("_scored", F.lit(True))
    right = context.select(key, F.col(context_at).alias("_at"), seen.alias("_context"), F.lit(False).alias("_scored"))
    both = left.unionByName(right, allowMissingColumns=True)
    newest = with_running_max(
        both, [key], F.col("_at"), time_bucket(F.col("_at"), bucket_sec), F.col("_context"), "_newest"
    )
    return newest.filter("_scored").select(
        *scored.columns,
        F.col("_newest._seen_at").alias("context_at"),
        *[F.col(f"_newest.{f}").alias(f"context_{f}") for f in fields],
    )

"""Packet summaries with varying column names to labelled feature rows."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsight.functions.labels import with_attack_label
from flowsight.functions.scalars import clip, ratio, round_even
from flowsight.operators.lookups import lookup
from flowsight.schema import FEATURES, MAX_PROTOCOLS

# Names a column may go by, in the order they are tried. Names are compared with
# everything but letters and digits removed, so "Tot sum" and "tot_sum" are one name.
PACKETS = ["number", "pkt number", "pktnum", "packet count", "packets"]
BYTES = ["tot sum", "total bytes", "total length", "bytes", "length"]
BYTES_PROXY = ["bytes", "length", "size", "total"]
SYN_FLAG = ["syn flag number", "syn proportion"]
UNIQUE_SRC = ["uniq src", "unique src", "src count", "source count"]
UNIQUE_DST = ["uniq dst", "unique dst", "dst count", "dest count"]
STD = ["std", "standard deviation", "stddev"]
MIN = ["min", "minimum"]
MAX = ["max", "maximum"]
IAT = ["iat", "inter arrival time", "interarrival"]
RATE = ["rate", "packet rate"]
SYN_GUESS = 0.1
PROTOCOLS = [
    "HTTP", "HTTPS", "DNS", "TCP", "UDP", "ICMP", "SMTP", "SSH", "Telnet", "DHCP", "ARP", "IGMP",
]


class UnresolvedColumns(ValueError):
    """No packet or byte column could be found."""


def plain_name(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.lower())


def resolve_column(columns: Sequence[str], aliases: Sequence[str]) -> str | None:
    """The column the first matching alias names; the last one when several names coincide."""
    by_name = {plain_name(c): c for c in columns}
    return next((by_name[plain_name(a)] for a in aliases if plain_name(a) in by_name), None)


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns that hold numbers, in table order.

    Text columns count when every filled cell parses; finding that out takes one aggregation job.
    """
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    parsed = set()
    if text:
        cell = lambda c: F.nullif(F.trim(F.col(f"`{c}`")), F.lit(""))
        bad = df.agg(
            *[
                F.count_if(cell(c).isNotNull() & cell(c).try_cast("double").isNull()).alias(str(i))
                for i, c in enumerate(text)
            ]
        ).first()
        parsed = {c for c, unparsed in zip(text, bad) if unparsed == 0}
    return [
        f.name for f in df.schema if isinstance(f.dataType, T.NumericType) or f.name in parsed
    ]


def packet_and_byte_columns(df: DataFrame, allow_proxy: bool = True) -> tuple[str, str]:
    """Names of the packet and byte columns, by alias or (if allowed) by position among numbers."""
    packets = resolve_column(df.columns, PACKETS)
    size = resolve_column(df.columns, BYTES)
    if allow_proxy and not (packets and size):
        size = size or resolve_column(df.columns, BYTES_PROXY)
        numbers = numeric_columns(df)
        packets = packets or (numbers[0] if numbers else None)
        size = size or (numbers[1] if len(numbers) > 1 else None)
    if not (packets and size):
        raise UnresolvedColumns(f"no packet or byte column among {', '.join(df.columns)}")
    return packets, size


def as_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Cells as doubles, parsed once: 0 when missing, not a number, or NaN."""

    def parsed(field: T.StructField) -> Column:
        raw = F.col(f"`{field.name}`")
        known = isinstance(field.dataType, T.NumericType)
        value = raw.cast("double") if known else F.trim(raw.cast("string")).try_cast("double")
        return F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0)).alias(field.name)

    wanted = set(columns)
    return df.select(
        *[parsed(f) if f.name in wanted else F.col(f"`{f.name}`") for f in df.schema]
    )


def cell(name: str) -> Column:
    return F.col(f"`{name}`")


def unit(value: Column) -> Column:
    return clip(value, 0.0, 1.0)


def flag_ratio(columns: Sequence[str], flag: str, flows: Column) -> Column | None:
    """Share of flows with a TCP flag: its flag column, else its count per flow; None if neither."""
    share = resolve_column(columns, SYN_FLAG if flag == "syn" else [f"{flag} flag number"])
    count = resolve_column(columns, [f"{flag} count"])
    if share:
        return unit(cell(share))
    return unit(ratio(cell(count), flows)) if count else None


def syn_ratio(columns: Sequence[str], flows: Column) -> Column:
    """As for the other flags, with a fixed guess if the table has flag columns of another kind."""
    guess = any("flag" in plain_name(c) or "syn" in plain_name(c) for c in columns)
    known = flag_ratio(columns, "syn", flows)
    return F.lit(SYN_GUESS if guess else 0.0) if known is None else known


def unique_count(columns: Sequence[str], aliases: Sequence[str]) -> Column:
    name = resolve_column(columns, aliases)
    if name is None:
        return F.lit(1).cast("long")
    # A missing cell has become 0, which is raised to 1 like any other.
    return F.greatest(F.lit(1).cast("long"), cell(name).try_cast("long"))


def spread(columns: Sequence[str]) -> Column:
    """Standard deviation of bytes, or a quarter of their range."""
    std, low, high = (resolve_column(columns, a) for a in (STD, MIN, MAX))
    if std:
        return clip(cell(std), 0.0)
    return clip((cell(high) - cell(low)) / 4, 0.0) if low and high else F.lit(0.0)


def mean_gap(columns: Sequence[str]) -> Column:
    """Mean inter-arrival time, or the inverse of the packet rate."""
    gap, rate = resolve_column(columns, IAT), resolve_column(columns, RATE)
    if gap:
        return clip(cell(gap), 0.0)
    inverse = F.coalesce(F.try_divide(F.lit(1.0), cell(rate) + 1e-6), F.lit(float("inf"))) if rate else None
    return F.lit(0.0) if inverse is None else clip(inverse, 0.0, 1000.0)


def convert_packet_summaries(
    df: DataFrame,
    label: Column | None = None,
    allow_proxy: bool = True,
    with_legacy: bool = False,
    keep: Sequence[str] = ("source_file",),
) -> DataFrame:
    """Labelled feature rows of packet summaries that share one set of column names.

    Names are resolved while planning; the rows take one projection and a filter. ``label`` defaults
    to the attack type in the dataset name. ``keep`` columns are passed through where they exist.
    """
    kept = [c for c in keep if c in df.columns]
    columns = [c for c in df.columns if c not in kept]
    packets, size = packet_and_byte_columns(df.select(*[f"`{c}`" for c in columns]), allow_proxy)
    # Only these cells can make a feature infinite and so the row invalid; ratios are clipped.
    # Checking them before the projection keeps the filter next to the scan.
    unbounded = {packets, size, resolve_column(columns, STD), resolve_column(columns, IAT)} - {None}
    if not resolve_column(columns, STD):
        unbounded |= {resolve_column(columns, MIN), resolve_column(columns, MAX)} - {None}
    valid = reduce(lambda a, b: a & b, [F.abs(cell(c)) < float("inf") for c in sorted(unbounded)])
    flows = F.greatest(F.lit(1).cast("long"), cell(packets).try_cast("long"))
    named = as_numbers(df, columns).filter(valid).withColumn("_flows", flows)
    n = F.col("_flows")
    zero = F.lit(0.0)

    def per_flow(name: str) -> Column:
        column = resolve_column(columns, [name])
        return unit(ratio(cell(column), n)) if column else zero

    def share(flag: str) -> Column:
        known = flag_ratio(columns, flag, n)
        return zero if known is None else known

    seen = F.lit(0)
    for c in columns:
        if c in PROTOCOLS:
            seen = seen + (cell(c) > 0).cast("int")
    values = {
        "flows": n,
        "bytes_total": round_even(cell(size), 2),
        "pkts_total": n,
        "syn_ratio": round_even(syn_ratio(columns, n), 6),
        "mean_bytes_flow": round_even(cell(size) / n, 6),
        "ack_ratio": round_even(share("ack"), 6),
        "fin_ratio": round_even(share("fin"), 6),
        "rst_ratio": round_even(share("rst"), 6),
        "http_ratio": round_even(per_flow("http"), 6),
        "tcp_ratio": round_even(per_flow("tcp"), 6),
        "protocol_diversity": F.least(F.lit(MAX_PROTOCOLS), seen),
        "std_bytes": round_even(spread(columns), 2),
        "iat_mean": round_even(mean_gap(columns), 6),
    }
    legacy = {}
    if with_legacy:
        legacy = {
            "uniq_src": unique_count(columns, UNIQUE_SRC),
            "uniq_dst": unique_count(columns, UNIQUE_DST),
        }
    rows = named.select(
        *kept,
        *[values[c].alias(c) for c in FEATURES],
        *[v.alias(c) for c, v in legacy.items()],
    )
    return with_attack_label(rows) if label is None else rows.withColumn("label", label)


def conversion_summary(converted: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """Rows per (file, label), and one line with the total (both null).

    ``rejected`` (``source_file``) are files that could not be converted: they are listed without a
    label and with 0 rows.
    """
    counted = _rows_per_file(converted)
    if rejected is None:
        return counted
    failed = rejected.select("source_file", F.lit(None).cast("string").alias("label"), F.lit(0).cast("long").alias("rows"))
    return counted.unionByName(failed)


def _rows_per_file(converted: DataFrame) -> DataFrame:
    return (
        converted.groupBy("source_file", "label")
        .agg(F.count(F.lit(1)).alias("rows"))
        .rollup("source_file", "label")
        .agg(F.sum("rows").alias("rows"), F.grouping_id().alias("_level"))
        .filter(F.col("_level").isin(0, 3))
        .drop("_level")
    )


def conversion_coverage(raw: DataFrame, converted: DataFrame) -> DataFrame:
    """Which raw files have a converted counterpart, and its columns.

    Both tables are file profiles (``file_name``, ``columns``).
    """
    stem = lambda c: F.regexp_replace(c, r"(?<=.)\.[^.]*$", "")
    found = converted.select(
        F.regexp_replace(stem(F.col("file_name")), "_converted$", "").alias("_stem"),
        F.col("columns").alias("converted_columns"),
    )
    out = lookup(raw.withColumn("_stem", stem(F.col("file_name"))), found, ["_stem"])
    return out.select(
        "file_name",
        F.col("converted_columns").isNotNull().alias("converted"),
        "converted_columns",
        F.size(F.array_remove(F.coalesce("converted_columns", F.array().cast("array<string>")), "label")).alias(
            "converted_features"
        ),
    )


def unconverted_files(raw: DataFrame, converted: DataFrame) -> DataFrame:
    return conversion_coverage(raw, converted).filter(~F.col("converted")).select("file_name")

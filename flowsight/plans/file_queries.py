"""Queries over files that are written from the given tables and read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsight.operators import convert
from flowsight.plans import adapters
from flowsight.plans.registry import query
from flowsight.schema import FEATURES
from flowsight.session import scratch_dir
from flowsight.sources import packets

# Dataset names, and the columns under which each one's files hold the same rows.
# The third has no known name for packets and bytes, the fourth no two columns of numbers.
KINDS = {
    "BenignTraffic": {"Number": "l_quantity", "Tot sum": "l_extendedprice", "HTTP": "l_linenumber % 2", "Std": "l_tax"},
    "DDoS-SYN_Flood": {"pkt_number": "l_quantity", "total bytes": "l_extendedprice", "syn_flag_number": "l_discount", "IAT": "l_tax"},
    "SqlInjection": {"alpha": "l_quantity", "note": "l_returnflag", "beta": "l_extendedprice", "ack_flag_number": "l_discount"},
    "Mirai-udpplain": {"gamma": "l_quantity", "note": "l_returnflag", "remark": "l_linestatus"},
}
PATTERN = "*.csv"


def written(spark, sf_dir, name: str = "captures") -> str:
    """A folder with the line items as packet summaries: one dataset, and one header, per supplier number."""
    path = scratch_dir(spark, name)
    rows = adapters.table(spark, sf_dir, "lineitem")
    for i, (dataset, columns) in enumerate(KINDS.items()):
        own = rows.filter(F.col("l_suppkey") % len(KINDS) == i).select(*[F.expr(e).alias(c) for c, e in columns.items()])
        # the writer begins file names with the dataset's
        own.write.option("header", True).option("mapreduce.output.basename", dataset).mode("append").csv(path)
    return path


def dataset_of(name: str) -> Column:
    return F.regexp_extract(name, r"^(.*?)-\d{5}-", 1)


def label_of() -> Column:
    """The label without what the writer put behind the dataset's name."""
    return F.regexp_replace("label", r"_\d{5}_.*", "")


def kind_sql(column: str, values: list[str]) -> str:
    return "CASE l_suppkey % 4 " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + f" END AS {column}"


PACKETS = f"""
captured AS (
  SELECT l_suppkey % 4 AS kind, {kind_sql("dataset", [f"'{d}'" for d in KINDS])},
         {kind_sql("label", ["'benigntraffic'", "'ddos_syn'", "'injection_sql'", "'mirai_udp'"])},
         greatest(1, CAST(trunc(l_quantity) AS BIGINT)) AS n, l_extendedprice AS size,
         CASE WHEN l_suppkey % 4 = 0 THEN l_linenumber % 2 ELSE 0 END AS http,
         {kind_sql("syn", ["0.0::DOUBLE", "l_discount", "0.1::DOUBLE", "0.0::DOUBLE"])},
         CASE WHEN l_suppkey % 4 = 2 THEN l_discount ELSE 0.0::DOUBLE END AS ack,
         CASE WHEN l_suppkey % 4 = 0 THEN l_tax ELSE 0.0::DOUBLE END AS std,
         CASE WHEN l_suppkey % 4 = 1 THEN l_tax ELSE 0.0::DOUBLE END AS iat
  FROM lineitem
)"""
VALUES = {
    "flows": "n", "bytes_total": "round_even(size, 2)", "pkts_total": "n",
    "syn_ratio": "round_even(least(1, greatest(0, syn)), 6)", "mean_bytes_flow": "round_even(size / n, 6)",
    "ack_ratio": "round_even(least(1, greatest(0, ack)), 6)", "fin_ratio": "0.0::DOUBLE", "rst_ratio": "0.0::DOUBLE",
    "http_ratio": "round_even(least(1, http / CAST(n AS DOUBLE)), 6)", "tcp_ratio": "0.0::DOUBLE",
    "protocol_diversity": "CAST(http > 0 AS INTEGER)", "std_bytes": "round_even(greatest(0, std), 2)",
    "iat_mean": "round_even(greatest(0, iat), 6)",
}


@query(f"""
WITH {PACKETS}
SELECT dataset, label, {", ".join(f"{VALUES[c]} AS {c}" for c in FEATURES)} FROM captured WHERE kind < 3""")
def packet_files(spark, sf_dir):
    """Files of four headers, found, read and converted; names by alias, by place, and rejected ones."""
    good, _ = packets.convert_files(packets.read_packet_summaries(spark, written(spark, sf_dir), PATTERN))
    return good.select(dataset_of("source_file").alias("dataset"), label_of().alias("label"), *FEATURES)


@query(f"""
WITH {PACKETS}, lines AS (
  SELECT dataset, CASE WHEN kind < 3 THEN label END AS label, count(*) FILTER (kind < 3) AS rows FROM captured GROUP BY ALL
)
SELECT dataset, label, CAST(rows AS BIGINT) AS rows FROM lines
UNION ALL SELECT NULL, NULL, count(*) FROM captured WHERE kind < 3""")
def file_conversion_summary(spark, sf_dir):
    """Rows per dataset and label, rejected files with none, and the total."""
    good, bad = packets.convert_files(packets.read_packet_summaries(spark, written(spark, sf_dir), PATTERN))
    report = convert.conversion_summary(good, bad)
    return report.groupBy(dataset_of("source_file").alias("dataset"), label_of().alias("label")).agg(F.sum("rows").alias("rows"))


def profiles(spark, path: str) -> DataFrame:
    """One profile per dataset and header, under the dataset's name."""
    found = packets.schema_profile(packets.file_headers(spark, path, PATTERN), shown=2)
    return found.withColumn("file_name", F.concat(dataset_of("file_name"), F.lit(".pcap.csv"))).distinct()


PROFILES = "VALUES " + ", ".join(
    f"({i}, '{d}.pcap.csv', '{','.join(c)}', {len(c)}, '{','.join(list(c)[:2])}')" for i, (d, c) in enumerate(KINDS.items())
)


@query(f"""
SELECT file_name, columns, CAST(n AS INTEGER) AS column_count, FALSE AS has_label, CAST(n AS INTEGER) AS feature_count, first_columns
FROM ({PROFILES}) p(kind, file_name, columns, n, first_columns)
WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey % 4 = kind)""")
def file_profiles(spark, sf_dir):
    return profiles(spark, written(spark, sf_dir))


@query(f"""
SELECT file_name, kind < 3 AS converted, CASE WHEN kind < 3 THEN '{",".join([*FEATURES, "label"])}' END AS converted_columns,
       CAST(CASE WHEN kind < 3 THEN {len(FEATURES)} ELSE 0 END AS INTEGER) AS converted_features
FROM ({PROFILES}) p(kind, file_name, columns, n, first_columns)
WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey % 4 = kind)""")
def conversion_coverage(spark, sf_dir):
    """Which captures have a converted file, from the headers of both."""
    path = written(spark, sf_dir)
    good, _ = packets.convert_files(packets.read_packet_summaries(spark, path, PATTERN))
    done = scratch_dir(spark, "converted")
    for dataset in list(KINDS)[:3]:
        rows = good.filter(dataset_of("source_file") == dataset).select(*FEATURES, "label")
        rows.write.option("header", True).option("mapreduce.output.basename", dataset).mode("append").csv(done)
    converted = packets.schema_profile(packets.file_headers(spark, done, PATTERN))
    converted = converted.withColumn("file_name", F.concat(dataset_of("file_name"), F.lit(".pcap_converted.csv")))
    return convert.conversion_coverage(profiles(spark, path), converted.select("file_name", "columns").distinct())


@query(f"""
WITH {PACKETS} SELECT dataset, label, n AS flows, greatest(1, CAST(trunc(size) AS BIGINT)) AS uniq_src,
       CAST(1 AS BIGINT) AS uniq_dst FROM captured""")
def legacy_columns(spark, sf_dir):
    """Endpoint counts of the older layout: from their column, or 1 where there is none."""
    rows = adapters.table(spark, sf_dir, "lineitem")
    names = F.get(F.array(*[F.lit(d) for d in KINDS]), (F.col("l_suppkey") % 4).cast("int"))
    raw = rows.select(
        F.col("l_quantity").alias("packets"), F.col("l_extendedprice").alias("bytes"), F.col("l_extendedprice").alias("Src Count"),
        names.alias("source_file"),
    )
    out = convert.convert_packet_summaries(raw, with_legacy=True)
    return out.select(F.col("source_file").alias("dataset"), "label", "flows", "uniq_src", "uniq_dst")


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("""
WITH guessed AS (SELECT l_orderkey, l_linenumber, l_discount, unnest(range(4)) AS kind FROM lineitem)
SELECT CASE kind WHEN 0 THEN 'share' WHEN 1 THEN 'count' WHEN 2 THEN 'other flags' ELSE 'none' END AS columns,
       count(*) AS rows,
       CAST(sum(CASE kind WHEN 0 THEN round_even(l_discount, 6) WHEN 1 THEN 0.5 WHEN 2 THEN 0.1 ELSE 0 END * 1000000) AS BIGINT) AS syn_total
FROM guessed GROUP BY 1""")
def syn_guess(spark, sf_dir):
    """SYN share from its column, from a count, guessed beside other flag columns, and absent."""
    rows = adapters.table(spark, sf_dir, "lineitem")
    base = rows.select(F.lit(2).alias("packets"), F.lit(10).alias("bytes"), "l_discount")
    kinds = {
        "share": base.withColumnRenamed("l_discount", "SYN Flag Number"),
        "count": base.withColumn("syn_count", F.lit(1)).drop("l_discount"),
        "other flags": base.withColumnRenamed("l_discount", "urg_flag_number"),
        "none": base.drop("l_discount"),
    }
    label = F.lit("x")
    parts = [convert.convert_packet_summaries(df, label=label).select(F.lit(k).alias("columns"), "syn_ratio") for k, df in kinds.items()]
    total = F.sum(F.round(F.col("syn_ratio") * 1_000_000).cast("long"))
    return union(parts).groupBy("columns").agg(F.count("*").alias("rows"), total.alias("syn_total"))

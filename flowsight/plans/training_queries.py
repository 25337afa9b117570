"""Queries over packet summaries: conversion, cleaning, labels, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsight.functions import labels as lb
from flowsight.functions.decision import attack_type
from flowsight.operators import clean, convert, evaluate as ev, split
from flowsight.plans import adapters
from flowsight.plans.adapters import DATASETS
from flowsight.plans.quality_queries import CELLS_SQL, NAMES_SQL, RATES_SQL
from flowsight.plans.registry import query, rounded
from flowsight.schema import FEATURES

# The label of each dataset name, spelled out (the queries work it out by rule).
# As in functions/labels.py.
LABELS = [
    "hijacking", "injection_command", "ddos_ack", "ddos_http", "ddos_icmp", "ddos_icmp", "ddos_ack",
    "ddos_other", "ddos_slowloris", "ddos_syn", "ddos_syn", "ddos_tcp", "ddos_udp", "ddos_udp",
    "bruteforce", "spoofing_dns", "ddos_http", "ddos_syn", "ddos_tcp", "ddos_udp", "mirai_greeth",
    "mirai_greip", "mirai_udp", "spoofing_arp", "recon_hostdiscovery", "recon_osscan",
    "recon_pingsweep", "recon_portscan", "injection_sql", "upload_attack", "vulnerability_scan",
    "xss", "benigntraffic",
]
LABELS_SQL = "[" + ", ".join(f"'{x}'" for x in LABELS) + "]"

PLACE = f"CAST(1 + l_suppkey % {len(DATASETS)} AS INTEGER)"


def converted_sql(variant: str) -> str:
    std = "l_extendedprice / 10" if variant == "B" else "greatest(0, (l_extendedprice - l_tax) / 4)"
    gap = "l_tax * 3" if variant == "B" else "least(1000, greatest(0, 1.0::DOUBLE / (l_quantity + 1e-6)))"
    return f"""
raw AS (
  SELECT *, greatest(1, CAST(trunc(l_quantity) AS BIGINT)) AS n, {NAMES_SQL}[{PLACE}] AS source_file,
         {LABELS_SQL}[{PLACE}] AS label
  FROM lineitem
), converted AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, source_file, n AS flows,
         round_even(l_extendedprice, 2) AS bytes_total, n AS pkts_total,
         round_even(least(1, greatest(0, l_discount * 10)), 6) AS syn_ratio,
         round_even(l_extendedprice / n, 6) AS mean_bytes_flow,
         round_even(least(1, l_linenumber / CAST(n AS DOUBLE)), 6) AS ack_ratio,
         0.0::DOUBLE AS fin_ratio, 0.0::DOUBLE AS rst_ratio,
         round_even(least(1, (l_linenumber % 2) / CAST(n AS DOUBLE)), 6) AS http_ratio,
         round_even(least(1, 1 / CAST(n AS DOUBLE)), 6) AS tcp_ratio,
         CAST(1 + l_linenumber % 2 + l_partkey % 2 AS INTEGER) AS protocol_diversity,
         round_even({std}, 2) AS std_bytes, round_even({gap}, 6) AS iat_mean, label
  FROM raw
)"""


CONVERTED = converted_sql("A")
COLUMNS = ", ".join(FEATURES)


def converted(spark, sf_dir, variant="A"):
    return convert.convert_packet_summaries(adapters.packet_summaries(spark, sf_dir, variant))


def positioned(spark, sf_dir):
    """Converted rows with a unique position in their dataset."""
    position = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey") * 10
    summaries = adapters.packet_summaries(spark, sf_dir, "A", {"row_position": position + F.col("l_suppkey") % 10})
    return convert.convert_packet_summaries(summaries, keep=("source_file", "row_position"))


POSITIONED = f"""{CONVERTED}, placed AS (
  SELECT *, (l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey * 10 + l_suppkey % 10 AS row_position
  FROM converted
)"""


@query(f"WITH {CONVERTED} SELECT source_file, {COLUMNS}, label FROM converted")
def packet_features(spark, sf_dir):
    return converted(spark, sf_dir)


@query(f"WITH {converted_sql('B')} SELECT source_file, {COLUMNS}, label FROM converted")
def packet_features_std_iat(spark, sf_dir):
    return converted(spark, sf_dir, "B")


@query(f"""
WITH {CONVERTED}, lines AS (SELECT source_file, label, count(*) AS rows FROM converted GROUP BY 1, 2)
SELECT * FROM lines UNION ALL SELECT NULL, NULL, count(*) FROM converted""")
def conversion_summary(spark, sf_dir):
    return convert.conversion_summary(converted(spark, sf_dir))


@query(f"""
WITH {CONVERTED}
SELECT source_file, label, count(*) AS rows,
       CAST(lower(label) <> 'benign' AS INTEGER) AS y_benign,
       CAST(lower(label) NOT IN ('benign', 'normal') AS INTEGER) AS y_benign_normal,
       CAST(NOT (label = 'benign' OR lower(label) IN ('benign', 'benigntraffic', 'benign_final', 'normal',
                                                      'benign_sim', 'ciciot_benign')) AS INTEGER) AS y_tokens,
       CASE WHEN contains(lower(source_file), 'benign') THEN 'benign' ELSE 'attack' END AS inferred,
       contains(lower(source_file), 'flood') OR contains(lower(source_file), 'scan') AS excluded
FROM converted GROUP BY 1, 2""")
def dataset_labels(spark, sf_dir):
    name, label = F.col("source_file"), F.col("label")
    rows = converted(spark, sf_dir).groupBy("source_file", "label").agg(F.count(F.lit(1)).alias("rows"))
    return rows.select(
        "source_file",
        "label",
        "rows",
        lb.binary_label(label).alias("y_benign"),
        lb.binary_label(label, "benign_normal").alias("y_benign_normal"),
        lb.binary_label(label, "tokens").alias("y_tokens"),
        lb.inferred_label(name).alias("inferred"),
        lb.excluded_dataset(name, ["flood", "scan"]).alias("excluded"),
    )


# Cells as text, some of them padded, unparsable, NaN or infinite.
# Every feature has malformed cells, each in rows of its own.
FAULTY = 97


def messy_sql(i: int) -> str:
    return f"""CASE (l_partkey + {7 * i}) % {FAULTY} WHEN 0 THEN 'abc' WHEN 1 THEN 'NaN' WHEN 2 THEN 'inf' WHEN 3 THEN ''
              WHEN 4 THEN NULL ELSE '  ' || CAST(CAST(l_quantity AS BIGINT) + {i} AS VARCHAR) || '.5 ' END"""


MESSY = f"""
messy AS (
  SELECT l_orderkey, l_linenumber, l_partkey, {", ".join(f"{messy_sql(i)} AS {c}" for i, c in enumerate(FEATURES))}
  FROM lineitem
)"""
# Cells of the messy table as numbers, and what makes a row malformed or invalid.
NUMBERS = {c: f"CASE WHEN {c} = 'inf' THEN 'Infinity'::DOUBLE ELSE TRY_CAST(trim({c}) AS DOUBLE) END" for c in FEATURES}
MALFORMED = " OR ".join(f"coalesce({c}, '') IN ('abc', 'NaN', '')" for c in FEATURES)
INFINITE = " OR ".join(f"{c} = 'inf'" for c in FEATURES)


def messy_cells(spark, sf_dir):
    def cell(i):
        k = (F.col("l_partkey") + 7 * i) % FAULTY
        # whole numbers as the SQL casts them, half to even; a null or negative key spoils no cell
        text = F.concat(F.lit("  "), (F.rint("l_quantity").cast("long") + i).cast("string"), F.lit(".5 "))
        faulty = F.when(k == 0, "abc").when(k == 1, "NaN").when(k == 2, "inf").when(k == 3, "")
        return faulty.when(k == 4, F.lit(None)).otherwise(text)

    cells = [cell(i).alias(c) for i, c in enumerate(FEATURES)]
    return adapters.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *cells)


@query(f"""
WITH {MESSY}
SELECT l_orderkey, l_linenumber, l_partkey, {", ".join(f"{v} AS {c}" for c, v in NUMBERS.items())}
FROM messy WHERE NOT ({MALFORMED})""")
def clean_features(spark, sf_dir):
    return clean.clean_features(messy_cells(spark, sf_dir))


@query(f"""
WITH {MESSY}
SELECT count(*) AS rows, count(*) FILTER ({MALFORMED}) AS dropped FROM messy""")
def malformed_count(spark, sf_dir):
    return clean.malformed_count(messy_cells(spark, sf_dir))


@query(f"""
WITH {MESSY}
SELECT l_orderkey, l_linenumber, l_partkey,
       {", ".join(f"CASE WHEN coalesce({c}, '') IN ('abc', 'NaN', '', 'inf') THEN 0.0::DOUBLE ELSE CAST(trim({c}) AS DOUBLE) END AS {c}" for c in FEATURES[:-1])},
       0.0::DOUBLE AS {FEATURES[-1]}
FROM messy""")
def prepare_features(spark, sf_dir):
    """Evaluation input from messy cells under spaced names, without the last feature."""
    cells = messy_cells(spark, sf_dir).drop(FEATURES[-1])
    cells = clean.to_numeric(cells, FEATURES[:-1]).withColumnsRenamed({c: f" {c.replace('_', ' ')} " for c in FEATURES})
    return clean.prepare_features(cells)


@query(f"""
WITH {MESSY}
SELECT l_orderkey, l_linenumber, l_partkey, {", ".join(f"{v} AS {c}" for c, v in NUMBERS.items())}
FROM messy WHERE NOT ({MALFORMED}) AND NOT ({INFINITE})""")
def drop_invalid(spark, sf_dir):
    return clean.drop_invalid(clean.to_numeric(messy_cells(spark, sf_dir)))


SPLIT = f"""{POSITIONED}, counted AS (
  SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY row_position) AS place,
         count(*) OVER (PARTITION BY source_file) AS total
  FROM placed
), parted AS (
  SELECT * REPLACE (CASE WHEN source_file = 'BenignTraffic' THEN 'benign' ELSE label END AS label),
         CASE WHEN source_file = 'BenignTraffic'
                THEN CASE WHEN place <= floor(total * 0.8::DOUBLE) THEN 'train' ELSE 'test' END
              WHEN source_file IN ('DDoS-SYN_Flood', 'Mirai-udpplain', 'SqlInjection', 'Recon-PortScan',
                                   'DDoS-ACK_Fragmentation') THEN 'test' ELSE 'train' END AS part
  FROM counted
)"""


@query(f"WITH {SPLIT} SELECT source_file, row_position, {COLUMNS}, label, part FROM parted")
def file_split(spark, sf_dir):
    return split.split_by_file(positioned(spark, sf_dir))


@query(f"WITH {SPLIT} SELECT DISTINCT {COLUMNS}, label FROM parted WHERE part = 'train'")
def training_set(spark, sf_dir):
    parts = split.split_by_file(positioned(spark, sf_dir))
    return split.training_set(parts.filter(F.col("part") == "train"))


@query(f"""
WITH {SPLIT}, rows AS (SELECT {COLUMNS}, label FROM parted WHERE part = 'train')
SELECT (SELECT count(*) FROM rows) AS before, (SELECT count(*) FROM (SELECT DISTINCT * FROM rows)) AS after,
       (SELECT count(*) FROM rows) - (SELECT count(*) FROM (SELECT DISTINCT * FROM rows)) AS dropped""")
def duplicate_count(spark, sf_dir):
    parts = split.split_by_file(positioned(spark, sf_dir))
    return split.duplicate_count(clean.core_columns(parts.filter(F.col("part") == "train")))


@query(f"""
WITH {converted_sql('A')}, other AS (
  SELECT source_file, CAST(l_tax * 3 AS DOUBLE) AS idle FROM raw WHERE l_returnflag = 'N'
)
SELECT source_file, flows, label, NULL::DOUBLE AS idle FROM converted
UNION ALL SELECT source_file, NULL, NULL, idle FROM other""")
def dataset_union(spark, sf_dir):
    left = converted(spark, sf_dir).select("source_file", "flows", "label")
    right = adapters.table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == "N").select(
        adapters.dataset_name(F.col("l_suppkey")).alias("source_file"), (F.col("l_tax") * 3).alias("idle")
    )
    return split.union_datasets(left, right)


KEYED = """
keyed AS (
  SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y,
         md5(CAST(o_orderkey AS VARCHAR) || '|42') AS h FROM orders
)"""


@query(f"""
WITH {KEYED}
SELECT o_orderkey, y,
       row_number() OVER (PARTITION BY y ORDER BY h) <= floor(count(*) OVER (PARTITION BY y) * 0.2::DOUBLE)
         AS is_validation
FROM keyed""")
def stratified_split(spark, sf_dir):
    orders = adapters.table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("y")
    )
    return split.stratified_split(orders, ["o_orderkey"])


@query(f"""
WITH {KEYED}, n AS (SELECT y, count(*) AS rows FROM keyed GROUP BY 1)
SELECT o_orderkey, y, round_even((SELECT sum(rows) FROM n) / CAST((SELECT count(*) FROM n) * n.rows AS DOUBLE), 6) AS weight
FROM keyed JOIN n USING (y)""")
def balanced_weights(spark, sf_dir):
    orders = adapters.table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("y")
    )
    return rounded(split.balanced_weights(orders))


@query(f"""
WITH {POSITIONED}, capped AS (
  SELECT * FROM placed QUALIFY row_number() OVER (PARTITION BY source_file ORDER BY row_position) <= 300
)
SELECT cycle, source_file, row_position, {COLUMNS} FROM capped, (VALUES (1), (2)) c(cycle)""")
def replay_feed(spark, sf_dir):
    return split.replay_feed(positioned(spark, sf_dir), cycles=2, rows_per_file=300)


HELD_OUT = f"""{CONVERTED}, held AS (
  SELECT *, CASE WHEN contains(lower(source_file), 'benign') THEN 0 ELSE 1 END AS y,
         CASE WHEN round(1 / (1 + exp(-(12 * syn_ratio - 10 * ack_ratio))), 9) >= 0.5 THEN 1 ELSE 0 END AS pred
  FROM converted WHERE NOT contains(lower(source_file), 'recon')
)"""


@query(f"WITH {HELD_OUT}, cells AS (SELECT {CELLS_SQL} FROM held) SELECT *, {RATES_SQL} FROM cells")
def holdout_metrics(spark, sf_dir):
    return rounded(ev.rates(ev.confusion(held_out(spark, sf_dir))))


@query(f"""
WITH {HELD_OUT}
SELECT source_file, count(*) AS samples, CAST(sum(pred) AS BIGINT) AS detected,
       round_even(sum(pred) / CAST(count(*) AS DOUBLE), 6) AS rate,
       CASE WHEN avg(y) > 0.5 THEN 'ATTACK' ELSE 'BENIGN' END AS status
FROM held GROUP BY 1""")
def holdout_datasets(spark, sf_dir):
    report = ev.dataset_report(held_out(spark, sf_dir))
    return rounded(report.select("source_file", "samples", "detected", "rate", "status"))


def held_out(spark, sf_dir):
    """Scored rows of the datasets that stay in the evaluation, with labels from their names."""
    name = F.col("source_file")
    rows = converted(spark, sf_dir).drop("label").filter(~lb.excluded_dataset(name, ["recon"]))
    rows = clean.prepare_features(rows.withColumn("label", lb.inferred_label(name)))
    rows = rows.withColumn("y", lb.binary_label(F.col("label"), "benign_normal"))
    return ev.predict(rows.withColumn("score", adapters.fixed_score()), 0.5)


@query(f"""
WITH {CONVERTED}, typed AS (
  SELECT *, CASE WHEN http_ratio > 0.5 THEN 'Web Attack (HTTP)' WHEN syn_ratio > 0.6 THEN 'DDoS: SYN Flood'
       WHEN rst_ratio > 0.5 THEN 'Recon: Port Scan (RST)'
       WHEN pkts_total < 3 AND flows > 20 THEN 'Recon: Port Scan (Stealth)'
       WHEN bytes_total > 5000000 OR pkts_total > 10000 THEN 'DDoS: Volumetric (Mirai/UDP)'
       WHEN mean_bytes_flow > 5000 AND syn_ratio < 0.1 THEN 'Exfiltration / Upload'
       ELSE 'General Anomaly' END AS attack_type FROM converted
)
SELECT attack_type, label, count(*) AS rows FROM typed GROUP BY 1, 2""")
def packet_attack_types(spark, sf_dir):
    rows = converted(spark, sf_dir)
    return rows.groupBy(attack_type().alias("attack_type"), "label").agg(F.count(F.lit(1)).alias("rows"))

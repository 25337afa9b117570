"""Dataset names, attack labels and binary labels."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Attack families in the order they are tried. A family applies when the lower-cased
# name holds one of its words; within it the first matching word gives the label, else the default.
ATTACK_FAMILIES = [
    (
        ["ddos", "dos"],
        [
            ("http", "ddos_http"),
            ("syn", "ddos_syn"),
            ("tcp", "ddos_tcp"),
            ("udp", "ddos_udp"),
            ("icmp", "ddos_icmp"),
            ("slowloris", "ddos_slowloris"),
            ("ack", "ddos_ack"),
            ("fragmentation", "ddos_fragmentation"),
        ],
        "ddos_other",
    ),
    (
        ["mirai"],
        [("greeth", "mirai_greeth"), ("greip", "mirai_greip"), ("udp", "mirai_udp")],
        "mirai_other",
    ),
    (
        ["recon"],
        [
            ("port", "recon_portscan"),
            ("host", "recon_hostdiscovery"),
            ("os", "recon_osscan"),
            ("ping", "recon_pingsweep"),
        ],
        "recon_other",
    ),
    (
        ["injection"],
        [("sql", "injection_sql"), ("command", "injection_command")],
        "injection_other",
    ),
    (
        ["spoofing"],
        [("dns", "spoofing_dns"), ("arp", "spoofing_arp"), ("mitm", "spoofing_arp")],
        "spoofing_other",
    ),
    (["brute"], [], "bruteforce"),
    (["xss"], [], "xss"),
    (["hijacking"], [], "hijacking"),
    (["scan"], [], "vulnerability_scan"),
    (["upload"], [], "upload_attack"),
]

# Labels that count as benign under the "tokens" rule.
BENIGN_TOKENS = [
    "benign",
    "benigntraffic",
    "benign_final",
    "normal",
    "benign_sim",
    "ciciot_benign",
]

# Name parts of enterprise (non-IoT) datasets left out of the holdout evaluation.
EXCLUDED_DATASETS = [
    "monday-workinghours",
    "tuesday-workinghours",
    "wednesday-workinghours",
    "thursday-morning-webattacks",
    "thursday-afternoon-infiltration",
    "friday-morning_13f",
    "friday-afternoon-ddos_13f",
    "friday-afternoon-portscan_13f",
]


def holds_any(text: Column, words: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def file_stem(name: Column) -> Column:
    """File name without folder, last extension and ``.pcap``."""
    base = F.regexp_replace(name, r"^.*/", "")
    return F.replace(F.regexp_replace(base, r"(?<=.)\.[^.]*$", ""), F.lit(".pcap"), F.lit(""))


def family_label(lower: Column) -> Column:
    """Attack type of a lower-cased dataset name."""
    rules = []
    for words, members, default in ATTACK_FAMILIES:
        label = F.lit(default)
        for word, name_of_word in reversed(members):
            label = F.when(lower.contains(word), F.lit(name_of_word)).otherwise(label)
        rules.append(F.when(holds_any(lower, words), label))
    return F.coalesce(*rules, F.translate(lower, "- ", "__"))


def attack_label(name: Column) -> Column:
    """Attack type of a dataset, from its file name."""
    return family_label(F.lower(file_stem(name)))


def with_attack_label(df: DataFrame, file: str = "source_file", label: str = "label") -> DataFrame:
    """Adds the attack type; the cleaned name is worked out once per row, not once per word."""
    named = df.withColumn("_name", F.lower(file_stem(F.col(file))))
    return named.withColumn(label, family_label(F.col("_name"))).drop("_name")


def binary_label(
    label: Column,
    rule: str = "benign",
    numeric: bool = False,
    benign_name: str = "benign",
    benign_index: int = 0,
    tokens: Iterable[str] = BENIGN_TOKENS,
) -> Column:
    """0 for benign, 1 for everything else.

    ``benign``: only the word benign (a numeric label is taken as it is). ``benign_normal``: benign
    or normal. ``tokens``: the configured benign name or any benign token; a numeric label is
    benign when it equals the configured index. A missing label counts as an attack.
    """
    lower = F.lower(label.cast("string"))
    if rule == "benign":
        if numeric:
            return label.cast("int")
        benign = lower == "benign"
    elif rule == "benign_normal":
        benign = lower.isin("benign", "normal")
    elif rule == "tokens":
        if numeric:
            benign = label == F.lit(benign_index)
        else:
            benign = (label == F.lit(benign_name)) | lower.isin(list(tokens))
    else:
        raise ValueError(f"unknown label rule {rule!r}")
    return (~F.coalesce(benign, F.lit(False))).cast("int")


def inferred_label(name: Column, otherwise: str = "attack") -> Column:
    """Label of an unlabelled dataset: benign when its name says so.

    Other datasets get the word ``attack`` (evaluation) or, with ``otherwise="stem"``, their
    cleaned file name (training).
    """
    stem = F.replace(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), F.lit("_converted"), F.lit(""))
    other = F.replace(stem, F.lit(".pcap"), F.lit("")) if otherwise == "stem" else F.lit(otherwise)
    return F.when(F.lower(name).contains("benign"), F.lit("benign")).otherwise(other)


def excluded_dataset(name: Column, patterns: Iterable[str] = EXCLUDED_DATASETS) -> Column:
    return holds_any(F.lower(name), patterns)

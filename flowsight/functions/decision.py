"""Per-row decision expressions: attack type, class, severity, reason texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.ml.functions import vector_to_array

KILL_SCORE = 0.98  # fixed value: scores from here on get the strongest response


def attack_type(row=F.col) -> Column:
    """Attack type suggested by the traffic features; the first rule that holds wins."""
    # Rules and names in the order they are tried.
    rules = [
        (row("http_ratio") > 0.5, "Web Attack (HTTP)"),
        (row("syn_ratio") > 0.6, "DDoS: SYN Flood"),
        (row("rst_ratio") > 0.5, "Recon: Port Scan (RST)"),
        ((row("pkts_total") < 3) & (row("flows") > 20), "Recon: Port Scan (Stealth)"),
        (
            (row("bytes_total") > 5_000_000) | (row("pkts_total") > 10_000),
            "DDoS: Volumetric (Mirai/UDP)",
        ),
        ((row("mean_bytes_flow") > 5000) & (row("syn_ratio") < 0.1), "Exfiltration / Upload"),
    ]
    return F.coalesce(*[F.when(hit, F.lit(name)) for hit, name in rules], F.lit("General Anomaly"))


def attack_score(probability: Column, benign_index: int | None = None, vector: bool = True) -> Column:
    """P(attack): the second class of a binary model, or 1 - P(benign) when the index is known."""
    p = vector_to_array(probability) if vector else probability
    if benign_index is None:
        return p[1]
    return F.lit(1.0) - p[benign_index]


def top_class(probability: Column, classes: list[str], vector: bool = True) -> Column:
    """Name of the most probable class (the first one on ties)."""
    p = vector_to_array(probability) if vector else probability
    names = F.array(*[F.lit(c) for c in classes])
    return F.get(names, F.array_position(p, F.array_max(p)).cast("int") - 1)


def predicted_class(score: Column, threshold: Column, model_class: Column) -> Column:
    """The model's class, replaced by the attack type from the base threshold on."""
    return F.when(score >= threshold, attack_type()).otherwise(model_class)


def severity(is_attack: Column, score: Column, instant_block: Column, soft: Column) -> Column:
    graded = (
        F.when(score >= KILL_SCORE, F.lit("KILL"))
        .when(score >= instant_block, F.lit("HARD"))
        .when(soft, F.lit("SOFT"))
        .otherwise(F.lit("NONE"))
    )
    return F.when(is_attack, graded).otherwise(F.lit("NONE"))


def no_block_reason(
    is_attack: Column,
    cooled_down: Column,
    level: Column,
    hits: Column,
    score: Column,
    grace: Column,
    cooldown_sec: Column,
    instant_block: Column,
) -> Column:
    """Why a row was not blocked; null when it was."""
    return (
        F.when(level != "NONE", F.lit(None).cast("string"))
        .when(~is_attack, F.lit("benign"))
        .when(~cooled_down, F.concat(F.lit("cooldown "), plain_number(cooldown_sec), F.lit("s")))
        .otherwise(
            F.concat(
                F.lit("below criteria (hits="),
                hits.cast("string"),
                F.lit("<"),
                grace.cast("string"),
                F.lit(", score="),
                F.format_string("%.3f", score),
                F.lit("<"),
                instant_block.cast("string"),
                F.lit(")"),
            )
        )
    )


def plain_number(value: Column) -> Column:
    """A number as text, without decimals when it is whole."""
    whole = value == F.floor(value)
    return F.when(whole, F.floor(value).cast("string")).otherwise(value.cast("string"))


def block_outcome(ip: Column, dry_run: Column, level: Column) -> tuple[Column, Column]:
    """(ok, how) of a block request; without dry run the request is left pending for the actor."""
    no_ip = ip.isNull() | (ip == "")
    wanted = level != "NONE"
    ok = F.when(wanted, F.when(no_ip, F.lit(False)).when(dry_run, F.lit(True)))
    how = F.when(
        wanted,
        F.when(no_ip, F.lit("no-ip"))
        .when(dry_run, F.concat(F.lit("dry-run-"), F.lower(level)))
        .otherwise(F.lit("pending")),
    )
    return ok, how


def top_contributions(names: list[str], values: Column, top_n: int = 3) -> Column:
    """The ``top_n`` positive contributions of a row, largest first (model order on ties)."""
    # Sorted on the negated value and the position, so the natural ascending order is enough.
    pairs = F.transform(
        values, lambda v, i: F.struct((-v).alias("neg"), i.alias("pos"), v.alias("value"))
    )
    positive = F.array_sort(F.filter(pairs, lambda p: p["value"] > 0))
    feature_names = F.array(*[F.lit(n) for n in names])
    return F.transform(
        F.slice(positive, 1, top_n),
        lambda p: F.struct(F.get(feature_names, p["pos"]).alias("feature"), p["value"].alias("value")),
    )


def reason_text(top: Column) -> Column:
    """Contributions as one line of text; a row nothing pushed up gets ``global bias``."""
    parts = F.transform(top, lambda p: F.format_string("%s (+%.2f)", p["feature"], p["value"]))
    return F.when(F.size(top) == 0, F.lit("global bias")).otherwise(F.array_join(parts, ", "))


def threat_text(threat: Column) -> Column:
    """Flag, country and threat label in one trimmed string."""
    part = lambda name: F.coalesce(threat[name], F.lit(""))
    return F.trim(F.concat_ws(" ", part("flag"), part("country"), part("threat")))

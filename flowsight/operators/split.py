"""Train and test sets: by file, by position, stratified; replay feeds; class weights."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsight.functions.labels import inferred_label
from flowsight.operators.clean import add_missing_features, core_columns
from flowsight.operators.lookups import lookup_small
from flowsight.operators.ordering import count_bucket, head_cuts
from flowsight.schema import FEATURES

# Datasets kept out of training, left out altogether, and split by position
# (name prefix or name, share that goes to training).
HOLDOUT = [
    "DDoS-SYN_Flood",
    "Mirai-udpplain",
    "SqlInjection",
    "Recon-PortScan",
    "DDoS-ACK_Fragmentation",
]
SKIPPED = ["ciciot_benign_15f"]
REAL_BENIGN, REAL_BENIGN_SHARE = "BenignTraffic", 0.8
SIMULATED_BENIGN, SIMULATED_BENIGN_SHARE = "benign_sim_15f", 0.5

POSITION_BUCKET = 1_000_000


def is_dataset(name: Column, stems: Sequence[str]) -> Column:
    """Whether a file name is one of the datasets, raw or converted.

    Compares whole names, which a scan can check against its statistics, instead of cleaning the
    name of every row.
    """
    endings = ["", ".csv", ".pcap.csv", "_converted.csv", ".pcap_converted.csv", ".pcap"]
    return name.isin([stem + ending for stem in stems for ending in endings])


def head_or_tail(
    df: DataFrame, keys: Sequence[str], order: str, bucket: Column, take: Column, name: str = "in_head"
) -> DataFrame:
    """Marks each group's first rows by ``order``; ``take`` gives how many (from ``total``).

    One cut value per group is worked out from the order column alone; the rows themselves are only
    compared with it, not shuffled.
    """
    cuts = head_cuts(df, keys, order, bucket, take).withColumnRenamed("cut", "_cut")
    return lookup_small(df, cuts, keys).withColumn(name, below_cut(order)).drop("_cut")


def below_cut(order: str) -> Column:
    """Whether a row is in its group's head; a group without a ``_cut`` has none."""
    return F.coalesce(F.col(order) <= F.col("_cut"), F.lit(False))


def split_by_file(df: DataFrame, order: str = "row_position", file: str = "source_file") -> DataFrame:
    """Adds ``part`` (train or test) so that no file leaks from training into the test.

    Whole files go to one side, but for the benign ones, whose first rows go to training. Real
    benign traffic is labelled benign whatever its label was; a missing label is inferred from the
    file name.
    """
    name = F.col(file)
    real = name.startswith(REAL_BENIGN)
    simulated = is_dataset(name, [SIMULATED_BENIGN])
    share = F.when(F.col("_real"), REAL_BENIGN_SHARE).otherwise(SIMULATED_BENIGN_SHARE)
    given = F.col("label") if "label" in df.columns else F.lit(None).cast("string")
    rows = (
        df.filter(~is_dataset(name, SKIPPED))
        .withColumn("_real", real)
        .withColumn("_positional", real | simulated)
        .withColumn(
            "label",
            F.when(F.col("_real"), F.lit("benign")).otherwise(
                F.coalesce(given, inferred_label(F.col(file), otherwise="stem"))
            ),
        )
    )
    # Only the positional files take part in finding the cuts.
    cuts = head_cuts(
        rows.filter("_positional").select(file, "_real", order),
        [file, "_real"],
        order,
        count_bucket(F.col(order), POSITION_BUCKET),
        F.floor(F.col("total") * share),
    ).select(file, F.col("cut").alias("_cut"))
    part = F.when(
        F.when(F.col("_positional"), F.coalesce(F.col(order) <= F.col("_cut"), F.lit(False))).otherwise(
            ~is_dataset(name, HOLDOUT)
        ),
        F.lit("train"),
    ).otherwise(F.lit("test"))
    return lookup_small(rows, cuts, [file]).withColumn("part", part).drop("_cut", "_real", "_positional")


def union_datasets(*frames: DataFrame) -> DataFrame:
    """Rows of all frames by column name; a column a frame lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def duplicate_count(df: DataFrame) -> DataFrame:
    """One row: rows before and after removing duplicates, and their difference."""
    copies = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    return copies.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).cast("long").alias("before"),
        F.count(F.lit(1)).alias("after"),
    ).withColumn("dropped", F.col("before") - F.col("after"))


def row_hash(columns: Sequence[str], seed: int) -> Column:
    """Deterministic hash of a row; a null cell differs from an empty one."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns]
    return F.md5(F.concat_ws("|", *cells, F.lit(str(seed))))


def shuffle_rows(df: DataFrame, seed: int = 42, key: Sequence[str] | None = None) -> DataFrame:
    """Rows in a seeded random order that does not depend on how they were stored.

    ``key`` names the columns that tell rows apart (all of them by default). Rows that are copies
    of each other would sort next to each other, so deduplicate first or give a unique key.
    """
    return df.orderBy(F.xxhash64(*(key or df.columns), F.lit(seed)))


def training_set(train: DataFrame, seed: int = 42) -> DataFrame:
    """Distinct (features, label) rows in a seeded random order."""
    return shuffle_rows(distinct_rows(core_columns(train)), seed)


def stratified_split(
    df: DataFrame,
    key: Sequence[str],
    label: str = "y",
    fraction: float = 0.2,
    seed: int = 42,
    exact: bool = True,
) -> DataFrame:
    """Marks a random share of each class as ``is_validation``.

    Rows are ranked by a hash of their unique ``key``; of each class exactly the floor of its share
    is marked. With ``exact=False`` every row decides by its own hash, without any shuffle.
    """
    hashed = df.withColumn("_hash", row_hash(key, seed))
    if not exact:
        limit = format(int(fraction * 0xFFFFFFFF), "08x")
        return hashed.withColumn("is_validation", F.col("_hash") < limit).drop("_hash")
    cuts = stratified_cuts(hashed, label, fraction).withColumnRenamed("cut", "_cut")
    return lookup_small(hashed, cuts, [label]).withColumn("is_validation", below_cut("_hash")).drop("_hash", "_cut")


def stratified_cuts(hashed: DataFrame, label: str, fraction: float) -> DataFrame:
    """Per class the ``_hash`` of the last row of its share, as ``cut``."""
    # Four hex digits: the hash is uniform, so the one bucket that gets sorted is 1/65536.
    bucket = F.substring("_hash", 1, 4)
    return head_cuts(hashed, [label], "_hash", bucket, F.floor(F.col("total") * fraction))


def balanced_weights(df: DataFrame, label: str = "y") -> DataFrame:
    """Adds ``weight`` = rows / (classes * rows of the class)."""
    return lookup_small(df, class_weights(df, label), [label])


def class_weights(df: DataFrame, label: str = "y") -> DataFrame:
    """The ``weight`` of each class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_rows"))
    totals = counts.agg(F.struct(F.sum("_rows").alias("rows"), F.count(F.lit(1)).alias("classes")))
    return counts.withColumn("_total", totals.scalar()).select(
        label,
        (F.col("_total.rows") / (F.col("_total.classes") * F.col("_rows"))).alias("weight"),
    )


def replay_feed(
    df: DataFrame,
    cycles: int = 1,
    rows_per_file: int | None = None,
    order: str = "row_position",
    file: str = "source_file",
) -> DataFrame:
    """Feature rows of all files, up to a number per file, repeated ``cycles`` times.

    Sort by (``cycle``, file, order) to get the feed in replay order.
    """
    rows = add_missing_features(df).select(file, order, *FEATURES)
    if rows_per_file is not None:
        rows = head_or_tail(
            rows,
            [file],
            order,
            count_bucket(F.col(order), POSITION_BUCKET),
            F.least(F.col("total"), F.lit(rows_per_file)),
        ).filter("in_head").drop("in_head")
    return rows.withColumn("cycle", F.explode(F.sequence(F.lit(1), F.lit(max(cycles, 1)))))

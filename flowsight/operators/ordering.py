"""Ordered work that does not put a whole key in one task.

A window function over (key ORDER BY x) sorts all rows of a key in one task, which fails for a key
that holds a large part of the data. The helpers here cut a key into buckets that follow the order,
reduce each bucket to one row, run the ordered step over those few rows, and hand the result back
to the buckets. The answers are exact and do not depend on where the cuts fall.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowsight.operators.lookups import lookup_small, match


def time_bucket(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(seconds * 1_000_000)).cast("long")


def count_bucket(number: Column, width: int) -> Column:
    return F.floor(number / F.lit(width)).cast("long")


def _before(keys: Sequence[str], order: str) -> W:
    return W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)


def with_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, name: str = "position"
) -> DataFrame:
    """Row number (from 0) within ``keys`` by ``order``; ``bucket`` must not decrease along it."""
    keys = list(keys)
    df = df.withColumn("_bucket", bucket)
    sizes = df.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    starts = sizes.select(
        *keys,
        "_bucket",
        F.coalesce(F.sum("_rows").over(_before(keys, "_bucket")), F.lit(0)).alias("_start"),
    )
    inside = W.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        match(df, starts, [*keys, "_bucket"])
        .withColumn(name, F.col("_start") + F.row_number().over(inside) - 1)
        .drop("_bucket", "_start")
    )


def with_running_max(
    df: DataFrame,
    keys: Sequence[str],
    order: Column,
    bucket: Column,
    value: Column,
    name: str,
) -> DataFrame:
    """Largest non-null ``value`` seen so far within ``keys`` (rows of equal order included)."""
    keys = list(keys)
    df = df.withColumn("_bucket", bucket).withColumn("_value", value)
    peaks = df.groupBy(*keys, "_bucket").agg(F.max("_value").alias("_peak"))
    carried = peaks.select(
        *keys, "_bucket", F.max("_peak").over(_before(keys, "_bucket")).alias("_carried")
    )
    inside = (
        W.partitionBy(*keys, "_bucket")
        .orderBy(order)
        .rangeBetween(W.unboundedPreceding, W.currentRow)
    )
    return (
        match(df, carried, [*keys, "_bucket"])
        .withColumn(name, F.greatest(F.max("_value").over(inside), "_carried"))
        .drop("_bucket", "_value", "_carried")
    )


def with_running_sums(
    df: DataFrame, keys: Sequence[str], order: str, part: Column, measures: Sequence[str]
) -> DataFrame:
    """Replaces ``measures`` by their sums over the group's rows up to and including equal ``order``.

    ``part`` cuts a group into a bounded number of parts along ``order``. The sums of the parts give
    each part's entry totals, after which the parts of a group run side by side.
    """
    keys, whole = list(keys), [*keys, "_part"]
    df = df.withColumn("_part", part)
    sums = df.groupBy(*whole).agg(*[F.sum(m).alias(m) for m in measures])
    before = _before(keys, "_part")
    entries = sums.select(*whole, *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"_entry_{m}") for m in measures])
    upto = W.partitionBy(*whole).orderBy(order).rangeBetween(W.unboundedPreceding, W.currentRow)
    kept = [c for c in df.columns if c not in measures and c != "_part"]
    totals = [(F.sum(m).over(upto) + F.col(f"_entry_{m}")).alias(m) for m in measures]
    return match(df, entries, whole).select(*kept, *totals)


def head_cuts(
    df: DataFrame, keys: Sequence[str], order: str, bucket: Column, take: Column
) -> DataFrame:
    """Per group, the order value of its last head row: one row (``keys``, ``cut``) per group.

    ``take`` gives the head size from the column ``total`` (rows of the group). A group whose head
    is empty has no row. ``order`` must be unique within a group. Only the order column is read,
    and only the one bucket that holds the cut is ever shuffled and sorted. Groups are classes or
    files: their one row each goes to every executor.
    """
    keys = list(keys)
    slim = df.select(*keys, order, bucket.alias("_bucket"))
    sizes = slim.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    whole = W.partitionBy(*keys)
    upto = whole.orderBy("_bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    cut_bucket = (
        sizes.select(
            *keys,
            "_bucket",
            "_rows",
            F.sum("_rows").over(upto).alias("_upto"),
            F.sum("_rows").over(whole).alias("total"),
        )
        .withColumn("_take", take)
        .filter((F.col("_take") > F.col("_upto") - F.col("_rows")) & (F.col("_take") <= F.col("_upto")))
        .select(*keys, "_bucket", (F.col("_take") - F.col("_upto") + F.col("_rows")).alias("_rank"))
    )
    inside = W.partitionBy(*keys, "_bucket").orderBy(order)
    return (
        lookup_small(slim, cut_bucket, [*keys, "_bucket"], "inner")
        .withColumn("_row", F.row_number().over(inside))
        .filter(F.col("_row") == F.col("_rank"))
        .select(*keys, F.col(order).alias("cut"))
    )

"""Joins that keep rows whose key is null, and left lookups that salt the keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 32


def match(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null; the keys come from ``left``."""
    renamed = right.withColumnsRenamed({c: f"_right_{c}" for c in on})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_right_{c}")) for c in on])
    return left.join(renamed, same, how).drop(*[f"_right_{c}" for c in on])


def lookup_small(left: DataFrame, dim: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join ``left`` to a table with one row per class or per file, which every executor gets whole.

    The rows of ``left`` stay where they are, whatever their keys; null is a key like any other.
    """
    return match(left, F.broadcast(dim), on, how)


def lookup(left: DataFrame, dim: DataFrame, on: Sequence[str], how: str = "left", salts: int = SALTS) -> DataFrame:
    """Join ``left`` to a table with one row per key (null is a key like any other).

    The rows of every key are spread over ``salts`` tasks, so a key that holds much of ``left`` does
    not end in one of them. No job runs here; whether the table is broadcast is left to Spark.
    """
    on = list(on)
    salted_left = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    salted_dim = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return match(salted_left, salted_dim, [*on, "_salt"], how).drop("_salt")

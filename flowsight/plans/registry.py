"""Named queries over the given tables, each with the SQL that gives the same rows, if there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsight.functions.scalars import round_even
from flowsight.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its own name."""

    def register(make):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain(make(prepare(spark), sf_dir))

        QUERIES[make.__name__] = run
        if sql:
            SQL[make.__name__] = sql
        return make

    return register


def plain(df: DataFrame) -> DataFrame:
    """Timestamps without zone and lists as text, so any engine compares them alike."""
    changes = {}
    for field in df.schema:
        if isinstance(field.dataType, T.TimestampType):
            changes[field.name] = F.col(field.name).cast("timestamp_ntz")
        elif field.dataType == T.ArrayType(T.StringType()) or field.dataType == T.ArrayType(
            T.StringType(), False
        ):
            changes[field.name] = F.array_join(field.name, ",")
    return df.withColumns(changes) if changes else df


def rounded(df: DataFrame, digits: int = 6, columns: list[str] | None = None) -> DataFrame:
    """Doubles rounded half to even, as their last bits depend on the order of addition.

    Mean gaps are microseconds over a small count, which often ends in an exact half at six digits;
    they keep more.
    """
    names = columns or [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: round_even(F.col(c), 10 if c == "iat_mean" else digits) for c in names})

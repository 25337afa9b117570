"""Sinks that survive a restart: a batch counts once, and only when it is complete.

Each attempt at a micro-batch writes a folder of its own, and then one line of the manifest that names
it. Of a batch's lines the newest counts, so a retried batch replaces its old attempt; an attempt that
died half way is named nowhere and never read. Nothing is ever overwritten, so who reads meanwhile
sees the state there was when they listed the manifest.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

PLACE = "batch long, attempt string"


def write_attempt(rows: DataFrame, path: str, batch: int) -> str:
    """Writes the rows of a batch; they are not read before :func:`commit`."""
    attempt = f"a-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/rows/batch={batch}/attempt={attempt}")
    return attempt


def commit(spark: SparkSession, path: str, batch: int, attempt: str) -> None:
    """From now on the batch is what this attempt wrote."""
    line = spark.createDataFrame([(batch, attempt, time.time_ns())], f"{PLACE}, at long").coalesce(1)
    line.write.json(f"{path}/manifest/{attempt}")


def put_batch(rows: DataFrame, path: str, batch: int) -> None:
    commit(rows.sparkSession, path, batch, write_attempt(rows, path, batch))


def write_committed(stream: DataFrame, path: str, prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataStreamWriter:
    """A writer, still to be started, that puts each micro-batch (after ``prepare``) below ``path``."""
    return stream.writeStream.foreachBatch(lambda rows, batch: put_batch(prepare(rows), path, batch))


def read_committed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of complete batches, each batch once.

    The manifest's few lines meet the rows by folder, so the folders of other attempts are not read.
    """
    placed = T.StructType([*schema.fields, T.StructField("batch", T.LongType()), T.StructField("attempt", T.StringType())])
    rows = spark.read.schema(placed).option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    lines = spark.read.schema(f"{PLACE}, at long").option("recursiveFileLookup", True).json(f"{path}/manifest")
    named = lines.groupBy("batch").agg(F.max_by("attempt", F.struct("at", "attempt")).alias("attempt"))
    return rows.join(named, ["batch", "attempt"], "left_semi").drop("batch", "attempt")


def write_version(rows: DataFrame, path: str) -> None:
    """Replaces a whole table: readers see the old version until the new one is complete."""
    put_batch(rows, path, 0)

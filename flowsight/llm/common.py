"""Helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Callable, Iterator
from contextlib import suppress
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsight.session import materialize

#: Rows of one Arrow batch. Texts may be long, so the number is far below Spark's default.
BATCH_ROWS = 500
#: Characters that a task works on at a time, whatever the batch holds.
CHUNK_CHARS = 2_000_000


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def worker_cache(name: str, make: Callable[[], object]) -> object:
    """An object that lives as long as the Python worker, across its tasks.

    Task functions arrive pickled with their module, so a module's own globals last for one task.
    """
    holder = sys.modules.setdefault("_flowsight_worker", types.ModuleType("_flowsight_worker"))
    if not hasattr(holder, name):
        setattr(holder, name, make())
    return getattr(holder, name)


def give_back() -> None:
    """Returns memory that this process has freed to the system.

    Workers go on with tasks of other operators, or wait beside them; what their allocators keep
    would add up over a long session.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # no such call beyond glibc
        ctypes.CDLL(None).malloc_trim(0)


def frugal(run: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """A task function that gives its memory back when it ends."""

    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch], *args, **named) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches, *args, **named)
        finally:
            give_back()

    return task


def chunks(lengths: np.ndarray | list[int], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring rows whose lengths add up to about ``limit``; one row at least."""
    start = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def text_chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch with their texts; a null text counts as empty."""
    texts = [t or "" for t in batch.column(column).to_pylist()]
    for a, b in chunks([len(t) for t in texts], limit):
        yield batch.slice(a, b - a), texts[a:b]


def words_of(text: str) -> list[bytes]:
    """Maximal runs of characters other than space and U+0009 to U+000D, as UTF-8."""
    return text.encode().split()


def ragged(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Indices of the slices [start, start + length), one slice after the other."""
    lengths = np.asarray(lengths, dtype=np.int64)
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, dtype=np.int64)
    return np.repeat(np.asarray(starts, dtype=np.int64) - (ends - lengths), lengths) + np.arange(ends[-1])


def list_array(flat: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_part(key: str, parts: int):
    """The remainder of crc32(key as text) that decides which rows are held out."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(parts))


def numbered(rows: DataFrame) -> tuple[DataFrame, bool]:
    """Adds ``_row``, a number that tells rows apart and stays the same whenever the rows are read.

    That is the key itself, unless a key is repeated or null: then the rows are written once with
    numbers of their own (and the second value is true).
    """
    repeated = rows.groupBy("_key").count().filter((F.col("count") > 1) | F.col("_key").isNull())
    if repeated.limit(1).count():
        return materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "numbered"), True
    return rows.withColumn("_row", F.col("_key").cast("long")), False

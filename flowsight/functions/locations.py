"""Where a row was read: file name and place in the file."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_name() -> Column:
    """The name of the file a row was read from; Spark gives it with escapes, as part of an address."""
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))


def row_position() -> Column:
    """A number that increases along a text file's rows and is unique within the file.

    It is the byte offset of the row's block plus the row's number in its task. A block holds
    fewer rows than bytes, and one that is followed by another block of the file fills its task.
    """
    in_task = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return F.col("_metadata.file_block_start") + in_task

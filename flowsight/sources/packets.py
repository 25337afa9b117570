"""Packet-summary CSV files, whose columns differ from file to file."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import groupby
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsight.functions.locations import file_name, row_position
from flowsight.operators.convert import UnresolvedColumns, convert_packet_summaries
from flowsight.operators.split import union_datasets

FILES = "*.pcap.csv"


def with_source_file(df: DataFrame) -> DataFrame:
    """Adds the name of the file each row was read from."""
    return df.withColumn("source_file", file_name())


#: Bytes that are read of a file at a time until its first line ends.
HEADER_BYTES = 16_384


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith(("/", "file:")):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(quote(path, safe=":/"))


def first_line(path: str) -> str | None:
    """The first line of a file without its end; None for an empty file."""
    store, name = _open(path)
    with store.open_input_stream(name) as file:
        line = b""
        while b"\n" not in line and (more := file.read(HEADER_BYTES)):
            line += more
    return line.splitlines()[0].decode("utf-8-sig") if line.strip() else None


def _first_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.append_column("header", pa.array([first_line(p) for p in batch.column("file_path").to_pylist()], pa.string()))


def file_headers(spark: SparkSession, path: str, pattern: str = FILES) -> DataFrame:
    """First line of each file: (file_path, file_name, header). Empty files have none.

    The list of files is a table, spread over tasks that open each file and read as far as its first
    line goes. Their store must be one that pyarrow can open (local, HDFS, S3, GCS).
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)  # contents are not read
    files = files.select(F.col("path").alias("file_path"), file_name().alias("file_name"))
    schema = "file_path string, file_name string, header string"
    return files.mapInArrow(_first_lines, schema).filter(F.col("header").isNotNull())


def schema_profile(headers: DataFrame, shown: int = 10) -> DataFrame:
    """Per file: its columns, their number, whether it is labelled, number of features."""
    columns = F.transform(F.split("header", ","), F.trim)
    return headers.withColumn("columns", columns).select(
        "file_name",
        "columns",
        F.size("columns").alias("column_count"),
        F.array_contains("columns", "label").alias("has_label"),
        F.size(F.filter("columns", lambda c: c != "label")).alias("feature_count"),
        F.slice("columns", 1, shown).alias("first_columns"),
    )


def profile_summary(profile: DataFrame) -> DataFrame:
    """One row: files, and files of each kind."""
    return profile.agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if("has_label").alias("labelled"),
        F.min("column_count").alias("min_columns"),
        F.max("column_count").alias("max_columns"),
    )


def read_packet_summaries(
    spark: SparkSession, path: str, pattern: str = FILES, headers: DataFrame | None = None
) -> list[DataFrame]:
    """One DataFrame of text cells per distinct header, with ``source_file`` and ``row_position``.

    Spark reads all files of one scan under one header, so files are grouped by theirs first.
    ``headers`` (from :func:`file_headers`) saves that pass when it has been made before. The names of
    the files come to the driver, which lists them for any scan.
    """
    headers = headers if headers is not None else file_headers(spark, path, pattern)
    listed = headers.select("header", "file_path").orderBy("header", "file_path").toLocalIterator()
    return [
        spark.read.option("header", True)
        .csv([file["file_path"] for file in files])
        .withColumn("row_position", row_position())
        .withColumn("source_file", file_name())
        for _, files in groupby(listed, key=lambda file: file["header"])
    ]


def convert_files(
    frames: Sequence[DataFrame], allow_proxy: bool = True
) -> tuple[DataFrame | None, DataFrame | None]:
    """(converted rows of all readable files, names of the files that had to be rejected).

    Rejected are whole groups of files of one header, so their names come from the file list of the
    scan, not from their rows.
    """
    good, bad = [], []
    for frame in frames:
        try:
            good.append(
                convert_packet_summaries(
                    frame, allow_proxy=allow_proxy, keep=("source_file", "row_position")
                )
            )
        except UnresolvedColumns:
            names = [(unquote(f).rsplit("/", 1)[-1],) for f in frame.inputFiles()]
            bad.append(frame.sparkSession.createDataFrame(names, "source_file string"))
    return (
        union_datasets(*good) if good else None,
        union_datasets(*bad) if bad else None,
    )

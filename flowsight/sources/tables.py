"""Feature tables, alert logs, converted datasets and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from flowsight.operators.alerts import export_rows
from flowsight.schema import ALERT_SCHEMA, FEATURE_SCHEMA, FEATURES
from flowsight.sources.flows import json_objects


def read_features(
    spark: SparkSession, path: str, format: str = "parquet", schema: T.StructType | None = None
) -> DataFrame:
    """A feature table. CSV cells are read as text, to be cleaned by ``clean_features``."""
    if format == "csv":
        return spark.read.option("header", True).csv(path)
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def read_features_stream(
    spark: SparkSession, path: str, schema: T.StructType = FEATURE_SCHEMA, files_per_trigger: int = 1000
) -> DataFrame:
    """Rows of new files of a feature table; the query's checkpoint is the offset."""
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    )


def write_features(df: DataFrame, path: str, format: str = "parquet", columns: list[str] | None = None):
    """Append feature rows. A stream gives back its writer, still to be started with ``start(path)``."""
    rows = df.select(*columns) if columns else df
    if rows.isStreaming:
        return rows.writeStream.format(format).outputMode("append")
    rows.write.mode("append").option("header", True).format(format).save(path)


def write_feature_csv(df: DataFrame, path: str) -> None:
    """The 13 features only, with a header."""
    write_features(df, path, "csv", FEATURES)


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """Alert events; blank and broken lines are left out."""
    return json_objects(spark.read.text(path), ALERT_SCHEMA)


def read_alerts_stream(spark: SparkSession, path: str) -> DataFrame:
    return json_objects(spark.readStream.text(path), ALERT_SCHEMA)


def write_alerts(alerts: DataFrame, path: str) -> DataStreamWriter | None:
    """One JSON object per alert; empty optional fields are left out."""
    if alerts.isStreaming:
        return alerts.writeStream.format("json").outputMode("append")
    alerts.write.mode("append").json(path)


def export_alerts_csv(alerts: DataFrame, path: str) -> None:
    export_rows(alerts).write.mode("overwrite").option("header", True).csv(path)


def write_converted(converted: DataFrame, path: str) -> None:
    """Converted rows, one folder per input file."""
    converted.write.mode("overwrite").partitionBy("source_file").parquet(path)


def write_split(parts: DataFrame, path: str, train: DataFrame) -> None:
    """The assembled training set, and the held-out rows with one folder per dataset."""
    train.write.mode("overwrite").parquet(f"{path}/train")
    held = parts.filter(F.col("part") == "test").drop("part")
    held.write.mode("overwrite").partitionBy("source_file").parquet(f"{path}/holdout")

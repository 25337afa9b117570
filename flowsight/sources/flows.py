"""Flow events as JSON lines, batch and streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsight.functions.scalars import first_of, parse_timestamp
from flowsight.functions.locations import row_position
from flowsight.schema import FLOW_EVENT_SCHEMA, KEY, SIMPLE_EVENT_SCHEMA


#: The sensor of events that name none.
DEFAULT_SENSOR = "default"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FLOW_EVENT_SCHEMA).option("mode", "PERMISSIVE").json(path)


def read_events_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """New files below ``path``, each read once; the query's checkpoint keeps the place."""
    return (
        spark.readStream.schema(FLOW_EVENT_SCHEMA)
        .option("mode", "PERMISSIVE")
        .option("maxFilesPerTrigger", files_per_trigger)
        .json(path)
    )


def parse_flows(
    events: DataFrame, on_bad_ts: str = "drop", key: str = KEY, arrival: Column | None = None
) -> DataFrame:
    """Flat flow rows of the flow events; lines that are no such event are left out.

    Events that name no sensor belong to one implicit stream, the sensor ``DEFAULT_SENSOR``. A
    missing or unreadable time drops the row, or with ``on_bad_ts="now"`` becomes the current
    time (and missing addresses ``0.0.0.0``). ``arrival`` numbers the rows in reading order; a
    stream has no such number, nor does the default give one there.
    """
    lenient = on_bad_ts == "now"
    ts = parse_timestamp(F.col("timestamp"))
    address = lambda c: F.coalesce(F.col(c), F.lit("0.0.0.0")) if lenient else F.col(c)
    count = lambda c: F.coalesce(F.col(f"flow.{c}"), F.lit(0).cast("long")).alias(c)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = events.filter(F.col("event_type") == "flow")
    sensor = [F.col(key)] if key in events.columns else []
    if sensor and isinstance(events.schema[key].dataType, T.StringType):
        sensor = [F.coalesce(F.col(key), F.lit(DEFAULT_SENSOR)).alias(key)]
    if arrival is None and not events.isStreaming:
        arrival = F.monotonically_increasing_id()
    rows = rows.select(
        *sensor,
        *([arrival.alias("arrival_seq")] if arrival is not None else []),
        (F.coalesce(ts, F.current_timestamp()) if lenient else ts).alias("ts"),
        address("src_ip").alias("src"),
        address("dest_ip").alias("dst"),
        count("bytes_toserver"),
        count("bytes_toclient"),
        count("pkts_toserver"),
        count("pkts_toclient"),
        text("flow.state").alias("state"),
        F.upper(text("proto")).alias("proto"),
        F.lower(text("app_proto")).alias("app_proto"),
    )
    if lenient:
        rows = rows.withColumns(
            {
                "bytes_total": F.col("bytes_toserver") + F.col("bytes_toclient"),
                "pkts_total": F.col("pkts_toserver") + F.col("pkts_toclient"),
                "is_syn": F.upper("state").contains("SYN").cast("int"),
            }
        )
    return rows if lenient else rows.filter(F.col("ts").isNotNull())


#: Bits of a row's number that are its place in its file.
PLACE_BITS = 40


def in_reading_order(rows: DataFrame, path: str) -> DataFrame:
    """Adds ``arrival_seq`` to rows just read from files: by time of the file, its path, place in it.

    The number does not depend on how files are packed into tasks, so the same lines in one file or
    in several, written one after the other, come in the same order. The files' ranks come from their
    list alone; the driver holds that list for any scan.
    """
    files = rows.sparkSession.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    meta = F.col("_metadata")
    files = files.select(meta["file_path"].alias("_file"), meta["file_modification_time"].alias("_changed"))
    ranked = files.select("_file", (F.row_number().over(W.orderBy("_changed", "_file")) - 1).cast("long").alias("_rank"))
    placed = rows.withColumns({"_file": meta["file_path"], "_place": row_position()})
    number = F.shiftleft(F.col("_rank"), PLACE_BITS) + F.col("_place")
    return placed.join(ranked, "_file").withColumn("arrival_seq", number).drop("_file", "_place", "_rank")


def read_flows(spark: SparkSession, path: str, on_bad_ts: str = "drop") -> DataFrame:
    """Flow rows of the event files below ``path``, numbered in reading order."""
    events = in_reading_order(read_events(spark, path), path)
    return parse_flows(events, on_bad_ts, arrival=F.col("arrival_seq"))


def rejected_lines(lines: DataFrame) -> DataFrame:
    """The lines that :func:`parse_flows` leaves out, each with its reason; ``lines`` has ``value``.

    Works on batches and streams of text, so what a feature stream does not count can be kept beside
    it. Blank lines are no events and are not listed.
    """
    marked = T.StructType([*FLOW_EVENT_SCHEMA.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = lines.withColumn("_event", F.from_json("value", marked, {"columnNameOfCorruptRecord": "_corrupt_record"}))
    event = F.col("_event")
    kind = event["event_type"]
    reason = (
        F.when(event.isNull() | (kind.isNull() & event["_corrupt_record"].isNotNull()), "broken line")
        .when(kind.isNull(), "no event type")
        .when(kind != "flow", "not a flow")
        .when(event["timestamp"].isNull(), "no timestamp")
        .when(parse_timestamp(event["timestamp"]).isNull(), "unreadable timestamp")
    )
    found = parsed.withColumn("reason", reason).drop("_event")
    return found.filter(F.col("reason").isNotNull() & (F.trim("value") != ""))


def read_flows_stream(spark: SparkSession, path: str, on_bad_ts: str = "drop") -> DataFrame:
    return parse_flows(read_events_stream(spark, path), on_bad_ts)


def as_events(flows: DataFrame, key: str = KEY) -> DataFrame:
    """Flow rows as nested events, the shape that is read back by :func:`parse_flows`."""
    return flows.select(
        F.col(key).cast("string").alias(key),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxx").alias("timestamp"),
        F.lit("flow").alias("event_type"),
        F.col("src").alias("src_ip"),
        F.col("dst").alias("dest_ip"),
        "proto",
        "app_proto",
        F.struct("bytes_toserver", "bytes_toclient", "pkts_toserver", "pkts_toclient", "state").alias("flow"),
    )


def json_objects(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """Parsed rows of the text lines that hold a JSON object; blank and broken lines are left out."""
    marked = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    options = {"columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = lines.select(F.from_json("value", marked, options).alias("o"))
    whole = parsed.filter(F.col("o").isNotNull() & F.col("o._corrupt_record").isNull())
    return whole.select(*[F.col(f"o.{c}").alias(c) for c in schema.fieldNames()])


def read_simple_events(spark: SparkSession, path: str) -> DataFrame:
    """Flat events for :func:`event_to_features`."""
    return json_objects(spark.read.text(path), SIMPLE_EVENT_SCHEMA)


def event_to_features(events: DataFrame) -> DataFrame:
    """One feature row per single event, with fixed values for what one event cannot tell."""
    packets = first_of(F.col("pktcnt"), F.col("packet_count"), F.lit(1).cast("long"))
    size = first_of(F.col("bytecnt"), F.col("bytes"), F.lit(200).cast("long"))
    rows = events.withColumns({"_packets": packets, "_bytes": size})
    one = F.lit(1).cast("long")
    per_packet = F.floor(F.try_divide(F.col("_bytes"), F.greatest(one, F.col("_packets")))).cast("long")
    zero = F.lit(0.0)
    return rows.select(
        one.alias("flows"),
        F.col("_bytes").alias("bytes_total"),
        F.col("_packets").alias("pkts_total"),
        F.when(F.col("tcp.flags") == "S", 1.0).otherwise(0.1).alias("syn_ratio"),
        F.greatest(one, per_packet).alias("mean_bytes_flow"),
        zero.alias("ack_ratio"),
        zero.alias("fin_ratio"),
        zero.alias("rst_ratio"),
        zero.alias("http_ratio"),
        F.when(F.col("tcp").isNotNull(), 1.0).otherwise(0.0).alias("tcp_ratio"),
        F.lit(1).alias("protocol_diversity"),
        zero.alias("std_bytes"),
        zero.alias("iat_mean"),
    )

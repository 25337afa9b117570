"""Queries that run a stream over the given tables to its end and read what it wrote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsight.operators.alerts import as_alerts
from flowsight.operators.features import CONTEXT as CONTEXT_COLUMNS
from flowsight.plans import adapters
from flowsight.plans.adapters import WINDOW, WINDOW_SEC
from flowsight.plans.policy_queries import DECISION_COLUMNS, POLICY, decided_sql
from flowsight.plans.reference_sql import CONTEXT, COUNTED, ROUNDED, WINDOWED
from flowsight.plans.registry import SQL, query, rounded
from flowsight.session import scratch_dir
from flowsight.sources.flows import as_events, parse_flows, read_events_stream, read_flows_stream
from flowsight.streaming import arrival as sa
from flowsight.streaming import decisions as sd
from flowsight.streaming import features as sf

#: The given tables are read as one file in order of time, so no flow comes late.
LATENESS = "0 seconds"


def run_to_end(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Everything a stream gives for the input there is now, as a table."""
    path = scratch_dir(stream.sparkSession, name)
    writer = stream.writeStream.option("checkpointLocation", f"{path}/checkpoint")
    writer = writer.trigger(availableNow=True)
    if mode == "append":
        job = writer.format("parquet").outputMode("append").start(f"{path}/rows")
    else:
        # Each batch gives the current state of the groups it changed; the last one counts.
        def keep(batch: DataFrame, batch_id: int) -> None:
            batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/rows/n={batch_id}")

        job = writer.outputMode(mode).foreachBatch(keep).start()
    job.awaitTermination()
    schema = stream.schema if mode == "append" else T.StructType(stream.schema.fields + [T.StructField("batch", T.IntegerType())])
    return stream.sparkSession.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{path}/rows")


def flow_stream(spark, sf_dir) -> DataFrame:
    schema = adapters.table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return adapters.flows_from_events(events)


def feature_table(spark, sf_dir) -> DataFrame:
    return run_to_end(sf.stream_window_features(flow_stream(spark, sf_dir), WINDOW, lateness=LATENESS), "features")


def in_files(rows: DataFrame, name: str, number: Column, files: int) -> str:
    """The rows in so many files, written one after the other; ``number`` says in which."""
    path = scratch_dir(rows.sparkSession, name)
    for i in range(files):
        rows.filter(number == i).coalesce(1).write.mode("append").parquet(path)
    return path


#: Flows of one file, at most about; a file's are one micro-batch.
ARRIVED_FLOWS = 4_000_000


def chunks_by_arrival(flows: DataFrame, name: str, rows: int, least: int = 4) -> list[DataFrame]:
    """The flows cut along ``arrival_seq`` in chunks of about ``rows``, ``least`` of them at least.

    They are stored with a folder per chunk, so all of them together read the flows once.
    """
    spark = flows.sparkSession
    chunks = max(least, -(-flows.count() // rows))
    path = scratch_dir(spark, name)
    cut = flows.repartitionByRange(chunks, "arrival_seq").withColumn("_chunk", F.spark_partition_id())
    cut.write.partitionBy("_chunk").parquet(path)
    stored = spark.read.schema(cut.schema).parquet(path)
    return [stored.filter(F.col("_chunk") == i).drop("_chunk") for i in range(chunks)]


#: How far the rows of the shuffled files lie apart in time: a quarter of the given month.
APART_DAYS = 8


def decision_stream(spark, sf_dir) -> DataFrame:
    """Decisions on the stored output of the feature stream, as a second stream.

    The windows lie in four files by time, and a tenth of the second quarter comes with the third.
    """
    features = feature_table(spark, sf_dir)
    ends = features.agg(F.min("window_start").alias("first"), F.max("window_start").alias("last")).first()
    span = (ends["last"] - ends["first"]).total_seconds() if ends["first"] else 0
    since = (F.unix_micros("window_start") - F.unix_micros(F.lit(ends["first"]))) / F.lit(1e6)
    quarter = F.least(F.floor(since * 4 / F.lit(max(span, 1.0))), F.lit(3))
    delayed = (quarter == 1) & (F.pmod(F.unix_seconds("window_start") / 21600 + F.col("sensor_id"), F.lit(10)) == 0)
    path = in_files(features, "windows", quarter + delayed.cast("int"), 4)
    stored = spark.readStream.schema(features.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return sd.decide_stream(stored.withColumn("score", adapters.fixed_score()), POLICY, lateness=f"{APART_DAYS} days")


CLOSED = "window_end <= (SELECT max(ts) FROM events)"
#: Closed windows that no earlier one can still come before; the others wait in the state.
SETTLED = f"""{CLOSED} AND window_start < (SELECT max(window_start) FROM decided WHERE {CLOSED}) - INTERVAL '{APART_DAYS} days'"""


@query(f"""
WITH {WINDOWED}
SELECT sensor_id, window_start, window_start + INTERVAL '6 hours' AS window_end, {COUNTED}, {ROUNDED}, {CONTEXT}
FROM features WHERE window_start + INTERVAL '6 hours' <= (SELECT max(ts) FROM events)""")
def stream_window_features(spark, sf_dir):
    return rounded(feature_table(spark, sf_dir))


@query(f"""
WITH {WINDOWED}
SELECT sensor_id, window_start, {COUNTED}, {ROUNDED}
FROM features WHERE window_start + INTERVAL '6 hours' <= (SELECT max(ts) FROM events)""")
def stream_json_features(spark, sf_dir):
    """The whole live path: JSON event lines, parsed flows, feature rows."""
    path = scratch_dir(spark, "events")
    as_events(adapters.flows(spark, sf_dir)).write.json(path)
    rows = run_to_end(sf.stream_window_features(read_flows_stream(spark, path), WINDOW, lateness=LATENESS), "features")
    rows = rows.withColumn("sensor_id", F.col("sensor_id").cast("long"))
    return rounded(rows.drop("window_end", "top_src_ip", "http_flows", "dns_flows", "tls_flows", "app_protos"))


@query(SQL["arrival_window_features"])
def stream_arrival_features(spark, sf_dir):
    """Flows in files by arrival, a tenth of them late: each joins the window open when it comes."""
    flows = adapters.late_flows(spark, sf_dir)
    path = scratch_dir(spark, "arrivals")
    for chunk in chunks_by_arrival(flows, "arrived", ARRIVED_FLOWS):
        chunk.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(flows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    rows = run_to_end(sa.stream_arrival_features(stream, WINDOW_SEC), "arrival_features")
    return rounded(rows.drop("window_start", "window_end", *CONTEXT_COLUMNS))


@query(SQL["trailing_features"])
def stream_trailing_features(spark, sf_dir):
    return run_to_end(sf.stream_trailing_features(flow_stream(spark, sf_dir), WINDOW_SEC, lateness=LATENESS), "trailing")


#: Event lines of one file, at most about; one task writes a file.
FILE_LINES = 250_000


@query(f"SELECT * EXCLUDE (arrival_seq) FROM ({SQL['trailing_features']})")
def stream_json_trailing(spark, sf_dir):
    """JSON event lines in three batches of files by time, answered flow by flow as they come."""
    flows = adapters.flows(spark, sf_dir)
    ends = flows.agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("flows")).first()
    files = max(1, -(-ends["flows"] // (3 * FILE_LINES)))
    path = scratch_dir(spark, "events")
    third = F.width_bucket(F.unix_micros("ts"), F.unix_micros(F.lit(ends["first"])), F.unix_micros(F.lit(ends["last"])) + 1, F.lit(3))
    for i in (1, 2, 3):
        part = as_events(flows.filter(third == i))
        (part.repartition(files) if files > 1 else part.coalesce(1)).write.mode("append").json(path)
    stream = parse_flows(read_events_stream(spark, path, files_per_trigger=files))
    rows = run_to_end(sf.stream_trailing_features(stream, WINDOW_SEC, lateness=LATENESS), "trailing")
    return rows.withColumn("sensor_id", F.col("sensor_id").cast("long")).drop("arrival_seq")


@query(f"WITH {decided_sql(POLICY)} SELECT {', '.join(DECISION_COLUMNS)} FROM decided WHERE {SETTLED}")
def stream_decisions(spark, sf_dir):
    return run_to_end(decision_stream(spark, sf_dir), "decisions").select(*DECISION_COLUMNS)


@query(f"""
WITH {decided_sql(POLICY)}
SELECT time_bucket(INTERVAL '1 day', window_end, TIMESTAMP '1970-01-01') AS window_start, pred_class,
       count(*) AS total, count(*) FILTER (state = 'ATTACK') AS attacks,
       count(*) FILTER (action LIKE 'BLOCK%') AS blocks
FROM decided WHERE {SETTLED} GROUP BY 1, 2""")
def stream_alert_counts(spark, sf_dir):
    alerts = stored_alerts(spark, sf_dir)
    rows = run_to_end(sd.alert_counts_stream(alerts, "1 day", lateness=LATENESS), "counts", "update")
    return latest(rows, ["window_start", "pred_class"])


@query(f"""
WITH {decided_sql(POLICY)}
SELECT src_ip, min(ts) AS first_block, max(ts) AS last_block, count(*) AS blocks,
       CASE max(CASE action WHEN 'BLOCK-KILL' THEN 3 WHEN 'BLOCK-HARD' THEN 2 ELSE 1 END)
            WHEN 3 THEN 'KILL' WHEN 2 THEN 'HARD' ELSE 'SOFT' END AS severity
FROM decided WHERE action LIKE 'BLOCK%' AND src_ip IS NOT NULL AND {SETTLED} GROUP BY 1""")
def stream_block_list(spark, sf_dir):
    rows = run_to_end(sd.block_list_stream(stored_alerts(spark, sf_dir)), "blocks", "update")
    return latest(rows, ["src_ip"])


def stored_alerts(spark, sf_dir) -> DataFrame:
    alerts = run_to_end(as_alerts(decision_stream(spark, sf_dir)), "alerts")
    path = alerts.inputFiles()[0].rsplit("/", 1)[0]
    return spark.readStream.schema(alerts.schema).parquet(path)


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The last version of each group of an update-mode result."""
    values = [c for c in rows.columns if c not in [*keys, "batch"]]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_row"))
    return newest.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in values])

"""Queries that write with a sink and read back with a source, and that read events as they come."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from flowsight.operators import clean, convert, features as ft, model as md, policy as po, split
from flowsight.operators.alerts import as_alerts
from flowsight.plans import adapters, streaming_queries as sq
from flowsight.plans.adapters import WINDOW, WINDOW_SEC
from flowsight.plans.model_queries import explained, trained, windows
from flowsight.plans.policy_queries import POLICY, decided_sql
from flowsight.plans.reference_sql import COUNTED, FLOWS, ROUNDED, WINDOWED
from flowsight.plans.registry import SQL, query, rounded
from flowsight.plans.training_queries import COLUMNS, CONVERTED, SPLIT, positioned
from flowsight.functions.decision import reason_text, top_contributions
from flowsight.functions.labels import binary_label
from flowsight.schema import FEATURES
from flowsight.session import materialize, scratch_dir
from flowsight.sources import flows as fl, tables
from flowsight.streaming import decisions as sd, features as sf, sinks

# --- events as they come ---


#: Lines of one file, at most about: one task sorts them.
FILE_FLOWS = 500_000


@query(SQL["arrival_window_features"])
def file_order_features(spark, sf_dir):
    """Flows in order of reading JSON files; nothing in the lines says which came first."""
    flows = adapters.late_flows(spark, sf_dir)
    path = scratch_dir(spark, "events")
    for chunk in sq.chunks_by_arrival(flows, "arrived", FILE_FLOWS):
        fl.as_events(chunk.coalesce(1).sortWithinPartitions("arrival_seq")).write.mode("append").json(path)
    read = fl.read_flows(spark, path).withColumn("sensor_id", F.col("sensor_id").cast("long"))
    indexed = ft.assign_arrival_windows(read, None, WINDOW_SEC)
    rows = ft.window_features_by(indexed, WINDOW_SEC, drop_open=True)
    return rounded(rows.drop("window_start", "window_end", *ft.CONTEXT))


#: What is wrong with an event's line, by the last digit of its number.
FAULTS = ["broken line", "not a flow", "no timestamp", "unreadable timestamp", "no event type"]


def damaged_lines(spark, sf_dir):
    """Event lines, half of them with a fault, and some blank ones."""
    digit = F.col("_digit")
    rows = adapters.flows(spark, sf_dir).withColumn("_digit", F.col("arrival_seq") % 10)
    event = fl.as_events(rows.withColumn("sensor_id", F.concat_ws("|", "sensor_id", "_digit")))
    event = event.withColumn("_digit", F.split_part("sensor_id", F.lit("|"), F.lit(2)).cast("int"))
    event = event.withColumns(
        {
            "sensor_id": F.split_part("sensor_id", F.lit("|"), F.lit(1)),
            "event_type": F.when(digit == 1, "alert").when(digit != 4, "flow"),
            "timestamp": F.when(digit == 3, "soon").when(digit != 2, F.col("timestamp")),
        }
    )
    line = F.to_json(F.struct(*[c for c in event.columns if c != "_digit"]))
    line = F.when(digit == 0, F.left(line, F.lit(40))).when(digit == 5, F.concat(line, F.lit("\n"))).otherwise(line)
    return event.select(line.alias("value"))


@query(f"""
WITH {FLOWS}, faulty AS (SELECT list_extract({FAULTS}, CAST(1 + arrival_seq % 10 AS INTEGER)) AS reason FROM flows)
SELECT coalesce(reason, 'read') AS reason, count(*) AS lines FROM faulty GROUP BY 1""")
def rejected_events(spark, sf_dir):
    """Lines of a text stream that are no flows, by reason, and the flows that are read from the rest."""
    path = scratch_dir(spark, "lines")
    damaged_lines(spark, sf_dir).write.text(path)
    left_out = sq.run_to_end(fl.rejected_lines(spark.readStream.text(path)), "rejected")
    read = fl.parse_flows(fl.read_events(spark, path)).agg(F.lit("read").alias("reason"), F.count("*").alias("lines"))
    return left_out.groupBy("reason").agg(F.count("*").alias("lines")).unionByName(read)


# --- sinks ---


@query(f"""
WITH {WINDOWED}
SELECT sensor_id, window_start, {COUNTED}, {ROUNDED}
FROM features WHERE window_start + INTERVAL '6 hours' <= (SELECT max(ts) FROM events)""")
def stream_committed_features(spark, sf_dir):
    """Closed windows in a sink of which one batch is tried twice and another dies half way."""
    stream = sf.stream_window_features(sq.flow_stream(spark, sf_dir), WINDOW, lateness=sq.LATENESS)
    path = scratch_dir(spark, "committed")
    job = sinks.write_committed(stream, path).option("checkpointLocation", f"{path}/checkpoint")
    job.trigger(availableNow=True).start().awaitTermination()
    kept = sinks.read_committed(spark, path, stream.schema)
    for batch in (0, 1):  # tried again, with the rows it had
        placed = spark.read.parquet(f"{path}/rows").filter(F.col("batch") == batch)
        sinks.put_batch(materialize(placed.select(*stream.columns), "again"), path, batch)
    sinks.write_attempt(materialize(kept, "half"), path, 1_001)
    return rounded(sinks.read_committed(spark, path, stream.schema).select("sensor_id", "window_start", *FEATURES))


@query(f"""
WITH {decided_sql(POLICY)}
SELECT CAST(sensor_id AS VARCHAR) AS sensor_id, ts, index, score, state, hits_in_window, action, pred_class, src_ip FROM decided""")
def alert_log(spark, sf_dir):
    """Alerts as JSON lines, with a broken and a blank line among them, read back."""
    path = scratch_dir(spark, "alerts")
    tables.write_alerts(as_alerts(po.decide(adapters.scored_windows(spark, sf_dir), POLICY)), path)
    spark.createDataFrame([('{"ts": 1, "sco',), ("",)], "value string").write.mode("append").text(path)
    log = tables.read_alerts(spark, path)
    return log.select("sensor_id", "ts", "index", "score", "state", "hits_in_window", "action", "pred_class", "src_ip")


@query(f"WITH {WINDOWED} SELECT {COUNTED}, {ROUNDED} FROM features")
def feature_csv(spark, sf_dir):
    """Feature rows as CSV with a header, read as text and cleaned."""
    path = scratch_dir(spark, "features")
    tables.write_feature_csv(ft.window_features(adapters.flows(spark, sf_dir), WINDOW), path)
    read = clean.normalize_columns(tables.read_features(spark, path, "csv"))
    rows = rounded(clean.clean_features(read))
    counts = {"flows": "long", "bytes_total": "long", "pkts_total": "long", "protocol_diversity": "int"}
    return rows.withColumns({c: F.col(c).cast(t) for c, t in counts.items()}).select(*FEATURES)


@query(f"""
WITH {CONVERTED} SELECT source_file, label, count(*) AS rows, CAST(sum(flows) AS BIGINT) AS flows FROM converted GROUP BY 1, 2""")
def converted_folders(spark, sf_dir):
    """Converted rows in one folder per dataset, read back as one table."""
    path = scratch_dir(spark, "converted")
    tables.write_converted(convert.convert_packet_summaries(adapters.packet_summaries(spark, sf_dir)), path)
    rows = tables.read_features(spark, path)
    return rows.groupBy("source_file", "label").agg(F.count("*").alias("rows"), F.sum("flows").alias("flows"))


@query(f"""
WITH {SPLIT}, train AS (SELECT DISTINCT {COLUMNS}, label FROM parted WHERE part = 'train')
SELECT 'train' AS part, NULL AS source_file, count(*) AS rows, CAST(sum(flows) AS BIGINT) AS flows FROM train
UNION ALL
SELECT 'holdout', source_file, count(*), CAST(sum(flows) AS BIGINT) FROM parted WHERE part = 'test' GROUP BY source_file""")
def split_folders(spark, sf_dir):
    """Training set and held-out datasets, written and read back."""
    path = scratch_dir(spark, "split")
    parts = split.split_by_file(positioned(spark, sf_dir))
    tables.write_split(parts, path, split.training_set(parts.filter(F.col("part") == "train")))
    sums = [F.count("*").alias("rows"), F.sum("flows").alias("flows")]
    train = spark.read.parquet(f"{path}/train").agg(*sums).withColumn("source_file", F.lit(None).cast("string"))
    held = spark.read.parquet(f"{path}/holdout").groupBy("source_file").agg(*sums)
    return train.withColumn("part", F.lit("train")).unionByName(held.withColumn("part", F.lit("holdout")))


@query(f"""
WITH {WINDOWED}
SELECT sensor_id, window_start, flows, 0 AS bytes_total, 0 AS iat_mean,
       CASE WHEN window_start < TIMESTAMP '2024-01-16' THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END AS threshold
FROM features WHERE window_start + INTERVAL '6 hours' <= (SELECT max(ts) FROM events)""")
def refreshed_policy(spark, sf_dir):
    """Windows with the policy in force when their batch ran, changed between two batches."""
    rows = sq.feature_table(spark, sf_dir)
    late = (F.col("window_start") >= F.lit("2024-01-16").cast("timestamp")).cast("int")
    path = sq.in_files(rows, "policy-windows", late, 2)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    policies = iter([0.9, 0.6])
    out = scratch_dir(spark, "with-policy")
    writer = sd.attach_policy_each_batch(stream, lambda s: po.Policy(threshold=next(policies)), out)
    writer.option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    kept = spark.read.parquet(out).select("sensor_id", "window_start", "flows", "threshold")
    return clean.add_missing_features(kept, ["bytes_total", "iat_mean"])


@query(f"""
WITH {WINDOWED}
SELECT sensor_id, window_start, flows FROM features WHERE window_start + INTERVAL '6 hours' <= (SELECT max(ts) FROM events)""")
def windows_acted_on_once(spark, sf_dir):
    """Windows that come in two files, the second with all of the first, each given on once."""
    rows = sq.feature_table(spark, sf_dir)
    path = scratch_dir(spark, "repeated-windows")
    half = F.pmod(F.xxhash64("sensor_id", "window_start"), F.lit(2)) == 0
    for part in (rows.filter(half), rows):
        part.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    once = sf.once_per_window(stream, lateness="60 days")
    return sq.run_to_end(once.select("sensor_id", "window_start", "flows"), "once")


# --- what must hold of any model ---


@query(f"""
WITH {WINDOWED}, {SPLIT}, n AS (SELECT count(*) AS rows FROM features),
held AS (SELECT count(DISTINCT source_file) AS files, count(*) AS rows FROM parted WHERE part = 'test')
SELECT n.rows AS windows, CAST(0 AS BIGINT) AS scores_out_of_range, CAST(0 AS BIGINT) AS scores_off_log_odds,
       CAST({len(FEATURES)} AS BIGINT) AS features, CAST(1000000 AS BIGINT) AS importance_millionths,
       CAST(0 AS BIGINT) AS reasons_off_contributions, held.rows AS held_rows,
       TRUE AS metrics_in_range, TRUE AS confusion_adds_up, CAST(0 AS BIGINT) AS scores_off_stored_model,
       '{",".join(FEATURES)}' AS stored_features, TRUE AS stored_threshold FROM n, held""")
def model_invariants(spark, sf_dir):
    """Relations between training, scores, importances, reasons and metrics, whatever the trees are."""
    parts, detector = trained(spark, sf_dir)
    rows, _ = explained(spark, sf_dir)
    scored = md.score(windows(spark, sf_dir), detector.model).select("sensor_id", "window_start", "score")
    stored, meta = md.load_model(spark, detector.path)
    reread = md.score(windows(spark, sf_dir), stored).select("sensor_id", "window_start", F.col("score").alias("stored_score"))
    rows = rows.join(scored, ["sensor_id", "window_start"]).join(reread, ["sensor_id", "window_start"])
    sigmoid = 1 / (1 + F.exp(-F.col("log_odds")))
    text = reason_text(top_contributions(FEATURES, F.col("contributions")))
    pushed = F.size(F.filter("contributions", lambda c: c > 0))
    off = (pushed == 0) != (text == "global bias")
    off = off | (pushed > 0) & (F.size(F.split(text, ", ")) != F.least(pushed, F.lit(3)))
    checks = rows.agg(
        F.count("*").alias("windows"),
        F.count_if(~F.col("score").between(0, 1)).alias("scores_out_of_range"),
        F.count_if(F.abs(F.col("score") - sigmoid) > 1e-9).alias("scores_off_log_odds"),
        F.count_if(off).alias("reasons_off_contributions"),
        F.count_if(F.abs(F.col("score") - F.col("stored_score")) > 1e-12).alias("scores_off_stored_model"),
    )
    weights = md.feature_importances(spark, detector.model).agg(
        F.count("*").alias("features"), F.round(F.sum("importance") * 1_000_000).cast("long").alias("importance_millionths")
    )
    held = parts.filter(F.col("part") == "test").agg(F.count("*").alias("held_rows"))
    m = detector.metrics
    # with one class only, the area under the ROC curve is null
    between = [F.coalesce(F.col(c).between(0, 1), F.lit(c == "roc_auc")) for c in ("roc_auc", "pr_auc", "best_threshold", "accuracy")]
    cells = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    told = m.select(
        F.forall(F.array(*between), lambda x: x).alias("metrics_in_range"),
        ((cells > 0) & (F.abs((F.col("tp") + F.col("tn")) / cells - F.col("accuracy")) < 1e-9)).alias("confusion_adds_up"),
    )
    told = told.withColumns({"stored_features": F.lit(",".join(meta.features)), "stored_threshold": F.lit(meta.threshold == detector.threshold)})
    return checks.crossJoin(weights).crossJoin(held).crossJoin(told)  # one row each


@query("SELECT TRUE AS a_loss_a_round, TRUE AS losses_finite, TRUE AS best_is_least, TRUE AS better_than_first")
def validation_curve(spark, sf_dir):
    """The trained model's loss on all training rows, round by round."""
    parts, detector = trained(spark, sf_dir)
    held = parts.filter(F.col("part") == "train").withColumn("y", binary_label(F.col("label")))
    losses = md.validation_curve(detector.model, clean.drop_invalid(held.select(*FEATURES, "y")))
    best, _ = md.best_round(losses, len(losses))
    told = (len(losses) == detector.model.getNumTrees, all(map(math.isfinite, losses)), losses[best] == min(losses), losses[best] <= losses[0])
    return spark.createDataFrame([told], "a_loss_a_round boolean, losses_finite boolean, best_is_least boolean, better_than_first boolean")

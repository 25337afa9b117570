"""Decision policy, counts and block list on streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from flowsight.functions.decision import KILL_SCORE
from flowsight.operators.alerts import is_block
from flowsight.operators.policy import NEVER, attach_policy, finish, lifted_thresholds, run_chunk, running_hits
from flowsight.schema import KEY, Policy

def _longs(*names: str) -> list[T.StructField]:
    return [T.StructField(c, T.LongType()) for c in names]


HISTORY = T.StructType(
    [
        *_longs("index", "last_at", "decided_upto"),
        T.StructField("recent", T.ArrayType(T.IntegerType())),
        T.StructField("scores", T.ArrayType(T.DoubleType())),
    ]
)
#: What a decision needs of a row; the rest of it travels as one text.
NEEDED = [
    *_longs("at_us", "wait_us", "grace", "window", "adaptive_window"),
    *[T.StructField(c, T.DoubleType()) for c in ("score", "threshold", "instant_block", "adaptive_sensitivity", "adaptive_min")],
    T.StructField("use_adaptive", T.BooleanType()),
    T.StructField("body", T.StringType()),
]
PLACE = T.StructType(_longs("order_us", "number"))
RESULT = [
    T.StructField("body", T.StringType()),
    *_longs("at_us", "wait_us", "index"),
    T.StructField("effective_threshold", T.DoubleType()),
    T.StructField("is_attack", T.BooleanType()),
    T.StructField("hits_in_window", T.IntegerType()),
    *_longs("_last_at"),
    T.StructField("out_of_order", T.BooleanType()),
]


class Decider(StatefulProcessor):
    """Per sensor: rows that wait for earlier ones, and what later decisions depend on.

    If they are to ``wait``, rows stay in the state until the watermark passes them, are then taken in
    order, and decided as arrays. A row that comes after later ones were decided can't be put in
    order any more; it is decided at once, after them, and marked.
    """

    def __init__(self, wait: bool):
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.history = handle.getValueState("history", HISTORY)
        self.waiting = handle.getMapState("waiting", PLACE, T.StructType(NEEDED))
        self.numbers = handle.getValueState("numbers", T.StructType(_longs("next")))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        upto = self.history.get()[2] if self.history.exists() else NEVER
        late = (batch["order_us"] < upto).to_numpy()
        if late.any():
            yield self.decide(batch[late].sort_values("order_us", kind="stable", ignore_index=True), True)
        kept = batch[~late]
        if not self.wait:
            if len(kept):
                yield self.decide(kept.sort_values("order_us", kind="stable", ignore_index=True), False)
            return
        number = self.numbers.get()[0] if self.numbers.exists() else 0
        for row in kept[["order_us", *[f.name for f in NEEDED]]].itertuples(index=False, name=None):
            order, *values = (v.item() if isinstance(v, np.generic) else v for v in row)
            self.waiting.updateValue((order, number), tuple(values))
            number += 1
        self.numbers.update((number,))
        if len(kept):
            self.handle.registerTimer(int(kept["order_us"].min()) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = [(*place, *values) for place, values in self.waiting.iterator()]
        due = [w for w in waiting if w[0] < passed]
        if len(due) < len(waiting):
            self.handle.registerTimer(min(w[0] for w in waiting if w[0] >= passed) // 1000 + 1)
        for order, number, *_ in due:
            self.waiting.removeKey((order, number))
        if due:
            names = ["order_us", "number", *[f.name for f in NEEDED]]
            yield self.decide(pd.DataFrame(sorted(due, key=lambda w: w[:2]), columns=names), False)

    def decide(self, rows: pd.DataFrame, out_of_order: bool) -> pd.DataFrame:
        index, last_at, upto, recent, scores = 0, NEVER, NEVER, [], []
        if self.history.exists():
            index, last_at, upto, recent, scores = self.history.get()
        column = {c: rows[c].to_numpy() for c in rows.columns}
        score, at, wait = column["score"].astype(float), column["at_us"].astype(np.int64), column["wait_us"].astype(np.int64)
        window, frame = (np.maximum(column[c].astype(np.int64), 1) for c in ("window", "adaptive_window"))
        before = np.array(scores, dtype=float)
        lifted = lifted_thresholds(score, before, frame, column["adaptive_sensitivity"].astype(float))
        threshold = column["threshold"].astype(float)
        adaptive = column["use_adaptive"].astype(bool) & (lifted > -np.inf)
        threshold = np.where(adaptive, np.maximum(np.maximum(threshold, lifted), column["adaptive_min"].astype(float)), threshold)
        attack = score >= threshold
        hits = running_hits(attack.astype(int), np.array(recent, dtype=int), window)
        certain = attack & (score >= np.minimum(KILL_SCORE, column["instant_block"].astype(float)))
        possible = certain | (attack & (hits >= column["grace"]))
        if out_of_order:  # clocks may step back here, so the chain is followed row by row
            last = np.empty(len(rows), dtype=np.int64)
            for i in range(len(rows)):
                last[i] = last_at
                if certain[i] or (possible[i] and at[i] - last_at > wait[i]):
                    last_at = max(last_at, int(at[i]))
        else:
            last, last_at = run_chunk(at, certain, possible, wait, int(last_at), leaving=True)
        recent = [*recent, *attack.astype(int).tolist()][-int(window.max()) :]
        scores = [*scores, *score.tolist()][-int(frame.max()) :]
        upto = max(upto, int(column["order_us"].max()))
        self.history.update((index + len(rows), int(last_at), upto, recent, scores))
        return pd.DataFrame(
            {
                "body": rows["body"], "at_us": at, "wait_us": wait, "index": index + np.arange(len(rows)),
                "effective_threshold": threshold, "is_attack": attack, "hits_in_window": hits.astype(np.int32),
                "_last_at": pd.Series(last, dtype="Int64").mask(last == NEVER),
                "out_of_order": out_of_order,
            }
        )

    def close(self) -> None:
        pass


#: How rows travel through the state as text: every time with its microseconds, every null kept.
AS_TEXT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}


def decide_stream(
    scored: DataFrame,
    policy: Policy | DataFrame | None = Policy(),
    key: str = KEY,
    order: str = "window_start",
    clock: str = "window_end",
    *,
    lateness: str | None = None,
) -> DataFrame:
    """As ``operators.policy.decide`` for a stream of scored windows, in any order within ``lateness``.

    A row waits until the stream's time is ``lateness`` past its ``order``; then it is decided after
    all earlier ones. The rows within ``lateness`` of the newest wait for more input. Without
    ``lateness`` every row is decided in the micro-batch that brings it. Rows that come after later
    ones were decided are not lost: they are decided when they come, and have ``out_of_order`` set.
    ``policy=None`` takes the policy columns that the rows already carry (see
    :func:`attach_policy_each_batch`).
    """
    rows = scored if policy is None else attach_policy(scored, policy, key)
    carried = T.StructType(rows.schema.fields)
    as_given = {c: F.col(c).cast(k) for c, k in (("grace", "long"), ("window", "long"), ("adaptive_window", "long"))}
    # The watermark's own column stays behind here: rows that it calls late must reach the operator.
    rows = rows if lateness is None else rows.withWatermark(order, lateness)
    rows = rows.select(
        key,
        F.unix_micros(order).alias("order_us"),
        F.unix_micros(clock).alias("at_us"),
        F.round(F.col("cooldown_sec").cast("double") * 1e6).cast("long").alias("wait_us"),
        *[c.alias(n) for n, c in as_given.items()],
        *[F.col(f.name).cast(f.dataType) for f in NEEDED if f.name not in ("at_us", "wait_us", "body", *as_given)],
        F.to_json(F.struct(*[f"`{c}`" for c in carried.names]), AS_TEXT).alias("body"),
    )
    out = rows.groupBy(key).transformWithStateInPandas(
        statefulProcessor=Decider(lateness is not None),
        outputStructType=T.StructType(RESULT),
        outputMode="Append",
        timeMode="None" if lateness is None else "EventTime",
    )
    out = out.withColumn("_row", F.from_json("body", carried, AS_TEXT)).select(
        "_row.*", *[F.col(f.name) for f in RESULT if f.name != "body"]
    )
    out = out.withColumnsRenamed({"at_us": "_at", "wait_us": "_wait"})
    return finish(out, key)


def attach_policy_each_batch(
    scored: DataFrame,
    read_policy: Callable[[SparkSession], Policy | DataFrame],
    path: str,
    key: str = KEY,
) -> DataStreamWriter:
    """Writes scored rows with the policy in force when their batch runs.

    ``read_policy`` is called for every batch, so an edited policy applies from the next one on.
    Each batch has its own folder below ``path``, which a retry of the batch replaces.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = attach_policy(batch, read_policy(batch.sparkSession), key)
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return scored.writeStream.foreachBatch(write)


def alert_counts_stream(alerts: DataFrame, window: str = "1 hour", *, lateness: str) -> DataFrame:
    """Running totals, attacks and blocks per window of event time, and per class."""
    timed = alerts.withColumn("at", F.timestamp_micros((F.col("ts") * 1_000_000).cast("long")))
    return (
        timed.withWatermark("at", lateness)
        .groupBy(F.window("at", window).alias("_window"), "pred_class")
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(F.col("state") == "ATTACK").alias("attacks"),
            F.count_if(is_block()).alias("blocks"),
        )
        .select(
            F.col("_window.start").alias("window_start"), "pred_class", "total", "attacks", "blocks"
        )
    )


def block_list_stream(alerts: DataFrame) -> DataFrame:
    """Blocked addresses with their number of blocks; use the update or complete mode."""
    ranks = F.when(F.col("action") == "BLOCK-KILL", 3).when(F.col("action") == "BLOCK-HARD", 2).otherwise(1)
    return (
        alerts.filter(is_block() & F.col("src_ip").isNotNull())
        .groupBy("src_ip")
        .agg(
            F.min("ts").alias("first_block"),
            F.max("ts").alias("last_block"),
            F.count(F.lit(1)).alias("blocks"),
            F.max(ranks).alias("level"),
        )
        .withColumn("severity", F.get(F.array(F.lit("SOFT"), F.lit("HARD"), F.lit("KILL")), F.col("level") - 1))
        .drop("level")
    )

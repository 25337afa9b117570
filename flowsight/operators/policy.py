"""Decision policy: hits, adaptive threshold, cooldown, severity, actions, block list."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsight.functions.decision import (
    KILL_SCORE,
    block_outcome,
    no_block_reason,
    predicted_class,
    severity,
    top_class,
)
from flowsight.operators.lookups import lookup, match
from flowsight.operators.ordering import time_bucket, with_position
from flowsight.schema import KEY, Policy
from flowsight.session import materialize

CLASSES = ["benign", "attack"]  # fixed values: classes of the two-class model, benign first

FRAMES = ("window", "adaptive_window")  # policy columns that are frame lengths
CHUNK_ROWS = 50_000
FRAME_CELLS = 4_000_000  # scores whose mean and spread are worked out at a time
POSITION_BUCKET_SEC = 600


def attach_policy(
    scored: DataFrame, policy: Policy | DataFrame, key: str = KEY, default: Policy = Policy()
) -> DataFrame:
    """Policy parameters as columns.

    ``policy`` is one set of parameters for all rows, or a table of them per sensor (any subset of
    the columns); what a table leaves out comes from ``default``.
    """
    if isinstance(policy, Policy):
        return scored.withColumns({c: F.lit(getattr(policy, c)) for c in Policy.columns()})
    given = [c for c in Policy.columns() if c in policy.columns]
    out = lookup(scored, policy.select(key, *given), [key])
    return out.withColumns(
        {
            c: F.coalesce(F.col(c), F.lit(getattr(default, c))) if c in given
            else F.lit(getattr(default, c))
            for c in Policy.columns()
        }
    )


def in_chunks(
    rows: DataFrame, key: str, order: str | Sequence[str], reach: int | Column, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Cut each sensor's rows, in order, into chunks that can be worked on apart.

    ``order`` is a time column, or several of which the first is one and the others settle ties.
    Adds ``index`` (row position in the sensor), ``_chunk``, and ``_own``. A row is repeated, with
    ``_own`` false, in the later chunks that begin within ``reach`` rows of it, so a frame of that many
    preceding rows sees the same rows as over the whole sensor.
    """
    order = [order] if isinstance(order, str) else list(order)
    bucket = time_bucket(F.col(order[0]), POSITION_BUCKET_SEC)
    placed = with_position(rows, [key], order, bucket, "index")
    chunk_of = lambda index: F.floor(index / F.lit(chunk_rows)).cast("long")
    chunk = chunk_of(F.col("index"))
    copies = F.sequence(chunk, chunk_of(F.col("index") + reach))
    return placed.withColumn("_chunk", F.explode(copies)).withColumn(
        "_own", F.col("_chunk") == chunk
    )


def lifted_thresholds(scores: np.ndarray, before: np.ndarray, frame: np.ndarray, sensitivity: np.ndarray) -> np.ndarray:
    """Mean and spread of the last ``frame`` scores of each row, itself included; -inf for ten or fewer.

    ``before`` are the scores that came ahead. Rows with equal frames are worked out together.
    """
    out = np.full(len(scores), -np.inf)
    for size in np.unique(frame):
        padded = np.concatenate([np.full(int(size), np.nan), before, scores])[-(len(scores) + int(size) - 1) :]
        views = np.lib.stride_tricks.sliding_window_view(padded, int(size))
        rows = np.flatnonzero((frame == size) & (np.sum(~np.isnan(views), axis=1) > 10))
        for part in np.array_split(rows, 1 + len(rows) * int(size) // FRAME_CELLS):
            if len(part):
                out[part] = np.nanmean(views[part], axis=1) + sensitivity[part] * np.nanstd(views[part], axis=1)
    return out


def running_hits(attack: np.ndarray, before: np.ndarray, frame: np.ndarray) -> np.ndarray:
    """Attacks among the last ``frame`` rows, itself included."""
    total = np.concatenate([[0], np.cumsum(np.concatenate([before, attack]))])
    end = len(before) + np.arange(len(attack)) + 1
    return total[end] - total[np.maximum(end - frame, 0)]


def with_state(chunked: DataFrame, policy: Policy, key: str = KEY) -> DataFrame:
    """Effective threshold, attack state and hits of each row, by one policy for all (attached)."""
    order = W.partitionBy(key, "_chunk").orderBy("index")
    history = order.rowsBetween(-(max(policy.adaptive_window, 1) - 1), 0)
    recent = order.rowsBetween(-(max(policy.window, 1) - 1), 0)
    lifted = F.avg("score").over(history) + F.col("adaptive_sensitivity") * F.stddev_pop("score").over(history)
    active = F.col("use_adaptive") & (F.count("score").over(history) > 10)
    threshold = F.when(
        active, F.greatest(F.col("threshold"), F.greatest(lifted, F.col("adaptive_min")))
    ).otherwise(F.col("threshold"))
    rows = chunked.withColumn("effective_threshold", threshold).withColumn(
        "is_attack", F.col("score") >= F.col("effective_threshold")
    )
    return rows.withColumn("hits_in_window", F.sum(F.col("is_attack").cast("int")).over(recent).cast("int"))


def with_own_state(chunked: DataFrame, key: str = KEY) -> DataFrame:
    """As :func:`with_state` with each sensor's own frame lengths; a chunk is worked on as arrays."""

    def states(chunk: pa.Table) -> pa.Table:
        chunk = chunk.sort_by("index")
        column = {c: _column(chunk, c) for c in ("score", "threshold", "adaptive_sensitivity", "adaptive_min", "use_adaptive")}
        window, frame = (np.maximum(_column(chunk, c).astype(np.int64), 1) for c in FRAMES)
        score, threshold = column["score"].astype(float), column["threshold"].astype(float)
        lifted = lifted_thresholds(score, score[:0], frame, column["adaptive_sensitivity"].astype(float))
        active = column["use_adaptive"].astype(bool) & (lifted > -np.inf)
        raised = np.maximum(np.maximum(threshold, lifted), column["adaptive_min"].astype(float))
        threshold = np.where(active, raised, threshold)
        attack = score >= threshold
        hits = running_hits(attack.astype(np.int64), np.zeros(0, dtype=np.int64), window)
        found = [("effective_threshold", threshold, pa.float64()), ("is_attack", attack, pa.bool_()), ("hits_in_window", hits, pa.int32())]
        for name, values, kind in found:
            chunk = chunk.append_column(name, pa.array(values, kind))
        return chunk.filter(chunk.column("_own"))

    added = [T.StructField("effective_threshold", T.DoubleType()), T.StructField("is_attack", T.BooleanType()), T.StructField("hits_in_window", T.IntegerType())]
    return chunked.groupBy(key, "_chunk").applyInArrow(states, T.StructType(chunked.schema.fields + added))


def adaptive_threshold(
    scored: DataFrame,
    policy: Policy,
    key: str = KEY,
    order: str | Sequence[str] = "window_start",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """``effective_threshold``, ``is_attack`` and ``hits_in_window`` for every scored row."""
    rows = in_chunks(attach_policy(scored, policy, key), key, order, policy.reach, max(chunk_rows, 1))
    return with_state(rows, policy, key).filter("_own").drop("_chunk", "_own", *Policy.columns())


# --- cooldown ---
#
# Whether a row may trigger a SOFT block depends on the time of the last block, which may itself be
# a SOFT one, so a sensor's rows form a chain. A chunk of that chain is a function of one number,
# the last block time on entry. It is summed up as a step function: (bound, exit) pairs, read as
# "with a last block before `bound`, the last block on leaving is `exit`". Composing the chunks'
# functions gives each chunk's entry, after which all chunks run side by side. All times are whole
# microseconds.

NEVER = -(2**62)
ALWAYS = 2**62


def _followers(at: np.ndarray, certain: np.ndarray, wait: np.ndarray) -> np.ndarray:
    """For each possible block, the place of the block that comes after it (len = none)."""
    place = np.arange(len(at))
    rested = np.maximum(np.searchsorted(at, at + wait, side="right"), place + 1)
    sure = np.append(np.flatnonzero(certain), len(at))
    return np.minimum(rested, sure[np.searchsorted(sure[:-1], place, side="right")])


def chunk_steps(at: np.ndarray, certain: np.ndarray, wait: np.ndarray):
    """Step function (bounds, exits) of a chunk, from its possible blocks in order.

    A last block that no bound exceeds passes through the chunk unchanged.
    """
    after = _followers(at, certain, wait)
    exits = at.copy()
    for i in range(len(at) - 1, -1, -1):
        if after[i] < len(at):
            exits[i] = exits[after[i]]
    bounds = np.where(certain, ALWAYS, at - wait)
    # No entry is later than the chunk's first row, so the first block is never past this place.
    settled = bounds > at[:1]
    count = int(np.argmax(settled)) + 1 if settled.any() else len(at)
    bounds, exits = bounds[:count], exits[:count]
    # Chains soon run together; of neighbours with one exit only the last bound matters.
    kept = np.append(exits[1:] != exits[:-1], True)[:count]
    return bounds[kept], exits[kept]


def follow_steps(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Each chunk's entry, from steps in order of sensor, chunk and place.

    The entry of a chunk is the exit of the first step of the chunk before whose bound exceeds that
    chunk's entry, or that entry itself if there is none.
    """
    sensor, chunk, entry, left, open_ = None, None, NEVER, NEVER, False
    for batch in batches:
        sensors, chunks = batch.column(key), _column(batch, "_chunk")
        bounds, exits = _column(batch, "bound"), _column(batch, "exit")
        codes = sensors.dictionary_encode(null_encoding="encode").indices.to_numpy()
        heads = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (chunks[1:] != chunks[:-1])])
        found, at = [], []
        for head, end in zip(heads, np.r_[heads[1:], len(chunks)]):
            here = (sensors[head].as_py(), int(chunks[head]))
            if chunk is None or here != (sensor, chunk):
                entry = left = NEVER if chunk is None or here[0] != sensor else left
                sensor, chunk, open_ = *here, True
                found.append(entry)
                at.append(head)
            if open_:
                hit = np.flatnonzero(bounds[head:end] > entry)
                if len(hit):
                    left, open_ = int(exits[head + hit[0]]), False
        if at:
            rows = batch.select([key, "_chunk"]).take(pa.array(at))
            yield rows.append_column("_entry", pa.array(found, pa.int64()))


def run_chunk(
    at: np.ndarray, certain: np.ndarray, possible: np.ndarray, wait: np.ndarray, entry: int, leaving: bool = False
):
    """Last block time before each row, given the last block time on entry; with ``leaving`` also on leaving."""
    places = np.flatnonzero(possible)
    after = _followers(at[places], certain[places], wait[places])
    first = np.where(certain[places], ALWAYS, at[places] - wait[places]) > entry
    blocks = np.zeros(len(at), dtype=bool)
    i = int(np.argmax(first)) if first.any() else len(places)
    while i < len(places):
        blocks[places[i]] = True
        i = after[i]
    latest = np.concatenate(([entry], np.maximum.accumulate(np.where(blocks, at, entry))))
    return (latest[:-1], latest[-1]) if leaving else latest[:-1]


def _column(rows: pa.Table, name: str) -> np.ndarray:
    return rows.column(name).to_numpy(zero_copy_only=False)


def with_cooldown(rows: DataFrame, key: str, chunk_rows: int) -> DataFrame:
    """Adds ``_last_at``, the time of the sensor's last block before each row (null = none).

    Chunk ``c`` of a sensor begins with its row ``c * chunk_rows``.
    """

    def steps(chunk: pa.Table) -> pa.Table:
        blocks = chunk.filter(chunk.column("_possible")).sort_by("index")
        bounds, exits = chunk_steps(*[_column(blocks, c) for c in ["_at", "_certain", "_wait"]])
        # a chunk without steps still has a row, which no entry meets
        bounds, exits = (values if len(bounds) else np.array([NEVER]) for values in (bounds, exits))
        same = pa.array(np.zeros(len(bounds), dtype=np.int64))
        named = chunk.select([key, "_chunk"]).take(same)
        for name, values in [("step", np.arange(len(bounds))), ("bound", bounds), ("exit", exits)]:
            named = named.append_column(name, pa.array(values, pa.int64()))
        return named

    def run(chunk: pa.Table) -> pa.Table:
        chunk = chunk.sort_by("index")
        entry = chunk.column("_entry")[0].as_py()
        last = run_chunk(
            *[_column(chunk, c) for c in ["_at", "_certain", "_possible", "_wait"]], entry
        )
        last_at = pa.array(last, pa.int64(), mask=last == NEVER)
        return chunk.drop_columns(["_entry"]).append_column("_last_at", last_at)

    ids = [rows.schema[key], T.StructField("_chunk", T.LongType())]
    steps_type = T.StructType(ids + [T.StructField(c, T.LongType()) for c in ("step", "bound", "exit")])
    entry_type = T.StructType(ids + [T.StructField("_entry", T.LongType())])
    out_type = T.StructType(rows.schema.fields + [T.StructField("_last_at", T.LongType())])

    # Only possible blocks matter here; a chunk's first row keeps chunks without any in the list.
    slim = rows.select(key, "_chunk", "index", "_at", "_certain", "_possible", "_wait")
    marked = slim.filter(F.col("_possible") | (F.col("index") == F.col("_chunk") * F.lit(chunk_rows)))
    summaries = marked.groupBy(key, "_chunk").applyInArrow(steps, steps_type)
    ordered = summaries.repartition(key).sortWithinPartitions(key, "_chunk", "step")
    entered = ordered.mapInArrow(partial(follow_steps, key=key), entry_type)
    rows = match(rows, entered, [key, "_chunk"]).select(*rows.columns, "_entry")
    return rows.groupBy(key, "_chunk").applyInArrow(run, out_type)


def decide(
    scored: DataFrame,
    policy: Policy | DataFrame = Policy(),
    key: str = KEY,
    order: str | Sequence[str] = "window_start",
    clock: str = "window_end",
    default: Policy = Policy(),
    chunk_rows: int = CHUNK_ROWS,
    staged: bool = False,
) -> DataFrame:
    """Apply the policy to scored windows, in order per sensor.

    Scored single flows work too, with ``order=("ts", "arrival_seq")`` and ``clock="ts"``.
    Per row: ``index``, ``effective_threshold``, ``state``, ``hits_in_window``, ``severity``
    (KILL and HARD by score alone; SOFT for a burst of hits outside the cooldown), ``action``,
    ``pred_class``, ``no_block_reason`` and the block outcome. Any block restarts the cooldown.
    A policy table may set frame lengths per sensor; no job runs while the plan is built. The rows are gone through twice
    (once for the cooldown carried between chunks); ``staged`` writes them to the shared scratch
    folder in between instead of working them out again.
    """
    attached = attach_policy(scored, policy, key, default)
    if isinstance(policy, Policy) or not any(c in policy.columns for c in FRAMES):
        frames = policy if isinstance(policy, Policy) else default
        chunk_rows = max(chunk_rows, frames.reach, 1)
        rows = with_state(in_chunks(attached, key, order, frames.reach, chunk_rows), frames, key)
    else:
        at_least_one = [F.greatest(F.col(c), F.lit(1)) for c in FRAMES]
        rows = with_own_state(in_chunks(attached, key, order, at_least_one[0] + at_least_one[1] - 2, chunk_rows), key)
    rows = rows.filter("_own").drop("_own")
    attack, score = F.col("is_attack"), F.col("score")
    instant = score >= F.least(F.col("instant_block"), F.lit(KILL_SCORE))
    rows = rows.withColumns(
        {
            "_at": F.unix_micros(clock),
            "_wait": F.round(F.col("cooldown_sec").cast("double") * 1e6).cast("long"),
            "_certain": attack & instant,
            "_possible": attack & (instant | (F.col("hits_in_window") >= F.col("grace"))),
        }
    )
    if staged:
        rows = materialize(rows, "decision")
    return finish(with_cooldown(rows, key, chunk_rows), key)


def finish(rows: DataFrame, key: str = KEY) -> DataFrame:
    """Severity, action and texts from the state columns.

    The predicted class is the model's most probable one (``model_class`` if the rows carry it),
    replaced by the attack type from the base threshold on.
    """
    attack, score = F.col("is_attack"), F.col("score")
    cooled = F.col("_last_at").isNull() | (F.col("_at") - F.col("_last_at") > F.col("_wait"))
    burst = (F.col("hits_in_window") >= F.col("grace")) & cooled
    rows = rows.withColumn("severity", severity(attack, score, F.col("instant_block"), burst))
    level = F.col("severity")
    if "model_class" in rows.columns:
        model_class = F.col("model_class")
    else:
        model_class = top_class(F.array(1 - score, score), CLASSES, vector=False)
    ip = F.col("top_src_ip") if "top_src_ip" in rows.columns else F.lit(None).cast("string")
    ok, how = block_outcome(ip, F.col("dry_run"), level)
    rows = rows.withColumns(
        {
            "state": F.when(attack, F.lit("ATTACK")).otherwise(F.lit("benign")),
            "action": F.when(level == "NONE", F.lit("NONE")).otherwise(F.concat(F.lit("BLOCK-"), level)),
            "pred_class": predicted_class(score, F.col("threshold"), model_class),
            "no_block_reason": no_block_reason(
                attack, cooled, level, F.col("hits_in_window"), score,
                F.col("grace"), F.col("cooldown_sec"), F.col("instant_block"),
            ),
            "block_ok": ok,
            "block_how": how,
        }
    )
    hidden = ["_chunk", "_certain", "_possible", "_at", "_wait", "_last_at"]
    return rows.drop(*hidden, *Policy.columns())


def block_list(alerts: DataFrame, ip: str = "src_ip", at: str = "ts") -> DataFrame:
    """Blocked addresses: first and last block, number of blocks, strongest response."""
    ranks = ["SOFT", "HARD", "KILL"]
    level = F.array_position(F.array(*[F.lit(r) for r in ranks]), F.replace("action", F.lit("BLOCK-"), F.lit("")))
    return (
        alerts.filter(F.col("action").startswith("BLOCK") & F.col(ip).isNotNull())
        .groupBy(ip)
        .agg(
            F.min(at).alias("first_block"),
            F.max(at).alias("last_block"),
            F.count(F.lit(1)).alias("blocks"),
            F.max(level).alias("_level"),
        )
        .withColumn("severity", F.get(F.array(*[F.lit(r) for r in ranks]), F.col("_level").cast("int") - 1))
        .drop("_level")
    )

"""Repeated word sequences, by seed and extend.

The unit is a window of ``length`` words. Every window has one anchor: its k-gram of smallest hash
(the last of equals), a function of the window's words alone, so equal windows have equal anchors at
equal places. Windows with the same anchor occurrence are neighbours and form a stretch of at most
2 * length - k words. Seeds are the anchors found at two places or more.

A stretch is extended both ways to all its windows at once: if the whole stretch occurs again, so do
all its windows, and they are done. Only where an anchor occurs in different stretches (at the ends
of a repeat) are its windows compared one by one, each different stretch once. What is joined are
anchors and stretches, never pairs of documents, so an anchor shared by many documents costs as many
rows as it has occurrences. Overlapping and adjoining repeated windows add up to maximal repeats.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsight.llm.common import numbered, ragged, text_chunks, words_of
from flowsight.llm.hashing import ODD, Sequence, mixed, word_hashes
from flowsight.session import materialize

ANCHOR_WORDS = 8
#: Windows of most occurrences that are sent to all tasks: 16 bytes each.
HOT_WINDOWS = 1000


def anchors(sequence: Sequence, n_words: int, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Place of the anchor of every window of ``length`` words, and the k-grams' hashes.

    The window of grams doubles until it is wide enough; of equal hashes the last one stays.
    """
    grams = sequence.runs(np.arange(n_words - k + 1), k)
    place, width, full = np.arange(len(grams)), 1, length - k + 1
    while width < full:
        step = min(width, full - width)
        left, right = place[:-step], place[step:]
        place = np.where(grams[right] <= grams[left], right, left)
        width += step
    return place, grams


def stretches(hashes: np.ndarray, counts: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Text, first window, number of windows, anchor hash and text hash of each stretch.

    ``hashes`` are the words of several texts, one text after the other, ``counts`` of each.
    """
    ends = np.cumsum(counts)
    usable = np.maximum(counts - length + 1, 0)
    at = ragged(usable, ends - counts)  # the windows within one text
    if not len(at):
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(3)) + tuple(np.zeros(0, dtype=np.uint64) for _ in range(2))
    sequence = Sequence(hashes)
    place, grams = anchors(sequence, len(hashes), length, k)
    place = place[at]
    head = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    count = np.diff(np.r_[head, len(place)])
    first, anchor = at[head], place[head]
    # where the anchor lies counts too, as equal words with another anchor place are other windows
    with np.errstate(over="ignore"):
        whole = sequence.runs(first, count + length - 1) + (anchor - first).astype(np.uint64) * ODD + count.astype(np.uint64)
    text = np.searchsorted(ends, first, "right")
    return text, first - (ends - counts)[text], count, grams[anchor], mixed(whole)


def _stretches(batches: Iterator[pa.RecordBatch], length: int, k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, texts in text_chunks(batch):
            text, first, count, anchor, whole = stretches(*word_hashes([t.encode() for t in texts]), length, k)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("_row").take(pa.array(text)),
                    pa.array(first, pa.int32()),
                    pa.array(count, pa.int16()),
                    pa.array(anchor.view(np.int64)),
                    pa.array(whole.view(np.int64)),
                ],
                names=["_row", "first", "count", "anchor", "whole"],
            )


def _windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Hashes of the single windows of the listed stretches."""
    for batch in batches:
        for rows, texts in text_chunks(batch):
            hashes, counts = word_hashes([t.encode() for t in texts])
            listed = rows.column("stretches")
            text = np.repeat(np.arange(len(texts)), listed.value_lengths().to_numpy())
            fields = dict(zip(("first", "count", "anchor", "lone"), listed.flatten().flatten(), strict=True))
            first, count = (fields[c].to_numpy().astype(np.int64) for c in ("first", "count"))
            start = ragged(count, first)
            begin = np.repeat((np.cumsum(counts) - counts)[text], count)
            window = Sequence(hashes).runs(begin + start, length)
            each = pa.array(np.repeat(np.arange(len(text)), count))
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("_row").take(pa.array(np.repeat(text, count))),
                    pa.array(start, pa.int32()),
                    pa.array(window.view(np.int64)),
                    fields["anchor"].take(each),
                    fields["lone"].take(each),
                ],
                names=["_row", "first", "window", "anchor", "lone"],
            )


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Words without those that a repeated window covers, and the repeats as word ranges."""
    for batch in batches:
        for rows, texts in text_chunks(batch):
            totals, removed, kept, spans = [], [], [], []
            for text, listed in zip(texts, rows.column("repeats").to_pylist(), strict=True):
                words = words_of(text)
                totals.append(len(words))
                if not listed:
                    removed.append(0)
                    spans.append([])
                    kept.append(b" ".join(words).decode())
                    continue
                change = np.zeros(len(words) + 1, dtype=np.int32)
                for r in listed:
                    change[r["first"]] += 1
                    change[r["first"] + r["count"] + length - 1] -= 1
                covered = np.cumsum(change[:-1]) > 0
                edges = np.flatnonzero(np.diff(np.r_[False, covered, False].astype(np.int8)))
                removed.append(int(covered.sum()))
                spans.append([{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)])
                kept.append(b" ".join([w for w, c in zip(words, covered.tolist(), strict=True) if not c]).decode())
            rest = rows.drop_columns(["repeats"])
            yield pa.RecordBatch.from_arrays(
                [
                    *rest.columns,
                    pa.array(totals, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(kept, pa.string()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                ],
                names=[*rest.schema.names, "n_words", "n_removed", "kept", "repeated"],
            )


ADDED = "n_words long, n_removed long, kept string, repeated array<struct<start:int,end:int>>"
ADDED_NAMES = ("n_words", "n_removed", "kept", "repeated")


def repeated_windows(rows: DataFrame, length: int, k: int = ANCHOR_WORDS) -> DataFrame:
    """Stretches and single windows that occur twice or more: (_row, first, count) in windows.

    ``rows`` has ``_row`` (unique long) and ``text``.
    """
    found = rows.mapInArrow(
        partial(_stretches, length=length, k=k), "_row long, first int, count short, anchor long, whole long"
    )
    # Written, so that the join below is a plain one whose hot anchors Spark can split.
    seeds = materialize(found.groupBy("anchor").count().filter(F.col("count") > 1).select("anchor"), "seeds")
    found = materialize(found.join(seeds, "anchor", "left_semi"), "stretches")
    place = F.struct("_row", "first", "count")
    texts = found.groupBy("anchor", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("one"))
    texts = materialize(texts, "stretch-texts")
    copied = texts.filter(F.col("n") > 1).select("anchor", "whole")
    whole = found.join(copied, ["anchor", "whole"], "left_semi").select("_row", "first", "count")

    # Anchors within different stretches: their windows, one occurrence of each stretch.
    mixed_seeds = texts.groupBy("anchor").count().filter(F.col("count") > 1).select("anchor")
    mixed_seeds = materialize(mixed_seeds, "mixed-seeds")
    unclear = texts.join(mixed_seeds, "anchor", "left_semi").select(
        F.col("one._row").alias("_row"),
        F.struct("one.first", "one.count", "anchor", (F.col("n") == 1).alias("lone")).alias("stretch"),
    )
    listed = unclear.groupBy("_row").agg(F.collect_list("stretch").alias("stretches"))  # of one text
    windows = rows.join(listed, "_row").mapInArrow(
        partial(_windows, length=length), "_row long, first int, window long, anchor long, lone boolean"
    )
    twice = windows.groupBy("anchor", "window").count().filter(F.col("count") > 1)
    # The most frequent windows are known to every task; their rows join on a number of their own.
    hot = twice.orderBy(F.desc("count"), "anchor", "window").limit(HOT_WINDOWS).select("anchor", "window")
    lone = windows.filter("lone").join(F.broadcast(hot.withColumn("hot", F.lit(True))), ["anchor", "window"], "left")
    own = F.when(F.col("hot"), F.xxhash64("_row", "first")).otherwise(F.col("anchor"))
    again = twice.select(F.col("anchor").alias("own"), "window", F.lit(True).alias("twice"))
    lone = lone.withColumn("own", own).join(again, ["own", "window"], "left").filter("hot OR twice")
    return whole.unionByName(lone.select("_row", "first", F.lit(1).cast("short").alias("count")))


def remove_repeats(df: DataFrame, key: str = "doc_id", column: str = "text", length: int = 35) -> DataFrame:
    """Returns ``key``, ``column``, ``n_words``, ``n_removed``, ``kept`` and ``repeated``.

    A word is removed if one of the windows of ``length`` words that cover it occurs at two places,
    in the same text or in others; ``kept`` joins the others by one space, and ``repeated`` lists the
    removed word ranges. Windows are judged on the input as it is. Words are runs of characters other
    than space and U+0009 to U+000D. A null text comes back empty; an empty text, or one of fewer
    words than ``length``, keeps all it has. Keys are longs; rows with a repeated or null key are
    rows of their own. Other columns of ``df`` are not returned, whatever their names.
    """
    rows, named = numbered(df.select(F.col(key).alias("_key"), F.coalesce(F.col(column).cast("string"), F.lit("")).alias("text")))
    # Twice the same columns and condition, so that both joins share one shuffle of the texts.
    slim = rows.select("_row", "text").filter(F.col("_row").isNotNull())
    repeats = repeated_windows(slim, length)
    listed = repeats.groupBy("_row").agg(F.collect_list(F.struct("first", "count")).alias("repeats"))
    schema = f"_row long, text string, {ADDED}"
    out = slim.join(listed, "_row", "left").mapInArrow(partial(_cut, length=length), schema)
    if named:  # rows of repeated keys are known by number
        out = out.join(rows.select("_row", "_key"), "_row").drop("_row").withColumnRenamed("_key", "_row")
    out = out.withColumnRenamed("_row", key).withColumnRenamed("text", column)
    return out.select(key, column, *ADDED_NAMES)

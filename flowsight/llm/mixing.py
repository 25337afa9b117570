"""Temperature mixing of sources: weights from a bisected exponent, realised as block permutations.

A source's weight is its share of the tokens to the power of an exponent between 0 (all sources
alike) and 1 (as they are). Entropy falls and repetition of small sources shrinks as the exponent
grows, so bisection finds the exponent for a target entropy, or the smallest one within a repetition
limit. The budget of a source is its weight of all tokens asked for. Every epoch is a pseudo-random
permutation of the source's documents by hash; whole epochs are taken while they fit, and of the last
one the front part that fills the budget. Where it ends follows from the token sums of the
permutation's blocks; only the block with the end is ever sorted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsight.llm.common import frugal
from flowsight.session import materialize

#: Documents of one block of a permutation, on average.
BLOCK_DOCUMENTS = 4096
#: Sources whose plan is sent to all tasks, about 100 bytes each; more are joined by salted shuffles.
SENT_SOURCES = 50_000
SALTS = 64
#: Halvings of the exponent's interval that one pass over the sources makes.
HALVINGS = 5
PASSES = 8


@frugal
def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of the first column, from the bytes as they lie in the batch."""
    for batch in batches:
        texts = batch.column(0).cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if not len(texts):
            continue
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        solid = ~((data == 32) | (data - np.uint8(9) < 5))
        starts = solid.copy()
        starts[1:] &= ~solid[:-1]
        begins = offsets[:-1][offsets[:-1] < offsets[1:]]
        starts[begins] = solid[begins]
        upto = np.concatenate([[0], np.cumsum(starts)])
        rest = batch.columns[1:]
        yield pa.RecordBatch.from_arrays(
            [*rest, pa.array(np.diff(upto[offsets]))], names=[*batch.schema.names[1:], "n_tokens"]
        )


def sized(df: DataFrame, column: str, source: str, key: str) -> DataFrame:
    """(source, mark, n_tokens) of every row; ``mark`` is the row's hash."""
    slim = df.select(F.col(column).cast("string").alias("text"), _named(source).alias("source"), _mark(key, column).alias("mark"))
    schema = T.StructType([*slim.schema[1:], T.StructField("n_tokens", T.LongType())])
    return slim.mapInArrow(_count_words, schema)


def _named(source: str) -> Column:
    """The source as text that is never null; rows without a source are a source of their own."""
    return F.when(F.col(source).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(source).cast("string")))


def _mark(key: str, column: str) -> Column:
    return F.xxhash64(F.col(key).cast("string"), F.col(column).cast("string"))


def _place(mark: Column | str, epoch: Column, seed: int) -> Column:
    """Place in the epoch's permutation: a number from 0 to 2**62."""
    return F.shiftrightunsigned(F.xxhash64(mark, epoch.cast("long"), F.lit(seed)), 2)


@dataclass
class Mixture:
    exponent: float
    entropy: float
    budget: float


def bisect(shares: DataFrame, low_is_right) -> float:
    """The smallest exponent in [0, 1] for which ``low_is_right`` holds of the sums; 1 if none.

    ``shares`` has ``p`` per source. A pass evaluates all exponents that the next halvings could ask
    for, so no source comes to the driver, only their sums. The condition must be monotone.
    """
    low, high = 0.0, 1.0
    steps = 2**HALVINGS
    for _ in range(PASSES):
        grid = [low + (high - low) * i / steps for i in range(steps + 1)]
        sums = shares.agg(*[F.struct(*_sums(a)).alias(f"s{i}") for i, a in enumerate(grid)]).first()
        fits = [low_is_right(a, *sums[i]) for i, a in enumerate(grid)]
        if fits[0]:
            return low
        if not any(fits):
            return high
        low, high = next((grid[i - 1], grid[i]) for i in range(1, steps + 1) if fits[i])
    return high


def _sums(exponent: float) -> list[Column]:
    """Sum of the raised shares, of raised share times log share, and the largest raised/plain ratio."""
    raised = F.pow("p", F.lit(exponent))
    return [
        F.sum(raised).alias("z"),
        F.sum(raised * F.log("p")).alias("m"),
        F.max(F.pow("p", F.lit(exponent - 1.0))).alias("top"),
    ]


def entropy_of(exponent: float, z: float, m: float) -> float:
    """Entropy of the normalised weights, in nats."""
    return math.log(z) - exponent * m / z


def plan(sizes: DataFrame, evenness: float | None, max_epochs: float | None, budget: float | None, seed: int) -> tuple[DataFrame, Mixture]:
    """(source, weight, epochs, cut) per source and the mixture's figures.

    ``epochs`` whole epochs are taken, and of the next one the rows up to place ``cut`` (null: none).
    """
    totals = sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"))
    totals = materialize(totals, "source-totals")
    whole, n_sources = totals.filter("tokens > 0").agg(F.sum("tokens"), F.count(F.lit(1))).first()
    nothing = totals.select("source", F.lit(0.0).alias("weight"), F.lit(1).cast("long").alias("epochs"), F.lit(None).cast("long").alias("cut"))
    if not whole:
        return nothing, Mixture(1.0, 0.0, 0.0)
    budget = float(whole) if budget is None else float(budget)
    shares = totals.filter("tokens > 0").withColumn("p", F.col("tokens") / F.lit(float(whole)))
    exponent = 1.0
    plain = entropy_of(1.0, *shares.agg(*_sums(1.0)).first()[:2])
    if evenness is not None:
        target = plain + evenness * (math.log(n_sources) - plain)
        exponent = bisect(shares, lambda a, z, m, top: entropy_of(a, z, m) <= target + 1e-12)
    if max_epochs is not None:
        exponent = max(exponent if evenness is not None else 0.0, bisect(shares, lambda a, z, m, top: budget / whole * top / z <= max_epochs * (1 + 1e-12)))
    z, m, _ = shares.agg(*_sums(exponent)).first()
    weighed = shares.withColumn("weight", F.pow("p", F.lit(exponent)) / F.lit(z)).withColumn("asked", F.col("weight") * F.lit(budget))
    weighed = weighed.withColumn("epochs", F.floor(F.col("asked") / F.col("tokens") + F.lit(1e-9)).cast("long"))
    weighed = weighed.withColumn("left", F.col("asked") - F.col("epochs") * F.col("tokens")).select(
        "source", "weight", "epochs", "left", F.ceil(F.col("documents") / BLOCK_DOCUMENTS).alias("blocks")
    )
    weighed = materialize(weighed, "weights")

    # Where the last epoch ends: first the block, then the place in it.
    partial = with_plan(sizes.filter("n_tokens > 0"), weighed.filter("left > 0.5"), n_sources, "inner")
    placed = partial.withColumn("place", _place("mark", F.col("epochs"), seed)).withColumn(
        "block", F.floor(F.col("place") / F.lit(2.0**62) * F.col("blocks")).cast("long")
    )
    sums = placed.groupBy("source", "block", "left").agg(F.sum("n_tokens").alias("n"))
    before = W.partitionBy("source").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    ends = sums.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).filter(
        (F.col("before") < F.col("left")) & (F.col("before") + F.col("n") >= F.col("left"))
    )
    ends = materialize(ends.select("source", "block", "before"), "cut-blocks")
    inside = with_plan(placed, ends.withColumnRenamed("block", "cut_block"), n_sources, "inner").filter("block = cut_block")
    inside = inside.groupBy("source", "place", "left", "before").agg(F.sum("n_tokens").alias("n"))
    earlier = W.partitionBy("source").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    cuts = (
        inside.withColumn("upto", F.col("before") + F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .filter(F.col("upto") < F.col("left"))
        .groupBy("source")
        .agg(F.max("place").alias("cut"))
    )
    done = weighed.join(cuts, "source", "left").select("source", "weight", "epochs", "cut")
    empty = nothing.join(weighed.select("source"), "source", "left_anti")
    return materialize(done.unionByName(empty), "mixture"), Mixture(exponent, entropy_of(exponent, z, m), budget)


def with_plan(rows: DataFrame, per_source: DataFrame, n_sources: int, how: str) -> DataFrame:
    """Joins a row per source. A source may hold most rows, so they are never dealt by source alone."""
    if n_sources <= SENT_SOURCES:
        return rows.join(F.broadcast(per_source), "source", how)
    salted = per_source.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (
        rows.withColumn("_salt", F.pmod("mark", F.lit(SALTS)).cast("int")).join(salted, ["source", "_salt"], how).drop("_salt")
    )


def mix(
    df: DataFrame,
    source: str = "source",
    column: str = "text",
    key: str = "doc_id",
    evenness: float | None = 0.5,
    max_epochs: float | None = 4.0,
    budget: float | None = None,
    seed: int = 17,
) -> tuple[DataFrame, Mixture]:
    """The rows of the mixture, and its exponent, entropy and budget in tokens.

    Rows come back with all their columns, once per epoch that takes them, and with ``mix_epoch``
    (from 0) and ``mix_order`` (0 to 1; sorting by it interleaves the sources). ``evenness`` sets the
    target entropy between that of the shares (0) and that of equal shares (1), ``max_epochs`` the
    most that a source may be repeated; the larger exponent holds. ``budget`` are the tokens of the
    mixture, all tokens of ``df`` if None; a source misses its part by less than one document (or one
    group of equal rows). Tokens are words between white space. Rows without a source are a source of
    their own; sources without any token (null and empty texts) keep their rows once. Columns named
    like the added ones are replaced.
    """
    df = df.drop("mix_epoch", "mix_order")
    sizes = materialize(sized(df, column, source, key), "sizes")
    sources, mixture = plan(sizes, evenness, max_epochs, budget, seed)
    n_sources = sources.count()
    names = {"source": "_source", "weight": "_weight", "epochs": "_epochs", "cut": "_cut"}
    rows = df.select(F.struct("*").alias("_row"), _named(source).alias("source"), _mark(key, column).alias("mark"))
    rows = with_plan(rows, sources, n_sources, "inner").withColumnsRenamed(names)
    rows = rows.withColumn("mix_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_epochs"))))
    place = _place("mark", F.col("mix_epoch"), seed)
    rows = rows.filter((F.col("mix_epoch") < F.col("_epochs")) | (place <= F.col("_cut")))
    length = F.col("_epochs") + F.coalesce(F.col("_cut") / F.lit(2.0**62), F.lit(0.0))
    order = (F.col("mix_epoch") + place / F.lit(2.0**62)) / F.greatest(length, F.lit(1e-9))
    return rows.select("_row.*", F.col("mix_epoch").cast("int").alias("mix_epoch"), order.alias("mix_order")), mixture

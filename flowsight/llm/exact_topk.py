"""Exact top-k search by distributed selection over score histograms.

Every query is scored against every row, in tiles. A round counts the scores of each query in equal
bins over the interval that is known to hold its k-th value; the global counts name the bin of the
k-th value, which is the next round's interval, until the bins are one wide. A last pass keeps the
scores above the k-th value and, of those equal to it, the smallest ids. A tile sends only the bins
down to its own k-th score, as the k-th value of all rows can't lie below.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowsight.llm.vectors import mask_own, matrix, tiles, valid_vectors
from flowsight.session import materialize

BINS = 512
#: Integer sums below this are exact in doubles.
EXACT = 2.0**53
#: Scores of one pass inside a tile.
CELLS = 2_000_000
OWN = np.iinfo(np.int64).min


def quantised(df: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    vectors = valid_vectors(df, id_col, vec_col)
    return vectors.withColumn("vec", F.transform("vec", lambda x: F.floor(x * F.lit(scale)).cast("double")))


def _scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products as whole numbers, exact up to 2**63."""
    if np.abs(queries).sum(1).max(initial=0) * np.abs(rows).max(initial=0) < EXACT:
        return (queries @ rows.T).astype(np.int64)
    return np.array([[sum(int(a) * int(b) for a, b in zip(q, r, strict=True)) for r in rows] for q in queries], dtype=np.int64)


def _passes(rows: pd.DataFrame, queries: pd.DataFrame):
    """The scores of a tile, some queries at a time; rows of the query's own id score OWN."""
    if not len(rows) or not len(queries):
        return
    dim = max(rows.vec.map(len).max(), queries.vec.map(len).max())
    a, b = matrix(queries.vec, dim), matrix(rows.vec, dim)
    ids, query_ids = rows.id.to_numpy(), queries.id.to_numpy()
    width = max(1, CELLS // len(rows))
    for start in range(0, len(queries), width):
        part = slice(start, start + width)
        scores = _scores(a[part], b)
        mask_own(scores, query_ids[part], ids, OWN)
        yield part, query_ids[part], scores


def _histogram(rows: pd.DataFrame, queries: pd.DataFrame, width: int) -> pd.DataFrame:
    found = []
    for part, query_ids, scores in _passes(rows, queries):
        low, need = queries.low.to_numpy()[part, None], queries.need.to_numpy()[part]
        bins = (scores - low) // width
        inside = (scores != OWN) & (scores >= low) & (bins < BINS)
        q, _ = np.nonzero(inside)
        counts = np.bincount(q * BINS + bins[inside], minlength=len(query_ids) * BINS).reshape(-1, BINS)
        above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
        q, at = np.nonzero((counts > 0) & (above < need[:, None]))
        found.append(pd.DataFrame({"id": query_ids[q], "bin": at, "n": counts[q, at]}))
    return pd.concat(found) if found else pd.DataFrame({"id": [], "bin": [], "n": []}).astype("int64")


def _winners(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
    found = []
    ids = rows.id.to_numpy()
    for part, query_ids, scores in _passes(rows, queries):
        low, need = queries.low.to_numpy()[part], queries.need.to_numpy()[part]
        for i in range(len(query_ids)):
            s = scores[i]
            better = np.flatnonzero((s > low[i]) & (s != OWN))
            equal = np.flatnonzero(s == low[i])
            equal = equal[np.argsort(ids[equal], kind="stable")[: need[i]]]
            keep = np.concatenate([better, equal])
            found.append(pd.DataFrame({"query_id": query_ids[i], "vec_id": ids[keep], "score": s[keep]}))
    if not found:
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
    return pd.concat(found)


def search(df: DataFrame, id_col: str, vec_col: str, is_query: Column, k: int, scale: float = 256.0) -> DataFrame:
    """The ``k`` rows of largest integer inner product with each query row.

    Components count as floor(scale * x). ``is_query`` is a condition on the column ``id``. Returns
    query_id, rank (from 1), vec_id, score; equal scores go to the smaller id. Rows with the query's
    own id are no candidates, so a repeated id never finds its copies; a repeated query id asks once,
    with its smallest vector, and a repeated candidate may take several ranks. A query with fewer than ``k`` candidates gets them all. Shorter vectors are filled
    up with zeros. Scores must fit a long. Rows are written to the scratch folder once, quantised.
    """
    vectors = materialize(quantised(df, id_col, vec_col, scale), "vectors")
    norm = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    n, top = vectors.agg(F.count(F.lit(1)), F.max(norm)).first()
    span = int(top or 0) + 1  # no score is outside [-span, span]
    queries = vectors.filter(is_query).groupBy("id").agg(F.min("vec").alias("vec"))
    n_queries = queries.count()
    width = 1
    while width * BINS < 2 * span + 1:
        width *= BINS
    state = queries.select("id", F.lit(-span).cast("long").alias("low"), F.lit(k).cast("long").alias("need"))
    while True:
        asked = queries.join(state, "id")
        counted = tiles(vectors, asked, n, n_queries, partial(_histogram, width=width), "id long, bin long, n long")
        bins = counted.groupBy("id", "bin").agg(F.sum("n").alias("n"))
        down = W.partitionBy("id").orderBy(F.desc("bin"))
        bins = bins.withColumn("upto", F.sum("n").over(down)).join(state, "id")
        # The highest bin by which enough rows are counted; none if there are fewer rows.
        reached = bins.filter(F.col("upto") >= F.col("need")).groupBy("id").agg(
            F.max_by(F.struct("bin", (F.col("upto") - F.col("n")).alias("above")), "bin").alias("at")
        )
        state = state.join(reached, "id", "left").select(
            "id",
            F.when(F.col("at").isNull(), F.col("low")).otherwise(F.col("low") + F.col("at.bin") * width).alias("low"),
            F.when(F.col("at").isNull(), F.col("need")).otherwise(F.col("need") - F.col("at.above")).alias("need"),
        )
        state = materialize(state, "bounds")
        if width == 1:
            break
        width //= BINS
    winners = tiles(vectors, queries.join(state, "id"), n, n_queries, _winners, "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = winners.withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

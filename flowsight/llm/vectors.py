"""Vector tables: valid rows, and tiles of stated queries against all rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of either side in one tile, on average.
TILE_VECTORS = 2048
TILE_QUERIES = 2048


def valid_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Columns ``id`` and ``vec`` (doubles) of the rows that can be compared.

    Rows without an id, without a vector, or whose vector holds a null or a non-finite component
    take no part. An empty vector is kept: all its products are 0.
    """
    vec = F.col("vec")
    whole = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    df = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    return df.filter(F.col("id").isNotNull() & vec.isNotNull() & whole)


def matrix(vectors, dim: int) -> np.ndarray:
    """Rows as one matrix; shorter vectors are filled up with zeros."""
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def renamed(df: DataFrame) -> DataFrame:
    """The same columns as new ones, so that both sides of a cogroup may stem from one table."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def blocked(df: DataFrame, key: Column, own: str, parts: int, other: str, others: int) -> DataFrame:
    """Deals rows to ``parts`` blocks by the hash of ``key`` and copies each to all ``others`` blocks."""
    return df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")).withColumn(
        other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
    )


def tiles(
    vectors: DataFrame,
    queries: DataFrame,
    n_vectors: int,
    n_queries: int,
    score: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: str,
) -> DataFrame:
    """Runs ``score`` on every block of queries with every block of vectors.

    Blocks hold a bounded number of rows whatever the table holds, so no task sees a whole side.
    """
    n_vb, n_qb = max(1, -(-n_vectors // TILE_VECTORS)), max(1, -(-n_queries // TILE_QUERIES))
    left = blocked(vectors, F.col("id"), "vb", n_vb, "qb", n_qb)
    right = blocked(renamed(queries), F.col("id"), "qb", n_qb, "vb", n_vb)
    return left.groupBy("vb", "qb").cogroup(right.groupBy("vb", "qb")).applyInPandas(score, schema)


def mask_own(scores: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, value: float) -> None:
    """Overwrites the scores of rows that carry the query's own id."""
    order = np.argsort(ids, kind="stable")
    low = np.searchsorted(ids, query_ids, "left", sorter=order)
    high = np.searchsorted(ids, query_ids, "right", sorter=order)
    for q in np.flatnonzero(high > low):
        scores[q, order[low[q] : high[q]]] = value

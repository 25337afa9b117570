"""Approximate nearest neighbours by an adaptive dimension scan over probed lists.

Largest inner product is made a nearest-distance search by one more component that gives all vectors
the same length. Centres are fitted on a bounded sample, every vector is filed under its nearest
centre, and a query probes the lists of its nearest centres. Vectors are rotated at random, so the
first components of a difference are a fair sample of all of them. A scan goes over column blocks:
after each, the distance so far, scaled to all dimensions, is tested against the query's bound (its
k-th distance in its nearest list), and a candidate that is larger beyond the test's margin is
abandoned. Survivors are scored exactly on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowsight.llm.vectors import matrix, renamed, valid_vectors
from flowsight.session import materialize

COLUMN_BLOCK = 16
#: Pairs that a tile works on at a time.
CELLS = 1_000_000
LIST_ROWS = 2048
LIST_QUERIES = 1024


@dataclass
class Index:
    """What the bounded sample gives: a rotation, the centres and how many lists a query probes."""

    rotation: np.ndarray
    centres: np.ndarray
    length: float
    probes: int

    def lift(self, vectors: np.ndarray) -> np.ndarray:
        """Rotated vectors of equal length."""
        rest = np.sqrt(np.maximum(self.length**2 - (vectors**2).sum(1), 0))
        return np.hstack([vectors, rest[:, None]]) @ self.rotation

    def lift_queries(self, queries: np.ndarray) -> np.ndarray:
        """Queries of length one: their order of candidates depends on their direction only."""
        size = np.linalg.norm(queries, axis=1, keepdims=True)
        return np.hstack([queries / np.where(size > 0, size, 1), np.zeros((len(queries), 1))]) @ self.rotation

    def order(self, lifted: np.ndarray) -> np.ndarray:
        """Centres, nearest first."""
        distance = (self.centres**2).sum(1) - 2 * lifted @ self.centres.T
        return np.argsort(distance, axis=1, kind="stable")


def fit(sample: np.ndarray, length: float, k: int, n_lists: int, recall: float, seed: int) -> Index:
    """k-means centres of the sample, and the probes that reach ``recall`` on it."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1] + 1
    rotation, _ = np.linalg.qr(rng.normal(size=(dim, dim)))
    index = Index(rotation, np.zeros((1, dim)), length, 1)
    lifted = index.lift(sample)
    centres = lifted[rng.choice(len(lifted), n_lists, replace=False)]
    for _ in range(8):
        near = np.argmin((centres**2).sum(1) - 2 * lifted @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, lifted)
        counts = np.bincount(near, minlength=n_lists)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    index.centres = centres
    near = np.argmin((centres**2).sum(1) - 2 * lifted @ centres.T, axis=1)
    asked = rng.choice(len(sample), min(len(sample), 300), replace=False)
    scores = sample[asked] @ sample.T
    scores[np.arange(len(asked)), asked] = -np.inf
    best = np.argsort(-scores, axis=1, kind="stable")[:, : min(k, max(1, len(sample) - 1))]
    place = np.empty((len(asked), n_lists), dtype=np.int64)
    np.put_along_axis(place, index.order(index.lift_queries(sample[asked])), np.arange(n_lists)[None, :], axis=1)
    needed = np.sort(np.take_along_axis(place, near[best], axis=1).ravel())
    index.probes = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1
    return index


def _file(batches: Iterator[pd.DataFrame], index: Index, dim: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            batch["list"] = index.order(index.lift(matrix(batch.vec, dim)))[:, 0].astype("int32")
            yield batch


def _probe(batches: Iterator[pd.DataFrame], index: Index, dim: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            batch["lists"] = list(index.order(index.lift_queries(matrix(batch.vec, dim)))[:, : index.probes].astype("int32"))
            yield batch


def scan(lifted: np.ndarray, lifted_queries: np.ndarray, bounds: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) that no test has abandoned, by column blocks."""
    dim = lifted.shape[1]
    q = row = partial_sum = None
    for start in range(0, dim, COLUMN_BLOCK):
        stop = min(start + COLUMN_BLOCK, dim)
        a, b = lifted_queries[:, start:stop], lifted[:, start:stop]
        if q is None:
            grid = (a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * a @ b.T
            limit = bounds[:, None]
        elif len(q) * 4 > len(lifted) * len(lifted_queries):  # dense: one product for the whole tile
            partial_sum = partial_sum + ((a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * a @ b.T)[q, row]
        else:
            partial_sum = partial_sum + ((a[q] - b[row]) ** 2).sum(1)
        factor = dim / stop * (1 + margin / np.sqrt(stop)) ** -2 if stop < dim else 1 - 1e-9
        if q is None:
            q, row = np.nonzero(grid * factor <= limit)
            partial_sum = grid[q, row]
        else:
            alive = partial_sum * factor <= bounds[q]
            q, row, partial_sum = q[alive], row[alive], partial_sum[alive]
    return q, row


EMPTY = pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "bound": []}).astype(
    {"query_id": "int64", "vec_id": "int64", "score": "float64", "bound": "float64"}
)


def _search(rows: pd.DataFrame, queries: pd.DataFrame, index: Index, dim: int, k: int, margin: float) -> pd.DataFrame:
    """The best ``k`` survivors of a tile for each query, and its bound so far."""
    if not len(rows) or not len(queries):
        return EMPTY
    vectors, asked = matrix(rows.vec, dim), matrix(queries.vec, dim)
    ids, query_ids, bounds = rows.id.to_numpy(), queries.id.to_numpy(), queries.bound.to_numpy()
    lifted, lifted_queries = index.lift(vectors), index.lift_queries(asked)
    found = []
    width = max(1, CELLS // len(rows))
    for start in range(0, len(queries), width):
        part = slice(start, start + width)
        q, row = scan(lifted, lifted_queries[part], bounds[part], margin)
        keep = ids[row] != query_ids[part][q]
        q, row = q[keep], row[keep]
        score = np.einsum("ij,ij->i", asked[part][q], vectors[row])
        order = np.lexsort((ids[row], -score, q))
        q, row, score = q[order], row[order], score[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        best = place < k
        found.append(pd.DataFrame({"query_id": query_ids[part][q[best]], "vec_id": ids[row[best]], "score": score[best]}))
    out = pd.concat(found)
    size = dict(zip(query_ids, np.linalg.norm(asked, axis=1), strict=True))
    # the squared distance of lifted vectors that belongs to an inner product
    out["bound"] = 1 + index.length**2 - 2 * out.score / out.query_id.map(size).astype("float64")
    return out[["query_id", "vec_id", "score", "bound"]]


def _tiles(filed: DataFrame, asked: DataFrame, sizes: DataFrame, index: Index, dim: int, k: int, margin: float) -> DataFrame:
    """Scans the lists that ``asked`` names, in tiles of bounded rows and queries.

    ``sizes`` has a row per list: how many blocks its vectors and its queries are dealt to.
    """
    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        return (
            df.join(F.broadcast(sizes), "list")  # a row per centre: bounded by n_lists
            .withColumn(own, F.pmod(F.xxhash64("id"), F.col(f"n_{own}")))
            .withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"n_{other}") - 1)))
            .drop("n_vb", "n_qb")
        )

    keys = ["list", "vb", "qb"]
    rows, queries = dealt(filed, "vb", "qb").groupBy(*keys), dealt(renamed(asked), "qb", "vb").groupBy(*keys)
    run = partial(_search, index=index, dim=dim, k=k, margin=margin)
    return rows.cogroup(queries).applyInPandas(
        run, "query_id long, vec_id long, score double, bound double"
    )


def search(
    df: DataFrame,
    id_col: str,
    vec_col: str,
    is_query: Column,
    k: int = 20,
    recall: float = 0.96,
    margin: float = 2.1,
    sample_rows: int = 12_000,
    max_lists: int = 1024,
    seed: int = 7,
) -> DataFrame:
    """About the ``k`` rows of largest inner product with each query row.

    The index is fitted on at most ``sample_rows`` rows (smallest hash of the id), with the square
    root of the table's rows as lists, ``max_lists`` at most; every row is filed. ``recall`` is what
    the probed lists hold of the true neighbours on the sample, ``margin`` the width of the tests.
    ``is_query`` is a condition on the column ``id``. Returns query_id, rank, vec_id, score (exact
    product of the original vectors in doubles); ties go to the smaller id. Vectors that are null,
    zero or hold null or non-finite components take no part; rows with the query's own id are no
    candidates, a repeated query id asks once with its smallest vector, shorter vectors are filled up
    with zeros. Queries whose lists hold fewer than ``k`` rows are asked again over all lists.
    """
    norm = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    vectors = materialize(valid_vectors(df, id_col, vec_col).filter(norm > 0), "ann-vectors")
    schema = "query_id long, rank int, vec_id long, score double"
    n, longest, dim = vectors.agg(F.count(F.lit(1)), F.max(norm), F.max(F.size("vec"))).first()
    if not n:
        return df.sparkSession.createDataFrame([], schema)
    sample = vectors.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample_rows).toPandas()
    n_lists = max(1, min(max_lists, int(n**0.5), len(sample)))
    index = fit(matrix(sample.vec, dim), float(longest) ** 0.5, k, n_lists, recall, seed)

    filed = vectors.mapInPandas(partial(_file, index=index, dim=dim), "id long, vec array<double>, list int")
    filed = materialize(filed, "ann-filed")
    queries = vectors.filter(is_query).groupBy("id").agg(F.min("vec").alias("vec"))
    probed = queries.mapInPandas(partial(_probe, index=index, dim=dim), "id long, vec array<double>, lists array<int>")
    probed = materialize(probed, "ann-probed")

    def blocks(asked: DataFrame) -> DataFrame:
        rows = filed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / LIST_ROWS).alias("n_vb"))
        needs = asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / LIST_QUERIES).alias("n_qb"))
        return rows.join(needs, "list")

    def nearest(found: DataFrame) -> DataFrame:
        order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    infinite = F.lit(float("inf"))
    home = probed.select("id", "vec", F.col("lists")[0].alias("list"), infinite.alias("bound"))
    first = nearest(_tiles(filed, home, blocks(home), index, dim, k, margin))
    first = materialize(first, "ann-first")
    # Only k rows give a bound; a query with fewer goes on without one.
    bounds = first.groupBy(F.col("query_id").alias("id")).agg(
        F.when(F.count(F.lit(1)) >= k, F.max("bound")).alias("bound")
    )
    rest = probed.join(bounds, "id", "left").select(
        "id", "vec", F.explode(F.slice("lists", 2, n_lists)).alias("list"), F.coalesce("bound", infinite).alias("bound")
    )
    more = _tiles(filed, rest, blocks(rest), index, dim, k, margin)
    found = materialize(nearest(first.drop("rank").unionByName(more)), "ann-found")
    if index.probes < n_lists:
        full = found.groupBy(F.col("query_id").alias("id")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
        short = probed.join(full, "id", "left_anti").select("id", "vec")
        every = F.explode(F.sequence(F.lit(0), F.lit(n_lists - 1))).alias("list")
        again = short.select("id", "vec", every, infinite.alias("bound"))
        anew = _tiles(filed, again, blocks(again), index, dim, k, margin)
        found = nearest(found.join(short, found.query_id == short.id, "left_anti").drop("rank").unionByName(anew))
    return found.select("query_id", "rank", "vec_id", "score")

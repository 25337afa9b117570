"""Exact top-k and approximate neighbours against all scores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsight.llm import ann, exact_topk, vectors
from flowsight.llm.queries import QUERIES, SQL

SCHEMA = "vec_id long, embedding array<float>, rank int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(4)


def valid(rows):
    return [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]


def brute_topk(rows, every, k):
    rows = [(i, np.floor(256 * v)) for i, v in valid(rows)]
    out = []
    for q, a in rows:
        if q % every == 0:
            found = sorted((-int(a[: len(b)] @ b[: len(a)]), i) for i, b in rows if i != q)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(found, 1)]
    return sorted(out)


def corpus(seed, n, dim=6, scale=1.0):
    rng = np.random.default_rng(seed)
    same = (rng.normal(size=dim) * scale).tolist()
    rows = [(i, same if i % 3 == 0 else (rng.normal(size=dim) * scale).tolist()) for i in range(n)]
    nothing = [(1000, None), (1001, [None] * dim), (1002, [float("nan")] * dim), (1003, [float("inf")] * dim), (None, same)]
    return rows + nothing


@pytest.mark.parametrize(("n", "k", "tile", "scale"), [(60, 5, 2048, 1.0), (90, 5, 16, 1.0), (4, 5, 2048, 1.0), (50, 3, 7, 3e4)])
def test_exact_topk(spark, monkeypatch, n, k, tile, scale):
    monkeypatch.setattr(vectors, "TILE_VECTORS", tile)
    monkeypatch.setattr(vectors, "TILE_QUERIES", max(2, tile // 4))
    rows = corpus(n, n, scale=scale)
    out = exact_topk.search(table(spark, rows), "vec_id", "embedding", F.col("id") % 2 == 0, k=k)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(tuple(r) for r in out.collect()) == brute_topk(rows, 2, k)


def test_exact_topk_edges(spark):
    assert exact_topk.search(table(spark, []).limit(0), "vec_id", "embedding", F.col("id") % 2 == 0, 5).count() == 0
    rows = [(0, []), (1, [0.5]), (2, [0.5, 0.25]), (4, [1.0])]
    found = exact_topk.search(table(spark, rows), "vec_id", "embedding", F.col("id") == 0, 5)
    assert sorted((r.vec_id, r.score) for r in found.collect()) == [(1, 0), (2, 0), (4, 0)]
    repeated = [(0, [1.0]), (0, [1.0]), (1, [0.5]), (1, [0.5])]
    found = exact_topk.search(table(spark, repeated), "vec_id", "embedding", F.col("id") == 0, 5)
    assert sorted((r["rank"], r.vec_id) for r in found.collect()) == [(1, 1), (2, 1)]


def test_exact_topk_query_equals_sql(spark, duck, sf_dir, as_set):
    df = QUERIES["op5_exact_topk"](spark, sf_dir)
    wanted = duck.sql(SQL["op5_exact_topk"])
    assert as_set(df.columns, df.collect()) == as_set(wanted.columns, wanted.fetchall())


def recall(found, matrix, ids, queries, k):
    at = {i: n for n, i in enumerate(ids)}
    hits = total = 0
    for q in queries:
        scores = matrix @ matrix[at[q]]
        scores[at[q]] = -np.inf
        best = {ids[i] for i in np.lexsort((ids, -scores))[: min(k, len(ids) - 1)]}
        hits += len(best & {v for v, _ in found.get(q, [])})
        total += len(best)
    return hits / total


def collected(out):
    found = {}
    for r in out.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return found


def test_recall_of_the_query(spark):
    folder = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    ids = np.array([r.vec_id for r in rows])
    matrix = np.array([r.embedding for r in rows], dtype=float)
    found = collected(QUERIES["op6_adaptive_scan"](spark, folder))
    queries = [i for i in ids.tolist() if i % 20 == 0]
    assert set(found) == set(queries)
    assert recall(found, matrix, ids, queries, 20) >= 0.9
    at = {i: n for n, i in enumerate(ids.tolist())}
    for q, own in found.items():
        assert len(own) == 20
        assert own == sorted(own, key=lambda x: (-x[1], x[0]))
        assert all(s == pytest.approx(matrix[at[q]] @ matrix[at[v]], abs=1e-12) for v, s in own)


def test_neighbours_of_any_length_and_a_hot_vector(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST_ROWS", 16)
    monkeypatch.setattr(ann, "LIST_QUERIES", 4)
    rows = corpus(5, 300, dim=20, scale=3.0)
    out = ann.search(table(spark, [*rows, (2000, [0.0] * 20)]), "vec_id", "embedding", F.col("id") % 10 == 0, k=5)
    found = collected(out)
    kept = valid(rows)
    ids, matrix = np.array([i for i, _ in kept]), np.array([v for _, v in kept])
    queries = [i for i in ids.tolist() if i % 10 == 0]
    assert set(found) == set(queries)
    scores = {q: np.sort(np.delete(matrix @ matrix[list(ids).index(q)], list(ids).index(q)))[::-1][:5] for q in queries}
    close = [np.isclose([s for _, s in found[q]], scores[q]).mean() for q in queries]
    assert np.mean(close) >= 0.9


def test_neighbours_edges(spark):
    search = lambda rows: ann.search(table(spark, rows), "vec_id", "embedding", F.col("id") % 2 == 0, k=5)
    assert search([(1, None), (2, [0.0])]).count() == 0
    assert collected(search([(0, [1.0, 0.0]), (1, [0.5]), (2, [2.0, 1.0]), (2, [2.0, 1.0])])) == {0: [(2, 2.0), (2, 2.0), (1, 0.5)], 2: [(0, 2.0), (1, 1.0)]}
    assert search([(0, [1.0])]).count() == 0


def test_tests_abandon_only_far_rows():
    rng = np.random.default_rng(3)
    rows, queries = rng.normal(size=(500, 64)), rng.normal(size=(20, 64))
    distance = ((queries[:, None] - rows) ** 2).sum(-1)
    bounds = np.sort(distance, axis=1)[:, 9]
    kept = set(zip(*map(list, ann.scan(rows, queries, bounds, 2.1)), strict=True))
    near = list(zip(*np.nonzero(distance <= bounds[:, None]), strict=True))
    assert np.mean([p in kept for p in near]) > 0.97
    assert len(kept) <= len(near) + 1

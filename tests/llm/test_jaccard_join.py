"""Near-duplicate groups against all pairs."""

import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from flowsight.llm import jaccard_join
from flowsight.llm.components import components
from flowsight.llm.queries import QUERIES


def sets_of(text, n=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def groups(sets, percent=80):
    """Union-find over all pairs that share a shingle."""
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    seen = set()
    for members in where.values():
        for i in members:
            for j in members:
                if i < j and (i, j) not in seen:
                    seen.add((i, j))
                    both = len(sets[i] & sets[j])
                    if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                        a, b = sorted((root(i), root(j)))
                        parent[b] = a
    return [root(i) for i in range(len(sets))]


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"W{i}é" for i in range(300)]
    line = [rng.choice(vocabulary) for _ in range(30)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 9, 30, 120]))] for _ in range(12)]
    texts = []
    for _ in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            at = rng.randrange(len(words) + 1)
            words[at : at + rng.randint(0, 2)] = [rng.choice(vocabulary) for _ in range(rng.randint(0, 2))]
        if rng.random() < 0.4:
            words += line
        texts.append((rng.choice([" ", "\n"])).join(words) if rng.random() < 0.95 else "")
    return texts


@pytest.mark.parametrize(("seed", "tile_rows"), [(0, 1000), (1, 1000), (2, 8), (3, 8)])
def test_against_all_pairs(spark, monkeypatch, seed, tile_rows):
    monkeypatch.setattr(jaccard_join, "TILE_ROWS", tile_rows)
    texts = corpus(seed, 150)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(df).collect()}
    sets = [sets_of(t) for t in texts]
    assert out == {i: (len(s), g) for i, (s, g) in enumerate(zip(sets, groups(sets), strict=True))}


def test_pairs_joined_by_shuffles(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SENT_PAIRS", 0)
    texts = corpus(7, 60)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    out = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(df).collect()}
    assert out == dict(enumerate(groups([sets_of(t) for t in texts])))


def test_edge_tables(spark):
    text = "one two three four five six seven"
    rows = [(5, text), (5, text), (None, text.upper()), (2, None), (1, ""), (3, " \t"), (4, "one two"), (6, "One  two")]
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, component_id int")
    out = sorted([tuple(r) for r in jaccard_join.near_duplicates(df).collect()], key=repr)
    wanted = [(5, 3, 5), (5, 3, 5), (None, 3, 5), (2, 0, 2), (1, 0, 1), (3, 0, 3), (4, 1, 4), (6, 1, 4)]
    assert out == sorted(wanted, key=repr)
    assert jaccard_join.near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    n = 200
    order = list(range(n))
    random.Random(1).shuffle(order)
    links = spark.createDataFrame(list(zip(order, order[1:], strict=False)), "a long, b long")
    assert {tuple(r) for r in components(links).collect()} == {(i, 0) for i in range(n)}
    assert components(links.limit(0)).count() == 0


def test_bitmaps_never_exclude_similar_sets():
    rng = np.random.default_rng(0)
    for _ in range(300):
        base = rng.integers(0, 2**63, rng.integers(1, 300), dtype=np.uint64)
        other = np.unique(np.concatenate([base[rng.random(len(base)) < 0.95], rng.integers(0, 2**63, rng.integers(0, 9), dtype=np.uint64)]))
        base = np.unique(base)
        if not len(other):
            continue
        both = len(np.intersect1d(base, other))
        differ = jaccard_join.differing([jaccard_join.bitmap(base)], [jaccard_join.bitmap(other)])[0]
        assert differ <= len(base) + len(other) - 2 * both
        if 100 * both >= 80 * (len(base) + len(other) - both):
            assert jaccard_join.within(len(base), len(other), differ, 80)


def test_query(spark, sf_dir):
    rows = sorted(duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall())
    sets = [sets_of(t) for _, t in rows]
    wanted = {(rows[i][0], len(s), rows[g][0]) for i, (s, g) in enumerate(zip(sets, groups(sets), strict=True))}
    assert {tuple(r) for r in QUERIES["op10_jaccard_join"](spark, sf_dir).collect()} == wanted

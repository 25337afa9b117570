"""Repeated windows against a plain count of all windows."""

import hashlib
import random
from collections import Counter

import duckdb
import pytest

from flowsight.llm import substring_dedup
from flowsight.llm.queries import QUERIES


def brute(rows, length):
    words = [(t or "").encode().split() for _, t in rows]
    counts = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for (key, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - length + 1):
            if counts[tuple(w[i : i + length])] > 1:
                gone.update(range(i, i + length))
        out.append((key, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=repr)


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(rng.choice([3, 50, 2000]))]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(5, 60))] for _ in range(8)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 6)):
            p = rng.choice(passages)
            words += p[rng.randint(0, 3) : len(p) - rng.randint(0, 3)] if rng.random() < 0.6 else [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(words)))
    return rows


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("length", [9, 12, 35])
def test_against_all_windows(spark, seed, length):
    rows = corpus(seed, 40)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = substring_dedup.remove_repeats(df, length=length)
    found = sorted([(r.doc_id, r.n_words, r.n_removed, r.kept) for r in out.collect()], key=repr)
    assert found == brute(rows, length)


def test_edge_tables(spark):
    long = " ".join(f"x{i}" for i in range(50))
    rows = [(1, None), (1, ""), (None, long), (2, long), (2, long), (3, "a " * 80), (4, "one two")]
    df = spark.createDataFrame([(k, t, "clash") for k, t in rows], "doc_id long, text string, kept string")
    out = substring_dedup.remove_repeats(df, length=35)
    assert out.columns == ["doc_id", "text", "n_words", "n_removed", "kept", "repeated"]
    found = sorted([(r.doc_id, r.n_words, r.n_removed, r.kept) for r in out.collect()], key=repr)
    assert found == brute(rows, 35)
    assert substring_dedup.remove_repeats(df.limit(0)).count() == 0


def test_texts_are_shuffled_once(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = substring_dedup.remove_repeats(df)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan


def test_query(spark, sf_dir):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall()
    wanted = {(k, n, m, hashlib.sha256(kept.encode()).hexdigest()) for k, n, m, kept in brute(rows, 35)}
    assert {tuple(r) for r in QUERIES["op2_substring_dedup"](spark, sf_dir).collect()} == wanted

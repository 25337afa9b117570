"""Collocations against a plain count of all phrases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from flowsight.llm import collocations

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, limit, least, cover):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in (1, 2, 3):
                for i in range(len(words) - size + 1):
                    f[lang][tuple(words[i : i + size])] += 1
    out = []
    for lang, counts in f.items():
        phrases = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in phrases.items():
            score, _, l, r = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            longer = [b for q, b in phrases.items() if len(q) > len(p) and p in (q[:2], q[1:])]
            if not any(100 * b >= cover * a for b in longer):
                kept.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(kept)[:limit], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"W{i}é" if i % 3 else f"w{i}" for i in range(rng.choice([4, 30, 120]))]
    idioms = [[rng.choice(vocabulary) for _ in range(rng.randint(2, 4))] for _ in range(12)]
    rows = []
    for _ in range(150):
        words = []
        for _ in range(rng.randint(0, 30)):
            words += rng.choice(idioms) if rng.random() < 0.5 else [rng.choice(vocabulary)]
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", ". ", "\n", ";"]) for w in words)
        rows.append((rng.choice(["en", "en", "en", "de", None]), text))
    return rows + [(None, None), ("fr", ""), ("it", "a b " * 40), ("en", None)]


@pytest.mark.parametrize("seed, limit, least, cover", [(1, 2000, 3, 50), (2, 2, 2, 50), (3, 5, 4, 80), (4, 1, 2, 10)])
def test_equals_plain_counts(spark, seed, limit, least, cover):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    found = collocations.mine(df, limit, least, cover)
    assert found.columns == COLUMNS
    assert sorted(map(tuple, found.collect())) == brute(rows, limit, least, cover)


def test_rounds_lower_the_cut(spark, monkeypatch):
    monkeypatch.setattr(collocations, "FIRST", 1)
    monkeypatch.setattr(collocations, "GROWTH", 2)
    rounds = []
    counted = collocations.counted
    monkeypatch.setattr(collocations, "counted", lambda t, s, k, n: rounds.append(len(k)) or counted(t, s, k, n))
    rows = corpus(6)
    df = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, collocations.mine(df, 30, 3, 20).collect())) == brute(rows, 30, 3, 20)
    assert rounds.count(3) > 1  # key columns: three for every round of triples


def test_awkward_tables(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert collocations.mine(empty).collect() == []
    rows = [(1, "x", None, 7, 8), (2, None, "en", 7, 8)]
    df = spark.createDataFrame(rows, "score long, text string, lang string, h1 long, cut long")
    assert collocations.mine(df).collect() == []
    long = [("en", "same words here " * 60_000), ("en", "z" * 100_000)]
    found = collocations.mine(spark.createDataFrame(long, "lang string, text string")).collect()
    assert [(r.phrase, r.a) for r in found] == [("same words here", 60_000), ("here same words", 59_999), ("words here same", 59_999)]


def test_huge_counts_divide_exactly(spark):
    a, l, r = 3_000_000_007, 3_000_000_019, 3_000_000_037
    df = spark.createDataFrame([(a, l, r)], "a long, l long, r long")
    assert df.select(collocations.share(df.a, [df.l, df.r])).first()[0] == 10**6 * a * a // (l * r)


def test_added_rows():
    columns, counts = collocations._added([np.array([2, 1, 2, 2]), np.array([1, 1, 1, 0])], np.array([1, 2, 3, 4]))
    assert sorted(zip(*columns, counts, strict=True)) == [(1, 1, 2), (2, 0, 4), (2, 1, 4)]

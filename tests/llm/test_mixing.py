"""Mixtures against a plain version of the same plan."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from flowsight.llm import mixing


def corpus(spark):
    rows, n = [], 0
    for source, documents in (("big", 300), ("mid", 60), ("small", 12), (None, 30), ("empty", 3)):
        for i in range(documents):
            text = None if source == "empty" and i else "" if source == "empty" else " ".join(["w\n" * (1 + i % 7)] * (1 + i % 5))
            rows.append((n, text, source, i))
            n += 1
    return spark.createDataFrame(rows, "doc_id long, text string, source string, mix_epoch int").repartition(5)


def entropy(weights):
    return -sum(w * math.log(w) for w in weights if w)


def exponent_for(shares, good):
    low, high = 0.0, 1.0
    if good(shares, 0.0):
        return 0.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if good(shares, mid) else (mid, high)
    return high


def weights_at(shares, a):
    z = sum(p**a for p in shares.values())
    return {s: p**a / z for s, p in shares.items()}


@pytest.mark.parametrize(
    ("evenness", "max_epochs", "factor", "block"),
    [(0.5, 4.0, 1.0, 4096), (1.0, None, 2.5, 7), (None, 1.5, 1.0, 7), (0.9, 1.2, 0.7, 20), (0.0, None, 1.0, 4096)],
)
def test_against_a_plain_version(spark, monkeypatch, evenness, max_epochs, factor, block):
    monkeypatch.setattr(mixing, "BLOCK_DOCUMENTS", block)
    df = corpus(spark)
    rows = df.select("doc_id", "source", "text", mixing._mark("doc_id", "text").alias("mark")).collect()
    tokens = {r.doc_id: len((r.text or "").split()) for r in rows}
    by_source = defaultdict(list)
    for r in rows:
        by_source[r.source].append(r)
    total = Counter()
    for s, own in by_source.items():
        total[s] = sum(tokens[r.doc_id] for r in own)
    whole = sum(total.values())
    shares = {s: t / whole for s, t in total.items() if t}
    budget = whole * factor

    exponent = 1.0
    if evenness is not None:
        plain = entropy(shares.values())
        target = plain + evenness * (math.log(len(shares)) - plain)
        exponent = exponent_for(shares, lambda p, a: entropy(weights_at(p, a).values()) <= target + 1e-12)
    if max_epochs is not None:
        limit = exponent_for(shares, lambda p, a: max(weights_at(p, a)[s] * budget / total[s] for s in p) <= max_epochs * (1 + 1e-12))
        exponent = max(exponent if evenness is not None else 0.0, limit)
    mixed, figures = mixing.mix(df, evenness=evenness, max_epochs=max_epochs, budget=budget)
    assert figures.exponent == pytest.approx(exponent, abs=1e-6)
    out = mixed.collect()
    assert sorted(mixed.columns) == sorted([*df.columns, "mix_order"])
    taken = Counter((r.doc_id, r.mix_epoch) for r in out)
    assert set(taken.values()) == {1}
    assert all(0 <= r.mix_order <= 1 + 1e-9 for r in out)
    places = {}
    top = max(r.mix_epoch for r in out) + 1
    marks = spark.createDataFrame([(r.doc_id, r.mark) for r in rows], "doc_id long, mark long")
    for e in range(top + 1):
        for r in marks.select("doc_id", mixing._place("mark", F.lit(e), 17).alias("p")).collect():
            places[r.doc_id, e] = r.p
    for s, w in weights_at(shares, figures.exponent).items():
        asked = w * budget
        epochs = math.floor(asked / total[s] + 1e-9)
        left = asked - epochs * total[s]
        wanted = {(r.doc_id, e) for r in by_source[s] for e in range(epochs)}
        if left > 0.5:
            seen = 0
            for r in sorted(by_source[s], key=lambda r: places[r.doc_id, epochs]):
                if seen >= left:
                    break
                wanted.add((r.doc_id, epochs))
                seen += tokens[r.doc_id]
        assert {k for k in taken if k[0] in {r.doc_id for r in by_source[s]}} == wanted
    assert {k for k in taken if k[0] in {r.doc_id for r in by_source["empty"]}} == {(r.doc_id, 0) for r in by_source["empty"]}


def test_many_sources_are_joined_alike(spark, monkeypatch):
    wanted = sorted(tuple(r) for r in mixing.mix(corpus(spark))[0].select("doc_id", "mix_epoch").collect())
    monkeypatch.setattr(mixing, "SENT_SOURCES", 1)
    assert sorted(tuple(r) for r in mixing.mix(corpus(spark))[0].select("doc_id", "mix_epoch").collect()) == wanted


def test_edge_tables(spark):
    df = spark.createDataFrame([(1, None, None), (1, "a b", "x"), (1, "a b", "x"), (None, "é  c", "y")], "doc_id long, text string, source string")
    assert mixing.mix(df, evenness=0.0)[0].count() == 4
    assert mixing.mix(df.limit(0))[0].count() == 0
    assert mixing.mix(df.filter("text IS NULL"))[0].count() == 1


def test_word_counts(spark):
    texts = ["", None, " ", "a", " a\tb\x0bc ", "é\x1cx 🙂\r\n", "x " * 1000]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").coalesce(1)
    found = sorted(r.n_tokens for r in mixing.sized(df, "text", "source", "doc_id").collect())
    assert found == sorted(len((t or "").encode().split()) for t in texts)

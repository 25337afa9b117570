"""The chain against enumeration, and what it learns against held-out labels."""

import itertools
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from flowsight.llm import toxicity
from flowsight.llm.queries import QUERIES


def enumerated(emission, steps):
    k = len(emission)
    z, p, flows = 0.0, np.zeros(k), np.zeros(3)
    for states in itertools.product((0, 1), repeat=k):
        weight = sum(e for e, s in zip(emission, states, strict=True) if s) + (steps[0] if states[0] else 0)
        used = np.zeros(3)
        for pair in zip(states, states[1:], strict=False):
            at = {(0, 1): 0, (1, 0): 1, (1, 1): 2}.get(pair)
            if at is not None:
                weight += steps[at]
                used[at] += 1
        z += np.exp(weight)
        p += np.exp(weight) * np.array(states)
        flows += np.exp(weight) * used
    return p / z, flows / z


@pytest.mark.parametrize("seed", range(5))
def test_marginals_equal_enumeration(monkeypatch, seed):
    monkeypatch.setattr(toxicity, "BLOCK", 4)
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 9, 4)
    emission, steps = rng.normal(size=lengths.sum()) * 2, tuple(rng.normal(size=3))
    begin = np.cumsum(lengths) - lengths
    first = np.zeros(lengths.sum(), dtype=bool)
    first[begin] = True
    p, flows = toxicity.marginals(emission, first, steps)
    single = [enumerated(emission[b : b + n], steps) for b, n in zip(begin, lengths, strict=True)]
    assert np.allclose(p, np.concatenate([s[0] for s in single]), atol=1e-8)
    assert np.allclose(flows, sum(s[1] for s in single), atol=1e-8)


def toy(n=400):
    rng = np.random.default_rng(1)
    words = [f"word{i}" for i in range(200)]
    texts, labels = [], []
    for i in range(n):
        text = [str(w) for w in rng.choice(words, 30)]
        if i % 4 == 0:
            text[int(rng.integers(30))] = rng.choice(["grubbish", "slimeball", f"grotty{rng.choice(list('abcdefgh'))}"])
        texts.append(" ".join(text))
        labels.append(int(i % 4 == 0))
    return texts, labels


class Sent:
    def __init__(self, value):
        self.value = value


def test_spans_and_scores_of_unseen_texts():
    chain = toxicity.train(*toy())
    texts = ["Word1 GRUBBISH, word2", "word3 word4", "", "é🙂 grottyz word5", None, "word6 " * 20_000 + "slimeball"]
    (out,) = toxicity._score([pa.RecordBatch.from_pydict({"text": texts})], Sent(chain), "text")
    scores = out.column("toxicity").to_pylist()
    spans = [[(s["start"], s["end"]) for s in own] for own in out.column("toxic_spans").to_pylist()]
    assert [s >= 0.7 for s in scores] == [True, False, False, True, False, True]
    assert spans == [[(6, 14)], [], [], [(3, 10)], [], [(120_000, 120_009)]]
    assert scores[2] == scores[4]


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 0), (2, 0)], [(1, 1), (1, 0), (2, None), (None, 1), (9, 1)]])
def test_little_to_learn_from(spark, labels):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, None, "x"), (2, None, "x"), (None, "", "x")], "doc_id long, text string, toxicity string")
    chain = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    rows = toxicity.score(docs, chain).collect()
    assert len(rows) == 4
    assert all(0 <= r.toxicity <= 1 and r.toxic_spans == [] for r in rows)
    assert toxicity.score(docs.limit(0), chain).count() == 0


def test_query_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in QUERIES["op1_toxicity"](spark, folder).collect()}
    assert len(rows) == duckdb.sql(f"SELECT count(*) FROM '{folder}/documents.parquet'").fetchall()[0][0]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())
    assert all(r.predicted == (r.score >= 0.7) for r in rows.values())
    labels = duckdb.sql(f"SELECT doc_id, toxic FROM '{folder}/labels.parquet'").fetchall()
    held = [(rows[i].predicted, y) for i, y in labels if i in rows and rows[i].held_out]
    assert np.mean([p == y for p, y in held]) > 0.96
    assert np.mean([y for p, y in held if p]) > 0.9


def test_rejections_do_not_depend_on_the_caps(spark):
    """One text in twenty is toxic; 'wobble' is in half of them, but two thirds of its texts are clean."""
    rng = np.random.default_rng(3)
    words = [f"word{i}" for i in range(200)]
    texts, labels = [], []
    for i in range(2100):
        text = [str(w) for w in rng.choice(words, 20)]
        if i < 100:
            text[3] = "wobble" if i % 2 else "grubbish"
        elif i < 200:
            text[3] = "wobble"
        texts.append(" ".join(text))
        labels.append(int(i < 100))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    given = spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int")
    rejected, means = [], []
    for caps in ((10_000, 10_000), (200, 100)):
        rows = toxicity.score(docs, toxicity.fit(docs, given, rows_per_label=caps)).collect()
        rejected.append({r.doc_id for r in rows if r.toxicity >= 0.7})
        means.append(np.mean([r.toxicity for r in rows]))
    assert rejected[0] == rejected[1] == set(range(0, 100, 2))
    assert abs(means[1] - 0.048) < 0.02


def test_a_repeated_document_brings_one_text(spark, monkeypatch):
    rows = [(1, f"text {i:03}") for i in range(500)] + [(1, None), (2, None), (3, "bad")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    taken = []
    monkeypatch.setattr(toxicity, "train", lambda texts, labels, **_: taken.extend(zip(texts, labels, strict=True)))
    toxicity.fit(docs, spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "doc_id long, toxic int"))
    assert taken == [("text 000", 0), ("", 0), ("bad", 1)]

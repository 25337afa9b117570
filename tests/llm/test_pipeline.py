"""Every stage against a plain version of its decision, and the pipeline as a whole."""

import base64
import os

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from flowsight.llm import pii
from tests.llm.test_jaccard_join import groups, sets_of
from tests.llm.test_pii import base

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage reads and returns, written in between as a run does."""
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = os.path.join(tmp_path_factory.mktemp("stages"), name)
        stage(spark, docs, FOLDER).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((docs, after))
        docs = after
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_stay_until_the_last_stage(stages):
    for before, after in stages[:-1]:
        assert after.columns == before.columns
        assert after.dtypes == before.dtypes


def test_toxicity_rejects_labelled_documents_only(spark, stages):
    before, after = stages[0]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    gone = set(rows(before)) - set(rows(after))
    known = [i for i in gone if i in labels]
    assert sum(labels[i] for i in known) >= 0.9 * len(known)
    assert len([i for i in known if labels[i]]) >= 0.7 * sum(labels.values())


def test_one_document_of_each_group_stays(stages):
    before, after = stages[1]
    docs = [before_row for _, before_row in sorted(rows(before).items())]
    group = groups([sets_of(r.text) for r in docs])
    assert rows(after) == {docs[i].doc_id: docs[i] for i, g in enumerate(group) if i == g}


def test_personal_data_is_replaced(stages):
    before, after = (rows(df) for df in stages[2])
    assert set(before) == set(after)
    for i, r in before.items():
        spans = base(r.text)
        assert base(after[i].text) == []
        assert after[i].n_chars == (len(after[i].text) if after[i].text != r.text else r.n_chars)
        if not spans and not any(f"[{k.upper()}]" in after[i].text for k in pii.KINDS):
            assert after[i] == r


def test_mixing_keeps_rows_as_they_are(stages):
    before, after = stages[3]
    known = rows(before)
    assert all(known[r.doc_id] == r for r in after.collect())
    words = F.sum(F.size(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")))
    old, new = (df.agg(words).first()[0] for df in (before, after))
    assert abs(old - new) < 0.1 * old


def test_ids_are_those_of_the_library(stages):
    before, after = stages[4]
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = rows(before)
    found = after.collect()
    assert len(found) == before.count()
    for r in found:
        assert r.exact
        assert r.n_tokens == len(r.ids)
        assert r.ids == library.encode_ordinary(texts[r.doc_id].text)


def test_run_gives_the_same_rows(spark, stages):
    wanted = sorted(map(repr, stages[-1][1].collect()))
    assert sorted(map(repr, corpus_pipeline.run(spark, FOLDER).collect())) == wanted


def test_stages_on_awkward_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, spans int, toxicity string, component_id int, _key int"
    data = [(1, None, None, None, None, 1, "a", 1, 1), (1, "", "en", "s", 0, 1, "a", 1, 1), (None, "x " * 3000, "en", "s", 5, 1, "a", 1, 1)]
    data += [(7, "mail a@b.co now", "en", "s", 15, 2, "b", 2, 2)] * 3
    for docs in (spark.createDataFrame(data, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, FOLDER)
            if name != "byte_bpe":
                assert out.columns == docs.columns
            out.collect()
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(data, schema), FOLDER)
    assert kept.count() == 4

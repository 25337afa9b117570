"""Token counts against the library that the vocabulary is made for."""

import random

import duckdb
import public_tokenizers
import pytest
import sentencepiece

from flowsight.llm import token_counts
from flowsight.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts():
    rng = random.Random(9)
    alphabet = "ab the ing \n\t1２½ éñ漢字🙂́  ▁<s>.,-\0|\x1c　 ="
    fuzz = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(2000)]
    return fuzz + ["", " ", "▁", "<unk><s></s> <0x0A>", " " * 700 + "the", "=" * 900, "a" * 3000, "then" * 500, "漢" * 600]


@pytest.mark.parametrize("long_unit", [2, 256])
def test_counts_equal_the_library(monkeypatch, library, long_unit):
    monkeypatch.setattr(token_counts, "LONG_UNIT", long_unit)
    merger = token_counts.Merger(token_counts.read_model(PATH))
    all_texts = texts()
    for text, n in zip(all_texts, merger.count(all_texts), strict=True):
        assert n == len(library.encode(text)), repr(text[:80])


def test_awkward_rows(spark):
    rows = [(1, None, 5), (1, "", None), (None, "é 🙂", 1), (2, "a " * 30_000, 2), (2, "a " * 30_000, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    out = token_counts.count_tokens(df, PATH)
    assert out.columns == ["doc_id", "text", "n_tokens"]
    counts = {r.text: r.n_tokens for r in out.collect()}
    assert (counts[None], counts[""]) == (0, 0)
    assert token_counts.count_tokens(df.limit(0), PATH).count() == 0


def test_query(spark, sf_dir, library):
    found = {r[0]: tuple(r)[1:] for r in QUERIES["op3_token_counts"](spark, sf_dir).collect()}
    for i, text in duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall():
        n = len(library.encode(text or ""))
        assert found.pop(i) == (len((text or "").encode()), n, n > 4096)
    assert not found

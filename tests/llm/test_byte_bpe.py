"""Byte BPE against the tokenizer library, piece by piece and as a round trip."""

import base64
import hashlib
import random

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from flowsight.llm import byte_bpe
from flowsight.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(n=1500):
    rng = random.Random(4)
    alphabet = "ab 's\n\t'll re ve1２½ éñ漢字🙂́  ▁<s>.,-\0|\x1c　 'd"
    fuzz = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return fuzz + ["", " ", "  ", "'", "''s", "a" * 700 + " " * 600 + "b", "they're 'S it's'll  'll \n's", "12 34" * 100, "<|endoftext|>", "x" * 20_000, " " * 20_000]


def test_ids_and_offsets_equal_the_library(library):
    cached = byte_bpe.Pieces(byte_bpe.parse_ranks(byte_bpe.read_ranks(PATH)))
    all_texts = texts()
    for start in range(0, len(all_texts), 200):
        part = all_texts[start : start + 200]
        pieces, offsets, per_text = byte_bpe.split_texts(part, byte_bpe.Automaton(), byte_bpe.class_table())
        ids, per_piece = cached.encode(pieces)
        at = ids_at = 0
        for text, n in zip(part, per_text, strict=True):
            own = pieces[at : at + n]
            m = int(per_piece[at : at + n].sum())
            assert b"".join(own) == text.encode()
            assert offsets[at : at + n].tolist() == np.cumsum([0, *map(len, own)])[:-1].tolist()
            assert ids[ids_at : ids_at + m].tolist() == library.encode_ordinary(text), repr(text[:80])
            at, ids_at = at + n, ids_at + m


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 5000])
def test_blocked_scan_equals_one_step_after_the_other(n):
    automaton = byte_bpe.Automaton()
    symbols = np.random.default_rng(n).integers(0, 9, n)
    state, wanted = byte_bpe.FREE, []
    for s in symbols:
        state, starts = byte_bpe.step(state, s)
        wanted.append(starts)
    assert automaton.boundaries(symbols).tolist() == wanted


def test_long_merges_equal_short_ones():
    ranks = byte_bpe.parse_ranks(byte_bpe.read_ranks(PATH))
    rng = random.Random(1)
    for _ in range(300):
        piece = "".join(rng.choice("abcdeéthin ") for _ in range(rng.randint(1, 100))).encode()
        if piece not in ranks:
            assert byte_bpe.merge(piece[:100], ranks) == byte_bpe.merge_long(piece[:100], ranks)


def test_awkward_rows(spark):
    rows = [(1, None, [9]), (1, "", None), (None, "é 🙂 it's", [1]), (2, "a " * 30_000, [2]), (2, "a " * 30_000, [2])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>")
    out = byte_bpe.decode(byte_bpe.encode(df, PATH), PATH)
    assert out.columns == ["doc_id", "text", "ids", "piece_ids", "piece_starts", "decoded"]
    for r in out.collect():
        assert bytes(r.decoded).decode() == (r.text or "")
        assert sum(r.piece_ids) == len(r.ids)
    assert byte_bpe.decode(byte_bpe.encode(df.limit(0), PATH), PATH).count() == 0


def test_query(spark, sf_dir, library):
    found = {r[0]: tuple(r)[1:] for r in QUERIES["op8_byte_bpe"](spark, sf_dir).collect()}
    for i, text in duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall():
        ids = library.encode_ordinary(text or "")
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert found.pop(i) == (len(ids), digest, hashlib.sha256((text or "").encode()).hexdigest())
    assert not found


def test_encoding_with_its_check(spark):
    texts = ["Hello wörld's", None, "", "🙂 x  \n y", "abc " * 200_000, "同じ 同じ"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string").withColumn("exact", F.lit("clash"))
    found = {r.k: r for r in byte_bpe.encode_exact(df, PATH).collect()}
    plain = {r.k: r for r in byte_bpe.decode(byte_bpe.encode(df, PATH), PATH).collect()}
    assert len(found) == len(texts) and all(r.exact is True for r in found.values())
    assert {k: r.ids for k, r in found.items()} == {k: r.ids for k, r in plain.items()}
    assert all(bytes(r.decoded) == (texts[k] or "").encode() for k, r in plain.items())

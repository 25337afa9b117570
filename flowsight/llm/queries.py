"""The operators as named queries over the given tables, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsight.llm import ann, byte_bpe, collocations, conversation_repair, exact_topk, hpylm, jaccard_join, license_scan, mixing, pii, substring_dedup, token_counts, toxicity
from flowsight.llm.common import crc_part, documents
from flowsight.operators.lookups import match

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(make: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[make.__name__] = make
    return make


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels of two thirds of the document numbers."""
    docs, labels = documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.coalesce(crc_part("doc_id", 3) == 1, F.lit(False))
    chain = toxicity.fit(docs.filter(~held_out), labels.filter(~held_out))
    scored = toxicity.score(docs, chain)
    return scored.select(
        "doc_id",
        held_out.alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.7).cast("int").alias("predicted"),
        F.size("toxic_spans").cast("long").alias("n_spans"),
    )


@query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the windows of 35 words that occur twice."""
    cut = substring_dedup.remove_repeats(documents(spark, sf_dir), length=35)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))

SQL["op2_substring_dedup"] = r"""
WITH texts AS (
    SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
    FROM documents
), windows AS (
    SELECT doc_id, first, sha256(array_to_string(list_slice(words, first, first + 34), ' ')) AS hash
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS first FROM texts WHERE len(words) >= 35)
), again AS (
    SELECT hash FROM windows GROUP BY hash HAVING count(*) > 1
), covered AS (
    SELECT doc_id, list(DISTINCT place) AS places
    FROM (SELECT doc_id, unnest(range(first, first + 35)) AS place FROM windows JOIN again USING (hash))
    GROUP BY doc_id
), cut AS (
    SELECT doc_id, len(words) AS n_words, coalesce(len(places), 0) AS n_removed,
           CASE WHEN places IS NULL THEN words
                ELSE list_filter(words, lambda w, i: NOT list_contains(places, i)) END AS kept
    FROM texts LEFT JOIN covered USING (doc_id)
)
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed,
       sha256(array_to_string(kept, ' ')) AS kept_sha256
FROM cut
"""


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes, tokens of the piece vocabulary and the long-text mark of every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    counted = token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select(
        "doc_id",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > 4096).alias("over_limit"),
    )


@query
def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the strict spans, and all spans, of every document."""
    found = pii.find(documents(spark, sf_dir).select("doc_id", "text"))

    def count(kind: int) -> Column:
        return F.size(F.filter("strict", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)],
        F.sha2(pii.listing(F.col("strict")).cast("binary"), 256).alias("base_sha256"),
        pii.listing(F.col("spans")).alias("spans"),
    )


@query
def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other vectors of every fiftieth vector by integer inner product."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return exact_topk.search(vectors, "vec_id", "embedding", F.col("id") % 50 == 0, k=5)


SQL["op5_exact_topk"] = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
    FROM embeddings
    WHERE embedding IS NOT NULL
      AND NOT list_contains(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), false)
), ranked AS (
    SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score,
           row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(a.q, b.q) DESC, b.vec_id) AS rank
    FROM v a JOIN v b ON a.vec_id <> b.vec_id
    WHERE a.vec_id % 50 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query
def op6_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About the 20 nearest other vectors of every twentieth vector."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann.search(vectors, "vec_id", "embedding", F.col("id") % 20 == 0, k=20)


@query
def op7_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and epochs of a mixture half way between the sources' shares and equal shares."""
    mixed, _ = mixing.mix(documents(spark, sf_dir).select("doc_id", "source", "text"), evenness=0.5, max_epochs=4.0)
    return mixed.select("doc_id", "source", "mix_epoch", "mix_order")


@query
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the bytes that they decode to."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = byte_bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), path)
    decoded = byte_bpe.decode(encoded.select("doc_id", "ids"), path)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op9_hpylm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under a model of nine tenths of the document numbers."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = F.coalesce(crc_part("doc_id", 10) == 0, F.lit(False))
    scored = hpylm.score(docs, hpylm.train(docs.filter(~held_out)))
    return scored.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@query
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles and near-duplicate group of every document."""
    return jaccard_join.near_duplicates(documents(spark, sf_dir), n=5, percent=80)

SQL["op10_jaccard_join"] = r"""
WITH RECURSIVE texts AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, array_to_string(list_slice(words, first, first + 4), ' ') AS shingle
    FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS first FROM texts WHERE len(words) > 0)
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
    SELECT a.doc_id AS x, b.doc_id AS y
    FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
    JOIN sizes m ON m.doc_id = a.doc_id JOIN sizes n ON n.doc_id = b.doc_id
    GROUP BY a.doc_id, b.doc_id, m.n, n.n
    HAVING 100 * count(*) >= 80 * (m.n + n.n - count(*))
), reached AS (
    SELECT doc_id AS x, doc_id AS y FROM texts
    UNION
    SELECT reached.x, links.y FROM reached JOIN links ON reached.y = links.x
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM (SELECT x AS doc_id, min(y) AS component_id FROM reached GROUP BY x) LEFT JOIN sizes USING (doc_id)
"""


@query
def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, base phrases and license labels of every document."""
    found = license_scan.scan(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        F.col("license_score").alias("score"),
        F.size("licenses").cast("long").alias("n_licenses"),
    )


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of two and three words of every language."""
    return collocations.mine(documents(spark, sf_dir), limit=2000, least=10, cover=50)


SQL["op12_collocations"] = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), words AS (
    SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS words FROM pieces
), places AS (
    SELECT lang, words, unnest(range(1, len(words) + 1)) AS first FROM words
), f AS MATERIALIZED (
    SELECT lang, array_to_string(list_slice(words, first, first + size - 1), ' ') AS phrase, size, count(*) AS a
    FROM places, (VALUES (1), (2), (3)) s(size) WHERE first + size - 1 <= len(words)
    GROUP BY ALL
), totals AS (
    SELECT lang, sum(a) AS n FROM f WHERE size = 1 GROUP BY lang
), frequent AS MATERIALIZED (
    SELECT lang, phrase, string_split(phrase, ' ') AS w, size, a FROM f WHERE a >= 10
), sides AS (
    SELECT lang, phrase, w, size, a, k, array_to_string(w[:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y
    FROM frequent, (VALUES (1), (2)) c(k) WHERE k < size
), cuts AS (
    SELECT s.lang, s.phrase, s.w, s.size, k, s.a, l.a AS l, r.a AS r, (1000000::HUGEINT * s.a * s.a) // (l.a::HUGEINT * r.a) AS score
    FROM sides s JOIN frequent l ON l.lang = s.lang AND l.phrase = s.x JOIN frequent r ON r.lang = s.lang AND r.phrase = s.y
), candidates AS MATERIALIZED (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), covered AS (
    SELECT lang, part, max(a) AS a
    FROM (SELECT lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS part, a FROM candidates WHERE size = 3)
    GROUP BY lang, part
), kept AS (
    SELECT c.lang, c.phrase, c.a, c.l, c.r, c.score
    FROM candidates c LEFT JOIN covered v ON v.lang = c.lang AND v.part = c.phrase
    WHERE v.a IS NULL OR 100 * v.a < 50 * c.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
       a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, edits and repaired digest of every conversation after planted damage."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    repaired, turns = conversation_repair.repair(conversation_repair.damaged(rows))
    found = match(rows.select("conv_id").distinct(), repaired, ["conv_id"], "left")
    found = match(found, conversation_repair.digests(turns), ["conv_id"], "left")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return found.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("digest", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )

"""The corpus pipeline: documents through the training-data operators, stage by stage.

1. ``toxicity`` rejects documents that score 0.7 or more.
2. ``near_duplicates`` keeps one document of each group of similar ones.
3. ``personal_data`` replaces spans of personal data by their kind.
4. ``mixing`` draws the sources' documents by their tempered weights.
5. ``byte_bpe`` turns texts into token ids and checks that they decode to the same bytes.

Every stage works on all rows of the one before. The models learn from data, so SQL can't express the
result; tests hold each stage against a plain version.

In all stages a null text counts as empty and stays null in what is returned, texts of any length are
worked on whole, repeated rows are rows of their own unless said otherwise, an empty table gives an
empty one, and columns of any name pass through unchanged, also those named like a stage's own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsight.llm import byte_bpe, jaccard_join, mixing, pii, toxicity
from flowsight.llm.common import crc_part, small_batches
from flowsight.session import materialize

#: The score from which a document is rejected.
TOXIC = 0.7
ORACLE_SQL = None


def _restored(df: DataFrame, columns: list[str], **replaced) -> DataFrame:
    """The document's own columns from the struct that kept them, with some replaced."""
    return df.select(*[replaced[c].alias(c) if c in replaced else F.col(f"_document.`{c}`").alias(c) for c in columns])


def _packed(docs: DataFrame) -> DataFrame:
    """The text beside the document's other columns, so that none of them can clash."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(F.struct(*others).alias("_document"), F.col("text").cast("string").alias("text"))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain, trained on the labels of two thirds of the numbers, doesn't reject.

    Empty texts have the score of no evidence; documents with a null number teach nothing.
    """
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.coalesce(crc_part("doc_id", 3) == 1, F.lit(False))
    chain = toxicity.fit(docs.select("doc_id", "text").filter(~held_out), labels.filter(~held_out))
    scored = toxicity.score(_packed(docs), chain)
    return _restored(scored.filter(F.col("toxicity") < TOXIC), docs.columns, text=F.col("text"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that similarity of 0.8 in shingles of five words connects.

    The document of smallest number stays. Empty texts are linked with nothing, so all of them stay;
    of rows that share a number each is a document of its own.
    """
    small_batches(spark)
    return jaccard_join.keep_first(docs, n=5, percent=80)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind in brackets; n_chars follows.

    Touching spans become one. Texts without spans, null and empty ones stay as they are.
    """
    found = pii.find(_packed(docs))
    text = F.when(F.col("text").isNotNull() & (F.size("spans") > 0), pii.redacted(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    found = found.withColumn("text", text)
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(F.size("spans") > 0, F.length("text").cast(kind)).otherwise(F.col("_document.n_chars"))
    return _restored(found, docs.columns, **changed)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as before, half way in entropy between the sources' shares and equal shares.

    A null source is a source. Repeated rows are drawn together or not at all; sources of empty texts
    only are kept once.
    """
    small_batches(spark)
    packed = _packed(docs).withColumns({c: F.col(f"_document.{c}") for c in ("doc_id", "source")})
    mixed, _ = mixing.mix(packed, evenness=0.5, max_epochs=4.0)
    return _restored(mixed, docs.columns, text=F.col("text"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, their number, and whether they decode to the text's bytes.

    Null and empty texts have no ids, which decode to no bytes.
    """
    small_batches(spark)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = byte_bpe.encode_exact(docs.select("doc_id", "source", "lang", "text"), path)
    return encoded.select("doc_id", "source", "lang", F.size("ids").cast("long").alias("n_tokens"), "exact", "ids")


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs

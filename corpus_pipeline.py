"""A corpus pipeline of five stages, each one an operator of ``rippletrace.llm``.

Every stage works on all that its predecessor kept. The stages return the
columns of ``documents``, whatever further ones there are; the last one returns
token ids. Columns that a stage adds for itself get names that are free.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rippletrace.llm import bpe, mixing, secrets, simhash, toxicity
from rippletrace.llm.common import free_name, materialise, table

TOXIC_AT = 0.7
SHINGLE_WORDS = 5
SECRET_MASK = "[secret]"
VOCABULARY = "byte_bpe_50k.json"


def _numbered(docs: DataFrame, step: str) -> tuple[DataFrame, str]:
    """The rows with a number written next to them, and its column's name: rows may share all that they hold."""
    row = free_name("row", docs.columns)
    return materialise(docs.withColumn(row, F.monotonically_increasing_id()), step), row


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below ``TOXIC_AT``; the model learns from the labels of these documents.

    Null and empty texts have the score of the bias alone. Equal texts, however
    long, have equal scores and stay or go together; rows with a null doc_id
    teach nothing and are scored like others. Without labels all stay if fewer
    than ``TOXIC_AT`` of the labels are 1. An empty table gives an empty table.
    """
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"), held_out=None)
    score = free_name("toxicity", docs.columns)
    return toxicity.score_toxicity(docs, model, into=score).where(F.col(score) < TOXIC_AT).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that with the smallest doc_id, null last.

    Of rows that share that doc_id any one stays; equal rows don't differ. Null,
    empty and blank texts are copies of each other, so that one of them stays.
    Texts are compared as a whole, by shingles of ``SHINGLE_WORDS`` words. An
    empty table gives an empty table.
    """
    numbered, row = _numbered(docs, "pipeline-dedup-rows")
    found = simhash.near_duplicates(numbered, key=row, words=SHINGLE_WORDS).select(F.col(row).alias("of"), "component_id")
    keys = numbered.select(F.col(row).alias("of"), F.col("doc_id").alias("id"))
    first = F.min(F.struct(F.col("id").isNull().alias("missing"), "id", "of"))
    kept = materialise(keys.join(found, "of").groupBy("component_id").agg(first.alias("b")).select(F.col("b.of").alias(row)), "pipeline-kept")
    # A hash join over shuffled keys, whatever the size: texts needn't be sorted.
    return numbered.join(kept.hint("shuffle_hash"), row, "left_semi").select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret in their texts replaced by a mask, and n_chars counted anew where there was one.

    Null and empty texts stay as they are; texts are scanned whole; repeated
    rows are masked alike. An empty table gives an empty table.
    """
    found = secrets.scan_secrets(docs, redact=SECRET_MASK)
    spans = found.columns[-1]
    return found.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix of sources takes it, which may be never.

    Rows are rounded one by one, also those that share a null or repeated
    doc_id. A null source is a source of its own. Null, empty and blank texts
    hold no words: they are taken as often as the whole part of their source's
    rate says. An empty table gives an empty table.
    """
    numbered, row = _numbered(docs, "pipeline-mix-rows")
    times = mixing.mix_sources(numbered, row=row).select(F.col(row).alias("of"), F.col("copies").cast("int").alias("times"))
    taken = numbered.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(row).alias("at"))
    # A hash join over shuffled keys, whatever the size: texts needn't be sorted.
    taken = taken.join(times.where(F.col("times") > 0).hint("shuffle_hash"), F.col("at") == F.col("of"))
    return taken.select("doc", F.explode(F.sequence(F.lit(1), F.col("times")))).select("doc.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and token_ids (binary, 32-bit little-endian) of each row, repeated ones included.

    Texts are encoded whole; null and empty ones have no token. Other columns
    aren't read. An empty table gives an empty table.
    """
    coded = bpe.encode_texts(docs.select("doc_id", "source", "text"), public_tokenizers.path(VOCABULARY))
    return coded.select("doc_id", "source", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"), "token_ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix),
    ("bpe", encode),
]

#: No SQL can express a learned model, fingerprints or merges; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

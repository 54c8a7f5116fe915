"""The registered queries of this subpackage; each applies an operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rippletrace.llm import ann, bpe, hnsw, html, language, lloyd, mixing, negatives, oracles, secrets, simhash, toxicity, url_filter, warc
from rippletrace.llm.common import fold, new_path, table

#: The rules of the URL query.
URL_RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html.extract_main_text(table(spark, sf_dir, "pages", "page_id", "url", "html"), keep=["page_id", "url"])
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents", "doc_id", "text"), keep=["doc_id"])
    span = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("secret_spans", lambda x: x["kind"].isin(*secrets.BASE_KINDS))
    count = lambda kind: F.size(F.filter("secret_spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in secrets.BASE_KINDS],
        F.sha2(F.array_join(F.transform(base, span), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("secret_spans", span), ",").alias("spans"),
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents", "doc_id", "source", "text"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.score_toxicity(docs, model, into="score", keep=["doc_id"]).select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages", "page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = language.fit_languages(docs)
    found = language.predict_languages(docs.drop("lang"), model, keep=["doc_id"])
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search_neighbours(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 50 == 0)


def op10_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicate_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op11_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.cluster_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label").withColumn("label", label)
    return negatives.mine_hard_negatives(rows, F.col("vec_id") % 100 == 0)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_archives(warc.plan_records(table(spark, sf_dir, "pages", "page_id", "url", "html")), path)
    return warc.read_archives(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html": op1_html,
    "op2_secrets": op2_secrets,
    "op3_mixing": op3_mixing,
    "op4_toxicity": op4_toxicity,
    "op5_url_filter": op5_url_filter,
    "op6_bpe": op6_bpe,
    "op7_simhash": op7_simhash,
    "op8_language": op8_language,
    "op9_ann": op9_ann,
    "op10_hnsw": op10_hnsw,
    "op11_lloyd": op11_lloyd,
    "op12_negatives": op12_negatives,
    "op13_warc": op13_warc,
}

#: Learned models, fingerprints, token merges, parsed keys and random mixes have no SQL; tests hold them against plain versions.
ORACLES: dict[str, str] = {
    "op5_url_filter": oracles.url_filter_sql(URL_RULES),
    "op10_hnsw": oracles.vector_links_sql(),
    "op11_lloyd": oracles.clusters_sql(),
    "op12_negatives": oracles.negatives_sql(),
    "op13_warc": oracles.archive_sql(),
}

"""Columns that an operator doesn't work on pass unchanged: long integers next to nulls, decimals, times, nested ones."""

import datetime
import decimal

import public_tokenizers
import pytest

from rippletrace.llm import bpe, html, language, mixing, secrets, simhash, toxicity

BIG = 2**62 + 1
SCHEMA = "doc_id long, text string, source string, n int, d decimal(30,5), t timestamp, m map<string,array<int>>"
ROWS = [
    (BIG, "one two three four", "a", 1, decimal.Decimal("12345678901234567890.12345"), datetime.datetime(2024, 1, 1), {"x": [1, None]}),
    (None, "one two three four", "a", None, None, None, None),
    (BIG + 2, None, None, None, decimal.Decimal("1"), None, {}),
    (BIG + 4, "", "b", 2**31 - 1, None, datetime.datetime(1969, 12, 31), {"y": None}),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).coalesce(1)


def operators(docs, spark):
    model = language.fit_languages(docs.selectExpr("doc_id", "text", "source AS lang"), held_out=None)
    machine = toxicity.fit_toxicity(docs, docs.selectExpr("doc_id", "1 AS toxic").limit(0))
    yield html.extract_main_text(docs, "text", "main")
    yield secrets.scan_secrets(docs)
    yield secrets.scan_secrets(docs, redact="*")
    yield toxicity.score_toxicity(docs, machine)
    yield language.predict_languages(docs, model)
    yield bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_50k.json"))


def test_other_columns_pass_unchanged(docs, spark):
    expected = sorted(map(str, docs.collect()))
    for found in operators(docs, spark):
        assert sorted(map(str, found.select(*docs.columns).collect())) == expected


def test_long_keys_stay_exact(docs):
    keys = [None, BIG, BIG + 2, BIG + 4]
    order = lambda df: sorted((r["doc_id"] for r in df.collect()), key=lambda x: (x is not None, x))
    assert order(mixing.mix_sources(docs)) == keys
    found = simhash.near_duplicates(docs)
    assert order(found) == keys
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == {BIG: BIG, None: BIG, BIG + 2: BIG + 2, BIG + 4: BIG + 2}


def test_kept_columns_only(docs):
    assert secrets.scan_secrets(docs, keep=["doc_id"]).columns == ["doc_id", "secret_spans"]
    assert html.extract_main_text(docs, "text", keep=["doc_id", "text"]).columns == ["doc_id", "text"]

"""Every contract query on a given table against the plain Python version."""

import os

import pyarrow.parquet as pq
import pytest

from splitmill.llm import queries as Q

from . import brute

SF = os.environ.get("LLM_TEST_SF", "/root/testdata/sf0.001")


def table(name, *cols):
    t = pq.read_table(f"{SF}/{name}.parquet")
    return list(zip(*[t.column(c).to_pylist() for c in cols]))


def got(spark, name, *cols):
    return sorted((tuple(r) for r in Q.QUERIES[name](spark, SF).select(*cols).collect()), key=repr)


def same(a, b):
    a, b = sorted(a, key=repr), sorted(b, key=repr)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    assert len(a) == len(b) and not bad, (len(a), len(b), bad[:3])


@pytest.fixture(scope="module")
def docs():
    return table("documents", "doc_id", "text")


def test_op1(spark, docs):
    same(got(spark, "op1_simhash", "doc_id", "fingerprint", "component_id"), brute.simhash(docs))


def test_op2(spark):
    pages = table("pages", "page_id", "url")
    same(got(spark, "op2_url_filters", "page_id", "host", "path", "rule", "verdict"), [(i, *brute.url(u, Q.URL_RULES)) for i, u in pages])


def test_op3(spark, docs):
    same(got(spark, "op3_substring_dedup", "doc_id", "n_words", "n_removed", "kept_sha256"), brute.substring(docs))


def test_op4(spark, docs):
    same(got(spark, "op4_byte_bpe", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"), brute.byte_bpe(docs))


def test_op5(spark, docs):
    same(got(spark, "op5_secrets", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256"), brute.secrets(docs))


def test_op6(spark, docs):
    same(got(spark, "op6_quality_rules", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"), brute.quality(docs))


def test_op8(spark, docs):
    same(got(spark, "op8_records", "doc_id", "start", "n_tokens", "ids_crc32"), brute.records(docs))


def test_op9(spark):
    rows = table("conversations", "conv_id", "turn", "role", "text")
    same(got(spark, "op9_chat", "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256"), brute.chat(rows))


def test_op10(spark, docs):
    items = table("benchmark", "item_id", "text")
    same(got(spark, "op10_decontaminate", "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"), brute.decontaminate(docs, items))

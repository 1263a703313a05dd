"""The registered queries on the smallest tables, and the pipeline."""

import duckdb
import pytest

import corpus_pipeline
from sedge.llm import entries

CONTRACT = {
    "op1_mixing": {"doc_id", "source", "pass"}, "op2_token_files": {"doc_id", "start", "n_tokens", "ids_crc32"}, "op3_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op4_digest": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"}, "op5_lines": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op6_language": {"doc_id", "held_out", "lang_pred", "score"}, "op7_pii": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"}, "op8_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op9_near_duplicates": {"doc_id", "n_shingles", "component_id", "kept"}, "op10_repeats": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
}


@pytest.mark.parametrize("name", CONTRACT)
def test_query(spark, data, name):
    out = entries.QUERIES[name](spark, data)
    assert CONTRACT[name] <= set(out.columns)
    n = spark.read.parquet(f"{data}/documents.parquet").count()
    assert out.count() >= n and out.select("doc_id").distinct().count() == n


@pytest.mark.parametrize("name", entries.SQL)
def test_sql(spark, data, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    out = entries.QUERIES[name](spark, data).toPandas()
    want = db.execute(entries.SQL[name]).df()[list(out.columns)]
    by = list(out.columns)
    assert out.sort_values(by).round(6).astype(str).values.tolist() == want.sort_values(by).round(6).astype(str).values.tolist()


def test_pipeline(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, data)
        assert docs.columns == list(corpus_pipeline.COLUMNS) and not docs.isEmpty()
    out = corpus_pipeline.run(spark, data)
    assert out.count() > 150 and out.where("n_tokens is null").isEmpty()
    assert corpus_pipeline.ORACLE_SQL is None

"""The queries of this subpackage: thin, each over its whole table, with production parameters; and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.llm import bpe, digest, huffman, langid, lines, mixing, neardup, pii, repeats, toxicity
from sedge.llm.common import documents, held_out, shared_dir

END_ID = 1


def tokenizer_path() -> str:
    """The public tokenizer's file; SEDGE_TOKENIZER names another."""
    import public_tokenizers

    return os.environ.get("SEDGE_TOKENIZER") or public_tokenizers.path("word_bpe_49k.json")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mixed_documents(documents(spark, sf_dir, "doc_id", "source", "text"), mixing.Mix(extra=1.25))
    names = {"_tokens": "n_tokens", "_pass": "pass", "_block": "block", "_slot": "slot", "_weight": "weight", "_position": "position"}
    return out.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), *[F.col(a).alias(b) for a, b in names.items()])


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "token-files")
    huffman.token_files(documents(spark, sf_dir, "doc_id", "text"), tokenizer_path(), END_ID, folder)
    return huffman.crc_of_ids(huffman.read_token_files(spark, folder))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encoded(documents(spark, sf_dir, "doc_id", "text"), tokenizer_path())
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op4_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.fingerprints(documents(spark, sf_dir, "doc_id", "text"))


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.line_quality(documents(spark, sf_dir, "doc_id", "text", "source"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lost_words", "n_left_chars", "kept")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = langid.train(documents(spark, sf_dir, "doc_id", "text", "lang"))
    out = langid.predicted(documents(spark, sf_dir, "doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.with_spans(documents(spark, sf_dir, "doc_id", "text"), name="found").drop("text")
    counts = [F.size(pii.of_kind(F.col("found"), k)).cast("long").alias(f"n_{k}") for k in pii.BASE]
    base = pii.joined(pii.of_kind(F.col("found"), *pii.BASE))
    return out.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), pii.joined(F.col("found")).alias("spans"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    out = toxicity.scored(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted", F.size("offending").cast("long").alias("n_offending"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir, "doc_id", "text"), words=3, similarity=0.85)


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.without_repeats(documents(spark, sf_dir, "doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_token_files": op2_token_files,
    "op3_bpe": op3_bpe,
    "op4_digest": op4_digest,
    "op5_lines": op5_lines,
    "op6_language": op6_language,
    "op7_pii": op7_pii,
    "op8_toxicity": op8_toxicity,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_repeats": op10_repeats,
}

SQL: dict[str, str] = {"op1_mixing": mixing.SQL, "op5_lines": lines.SQL}

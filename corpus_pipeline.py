"""A training-data pipeline over documents: each stage reads what the one before it wrote.

Defined results, of every stage: an empty table gives an empty one; columns other than COLUMNS don't go on, so those that
clash with a stage's own are harmless; equal rows are judged alike, each by itself, where the stage doesn't say otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.llm import bpe, langid, mixing, neardup, pii
from sedge.llm.common import Scratch
from sedge.llm.entries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language near enough; a missing lang is filled in.

    A null text, or one without a letter, goes, as it has no language. Texts below 200 code points go for no other reason.
    Null doc_id and source stay as they are. Where no row has a lang to learn from, every document is rejected.
    """
    docs = docs.select(*COLUMNS)
    out = langid.predicted(docs, langid.train(docs))
    return out.where(~F.col("rejected")).withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of least doc_id, of each group of near-duplicates (five words, 0.8); rows of that doc_id stay together.

    Texts that are null or without words are near nothing and stay, as do rows with a null doc_id.
    """
    docs = docs.select(*COLUMNS)
    keep = neardup.near_duplicates(docs, words=5, similarity=0.8).where("kept").select(F.col("doc_id").alias("_id")).distinct()
    kept = docs.join(keep, docs["doc_id"].eqNullSafe(keep["_id"]), "left_semi")
    return kept.select(*COLUMNS)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by marks.

    n_chars follows the new text (null for a null text), and stays null where it was.
    """
    out = pii.redact(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long"))).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's weight asks, at least once.

    A null source is a source of its own; null and empty texts have no tokens and pass as their block does.
    """
    return mixing.mixed_documents(docs.select(*COLUMNS)).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids: doc_id, lang, source, ids, n_tokens; no ids for a null or empty text."""
    out = bpe.encoded(docs.select(*COLUMNS), tokenizer_path())
    return out.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [("language", language), ("near_duplicates", deduplicated), ("pii", private), ("mixing", mixed), ("bpe", encoded)]

#: The stages learn and link, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        scratch = Scratch(spark, name)
        docs = scratch.save(stage(spark, docs, sf_dir))
        if last:
            last.clear()
        last = scratch
    return STAGES[-1][1](spark, docs, sf_dir)

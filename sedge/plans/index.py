"""Building an index: chunks to vectors, points, postings and a manifest; and sinks for all results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.functions.text import words
from sedge.operators import bm25
from sedge.operators.embed import embedded
from sedge.operators.metrics import KS
from sedge.operators.qa import assert_valid
from sedge.operators.vectors import StoreConfig, VectorStore

COMPARISON = ("chunker", "model", "recall_at_10", "precision_at_10", "hit_at_10", "complete_at_10", "ndcg_at_10", "mrr", "top1_id", "top1_ood", "margin", "auroc")


# The columns of the results by question and by slice.
PER_GROUP = ("chunker", "embedding_model", "eval_split", "group_type", "group_value", "n_questions", "k", "recall@k", "precision@k", "hit@k", "evidence_complete@k", "ndcg@k", "mrr")
PER_QUESTION = (
    "question_id", "question", "chunker", "embedding_model", "eval_split", "answerable", "benchmark_group", "difficulty", "question_type", "base_question_type", "question_style", "requires_table",
    "requires_multiple_evidence", "source_doc_tag", "gold_evidence_count", "top1_similarity", "top_chunk_id", "top_chunk_source", "mrr", *[f"{m}@{k}" for k in KS for m in ("recall", "precision", "hit", "complete", "ndcg")],
)
#: What a chunk table must have to be indexed.
CHUNK_COLUMNS = {"chunk_id": "string", "chunk_index": "int", "source": "string", "text": "string", "breadcrumb": "string", "is_table": "boolean", "token_count": "int"}


def chunk_table(spark: SparkSession, path: str) -> DataFrame:
    """A table of chunks; an error that names the columns that are missing or of another type."""
    df = spark.read.parquet(path)
    types = dict(df.dtypes)
    wrong = [f"{c} {t} (found {types.get(c, 'none')})" for c, t in CHUNK_COLUMNS.items() if types.get(c) not in ((t, "bigint") if t == "int" else (t,))]
    if wrong:
        raise ValueError(f"{path} isn't a table of chunks: " + ", ".join(wrong))
    return df


def table_digest(df: DataFrame, key: str) -> DataFrame:
    """One row sha256: over the rows' own digests, combined so that order and partitioning don't matter and nothing is gathered."""
    row = F.conv(F.substring(F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.sha2(F.concat_ws(":", F.count(key).cast("string"), F.sum(row).cast("string")), 256).alias("sha256"))


def manifest(chunks: DataFrame, config: StoreConfig, model: str, tokenizer: str, chunker: str, metrics: DataFrame | None = None) -> DataFrame:
    """One nested row; benchmark figures come from measured metrics, never from constants."""
    out = chunks.agg(F.count("*").alias("points"), F.count_distinct("chunk_id").alias("distinct_ids")).crossJoin(table_digest(chunks, "chunk_id"))  # one row each
    out = out.select(
        F.current_timestamp().alias("created_at_utc"), F.struct(F.lit(model).alias("model"), F.lit(config.dim).alias("dim"), F.lit(config.distance).alias("distance")).alias("embedding"),
        F.struct(F.lit(config.collection).alias("name"), F.col("points"), F.lit(config.mode).alias("mode")).alias("store"),
        F.struct(F.lit(tokenizer).alias("tokenizer"), F.lit(bm25.K1).alias("k1"), F.lit(bm25.B).alias("b")).alias("bm25"), F.struct(F.lit(chunker).alias("type"), F.col("points").alias("n"), F.col("sha256")).alias("chunks"),
    )
    if metrics is not None:
        out = out.crossJoin(F.broadcast(metrics.limit(1).select(F.struct(*metrics.columns).alias("benchmark"))))  # one row
    return out


def build_index(spark: SparkSession, chunks: DataFrame, embed: Callable[[Column], Column], config: StoreConfig, folder: str, model: str, chunker: str, metrics: DataFrame | None = None, tokens=words) -> DataFrame:
    """Write vectors, postings, term statistics and, last, the manifest; returns the manifest, which records the tokenizer by its name."""
    vectors = embedded(chunks, embed, model=model)
    vectors.write.mode("overwrite").parquet(f"{folder}/vectors")
    vectors = spark.read.parquet(f"{folder}/vectors")
    assert_valid(chunks, vectors, config.dim)
    store = VectorStore(spark, config).add(vectors)
    store.persist()
    posted = bm25.postings(chunks, "chunk_id", tokens=tokens)
    stats = bm25.corpus_stats(chunks, tokens=tokens)
    posted.write.mode("overwrite").parquet(f"{folder}/postings")
    bm25.term_stats(spark.read.parquet(f"{folder}/postings"), stats, "chunk_id").write.mode("overwrite").parquet(f"{folder}/terms")
    stats.write.mode("overwrite").parquet(f"{folder}/stats")
    out = manifest(chunks, config, model, getattr(tokens, "tokenizer_name", tokens.__name__), chunker, metrics)
    write_json(out, f"{folder}/manifest")
    return out


def write_csv(df: DataFrame, path: str, columns: tuple[str, ...]) -> None:
    """Columns in a fixed order; nulls are empty cells."""
    df.select(*columns).write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)

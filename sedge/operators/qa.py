"""Checks and figures over chunk tables, and the contract rules that every build asserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedge.functions.text import without_breadcrumb

LEADING = r"^\s*[,.;:!?)\]}]"
NESTED = r"^[ \t]{2,}[-+*]"


def figures(name: str, x: Column) -> list[Column]:
    return [F.avg(x).alias(f"avg_{name}"), F.percentile(x, 0.5).alias(f"median_{name}"), F.percentile(x, 0.95).alias(f"p95_{name}"), F.min(x).alias(f"min_{name}"), F.max(x).alias(f"max_{name}")]


def length_stats(df: DataFrame, by: list[str], tokens: Column, chars: Column) -> DataFrame:
    """Figures of token and character counts for each group and, by ROLLUP, over all."""
    return df.withColumn("_t", tokens).withColumn("_c", chars).rollup(*by).agg(F.count("*").alias("n"), *figures("tokens", F.col("_t")), *figures("chars", F.col("_c")))


def chunk_stats(chunks: DataFrame, by: tuple[str, ...] = ("chunker_type", "doc_id")) -> DataFrame:
    """Counts, duplicates, odd starts and figures for each source, each chunker and over all."""
    body = without_breadcrumb(F.col("text"))
    x = chunks.withColumns({"_body": body, "_nested": F.size(F.filter(F.split(body, "\n"), lambda line: line.rlike(NESTED)))})
    return x.rollup(*by).agg(
        F.count("*").alias("total"), F.count_if("is_table").alias("tables"), F.count_if(F.col("is_table") & (F.col("table_parts") > 1)).alias("split_table_parts"),
        F.count_if("was_split").alias("was_split"), F.count_if("overflow_split").alias("overflow"), F.count_if("too_long").alias("too_long"), F.count_if("semantic_fallback").alias("fallback"),
        (F.count("*") - F.count_distinct("chunk_id")).alias("duplicate_ids"), F.count_if(F.col("_body").rlike(LEADING)).alias("leading_punctuation"), F.sum("_nested").alias("nested_list_lines"),
        *figures("tokens", F.col("token_count")), *figures("chars", F.length("text")),
    )


def gates(stats: DataFrame) -> DataFrame:
    """Rows of chunk_stats() that break a gate."""
    return stats.where((F.col("too_long") > 0) | (F.col("duplicate_ids") > 0) | (F.col("leading_punctuation") > 0))


def assert_valid(
    chunks: DataFrame, vectors: DataFrame | None = None, dim: int | None = None, key: str = "chunk_id", required: tuple[str, ...] = ("text",), vector: str = "embedding", k: int | None = None, distance: str | None = None, unmapped: DataFrame | None = None
) -> None:
    """Raise ValueError with every rule that the tables break: rows, columns, unique ids, finite vectors of one dimension, parity, k, distance, evidence."""
    broken = [f"column {c} is missing" for c in (key, *required) if c not in chunks.columns]
    if not broken:
        n, ids = chunks.agg(F.count("*"), F.count_distinct(key)).first()
        broken += ["there are no rows"] * (n == 0) + ["ids repeat"] * (ids < n)
        if vectors is not None:
            v = F.col(vector).cast("array<double>")
            bad, least, most, count = vectors.agg(F.count_if(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))), F.min(F.size(v)), F.max(F.size(v)), F.count("*")).first()
            broken += ["a vector isn't finite"] * (bad > 0) + ["dimensions differ"] * (least != most or (dim is not None and most != dim)) + ["chunks and vectors differ in number"] * (count != n)
            if not vectors.join(chunks, key, "left_anti").isEmpty():
                broken.append("a vector has no chunk")
    if k is not None and k <= 0:
        broken.append("k must be positive")
    if distance is not None and distance not in ("cosine", "dot", "euclidean"):
        broken.append("unknown distance")
    if unmapped is not None and not unmapped.isEmpty():
        broken.append("evidence is unmapped")
    if broken:
        raise ValueError("; ".join(broken))

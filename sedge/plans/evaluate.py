"""Retrieval evaluation: questions with gold evidence, chunks and vectors to metrics, slices and a comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedge.operators import evidence, metrics, vectors

# The fields of a question record.
QUESTION = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "question", "language", "source_doc_tag", "source_file", "expected_behavior", "question_type", "base_question_type", "question_style", "difficulty", "benchmark_group", "reference_answer", "reference_answer_type", "split")]
    + [T.StructField(n, T.BooleanType()) for n in ("answerable", "requires_table", "requires_multiple_evidence")]
    + [T.StructField("query_features", T.StructType([T.StructField(n, T.BooleanType()) for n in ("colloquial", "short_query", "contains_typo", "implicit_medical_term")])), T.StructField("gold_evidence_count", T.IntegerType())]
    + [T.StructField("gold_evidence", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("evidence_id", "source_doc_tag", "source_file", "heading", "evidence_text")] + [T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType())])))]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("ground_truth_sections", "ground_truth_evidence_ids", "key_facts", "evaluation_targets", "tags")]
)


def questions(spark: SparkSession, path: str, split: str = "all") -> DataFrame:
    """Question records of a split (dev, test or all); none, or repeated ids, is an error."""
    if split not in ("dev", "test", "all"):
        raise ValueError("split must be dev, test or all")
    rows = spark.read.schema(QUESTION).json(path, multiLine=True)
    rows = rows if split == "all" else rows.where(F.col("split") == split)
    n, ids = rows.agg(F.count("*"), F.count_distinct("id")).first()
    if not n or ids < n:
        raise ValueError("no questions" if not n else "question ids repeat")
    return rows


def gold_evidence(rows: DataFrame) -> DataFrame:
    """question_id, evidence_id, source, text of answerable questions."""
    x = rows.where("answerable").select(F.col("id").alias("question_id"), F.explode("gold_evidence").alias("e"))
    return x.select("question_id", "e.evidence_id", F.col("e.source_file").alias("source"), F.col("e.evidence_text").alias("text"))


def gold_of(rows: DataFrame, chunks: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(query_id, evidence_id, chunk_id, gain) and the mapping report; the report is made before unmapped evidence fails."""
    gold = gold_evidence(rows)
    matches = evidence.evidence_matches(gold.select("evidence_id", "source", "text"), chunks.select("chunk_id", "source", "text"), source="source").where("is_relevant")
    report = evidence.evidence_report(gold, matches)
    if strict and report.first()["unmapped"]:
        raise ValueError("evidence is unmapped: " + str(report.first().asDict()))
    return gold.select(F.col("question_id").alias("query_id"), "evidence_id").join(matches, "evidence_id").select("query_id", "evidence_id", "chunk_id", F.col("coverage").alias("gain")), report


def experiment(rows: DataFrame, query_vectors: DataFrame, chunk_vectors: DataFrame, gold: DataFrame, ks: tuple[int, ...] = metrics.KS) -> tuple[DataFrame, DataFrame]:
    """Per-question metrics (query_id, k, ...) of answerable questions, and each question's best chunk (query_id, score, is_ood, chunk_id).

    Only the max(ks) nearest chunks of a question are ranked; where none of them is relevant, the rank of its first
    relevant chunk among all is counted. A question or chunk without a vector takes no part; ties go to the greater chunk_id.
    """
    questions, chunks = vectors.numbered(query_vectors, "query_id"), vectors.numbered(chunk_vectors, "chunk_id")
    questions = questions.withColumn("number", -1 - F.col("number"))  # no question is its own chunk
    q = vectors.checkpointed(query_vectors.join(questions, "query_id").select(F.col("number").alias("query_id"), "embedding"))
    p = vectors.checkpointed(chunk_vectors.join(chunks, "chunk_id").select(F.col("number").alias("vec_id"), "embedding"))
    names = questions.withColumnRenamed("number", "_question")
    near = vectors.top_k(q, p, max(ks)).withColumnRenamed("query_id", "_question")
    ranks = vectors.checkpointed(near.join(names, "_question").join(chunks, F.col("vec_id") == F.col("number")).select("query_id", "chunk_id", "rank", "score"))
    pairs = gold.select("query_id", "chunk_id").distinct().join(names, "query_id").join(chunks, "chunk_id").select(F.col("_question").alias("query_id"), F.col("number").alias("vec_id"))
    first = vectors.first_relevant_ranks(q, p, pairs).withColumnRenamed("query_id", "_question").join(names, "_question").select("query_id", "rank")
    top1 = ranks.where("rank = 1").join(rows.select(F.col("id").alias("query_id"), (~F.col("answerable")).alias("is_ood")), "query_id").select("query_id", "score", "is_ood", "chunk_id")
    asked = ranks.join(rows.where("answerable").select(F.col("id").alias("query_id")), "query_id", "left_semi")
    return metrics.question_metrics(asked, gold, ks, first), top1


def unmapped(rows: DataFrame, chunks: DataFrame, gold: DataFrame) -> DataFrame:
    """question_id, evidence_id, source of evidence without a relevant chunk, and its best candidate (chunk_id, matched, coverage; null if its source has no chunk)."""
    left = gold_evidence(rows).join(gold.select(F.col("query_id").alias("question_id"), "evidence_id").distinct(), ["question_id", "evidence_id"], "left_anti")
    own = chunks.withColumn("chunk_pos", F.col("chunk_index"))
    best = evidence.best_candidates(left.select("evidence_id", "source", "text").distinct(), own, "source")
    return left.select("question_id", "evidence_id", "source").join(best, "evidence_id", "left")


def per_question(rows: DataFrame, found: DataFrame, top1: DataFrame, chunks: DataFrame, chunker: str, model: str, split: str) -> DataFrame:
    """One row a question: its fields, its best chunk, and each metric at each k; unanswerable ones have no metrics."""
    names = ("recall", "precision", "hit", "complete", "ndcg")
    wide = found.groupBy("query_id").agg(F.first("rr").alias("mrr"), *[F.max(F.when(F.col("k") == k, F.col(m))).alias(f"{m}@{k}") for k in metrics.KS for m in names])
    best = top1.join(chunks.select("chunk_id", F.col("source").alias("top_chunk_source")), "chunk_id", "left").select("query_id", F.col("score").alias("top1_similarity"), F.col("chunk_id").alias("top_chunk_id"), "top_chunk_source")
    tags = {"question_id": F.col("id"), "chunker": F.lit(chunker), "embedding_model": F.lit(model), "eval_split": F.lit(split)}
    return rows.withColumns(tags).drop("gold_evidence").join(best, F.col("id") == best["query_id"], "left").drop("query_id").join(wide, F.col("id") == wide["query_id"], "left").drop("query_id")


def per_group(rows: DataFrame, found: DataFrame, chunker: str, model: str, split: str) -> DataFrame:
    """Means of the metrics over all questions and over each slice, by k."""
    of = rows.select(F.col("id").alias("query_id"), metrics.question_slices().alias("slices"))
    means = metrics.group_means(found.join(of, "query_id"), F.col("slices"))
    kind, value = metrics.parted(F.col("group"))
    named = {"recall": "recall@k", "precision": "precision@k", "hit": "hit@k", "complete": "evidence_complete@k", "ndcg": "ndcg@k", "rr": "mrr", "n": "n_questions"}
    return means.select(F.lit(chunker).alias("chunker"), F.lit(model).alias("embedding_model"), F.lit(split).alias("eval_split"), kind.alias("group_type"), value.alias("group_value"), "k", *[F.col(a).alias(b) for a, b in named.items()])


def cube(experiments: dict[tuple[str, str], tuple[DataFrame, DataFrame]]) -> DataFrame:
    """One comparison row for each (chunker, model), from one long table."""
    rows = top = None
    for (chunker, model), (m, t) in experiments.items():
        tag = {"chunker": F.lit(chunker), "model": F.lit(model)}
        m, t = m.withColumns(tag), t.drop("chunk_id").withColumns(tag)
        rows, top = (m, t) if rows is None else (rows.unionByName(m), top.unionByName(t))
    return metrics.comparison(rows, top, ["chunker", "model"])

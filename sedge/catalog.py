"""All queries of the engine's own operators over the shared tables, and their DuckDB SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sedge.functions import text as tx
from sedge.operators import bm25, chunkers, clean, display, embed, evidence, metrics, qa, sections, vectors
from sedge.operators.lines import exploded
from sedge.marked import CONNECTORS, marked
from sedge.marked import SQL as MARKED_SQL
from sedge.oracles import SQL as PLAIN_SQL
from sedge.plans.index import table_digest
from sedge.sources import html

#: Searches take every row whose id is divisible by this as queries.
EVERY = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vector_queries(points: DataFrame) -> DataFrame:
    return points.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), "embedding")


def search(distance: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        points = table(spark, sf_dir, "embeddings")
        hits = vectors.top_k(vector_queries(points), points, 15, distance)
        return hits.select("query_id", "rank", "vec_id", (F.round("score", 6) + 0.0).alias("score"))

    return query


def label_ranks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The 30 nearest of each query but itself, and gold: vectors of its label, seven evidences a label by id modulo 7, gain by parity of the id."""
    points = table(spark, sf_dir, "embeddings")
    ranks = vectors.top_k(vector_queries(points), points, 30, exclude_self=True).withColumnRenamed("vec_id", "chunk_id")
    asked = points.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), "label")
    gold = points.select(F.col("vec_id").alias("chunk_id"), "label").join(asked, "label").where("chunk_id != query_id")
    return ranks, gold.select("query_id", (F.col("label") * 7 + F.col("chunk_id") % 7).alias("evidence_id"), "chunk_id", F.when(F.col("chunk_id") % 2 == 0, 1.0).otherwise(0.5).alias("gain"))


def vector_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.vector_report(table(spark, sf_dir, "embeddings"))


def rank_recall_precision_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.recall_metrics(*label_ranks(spark, sf_dir))
    return out.select("query_id", "k", *[F.round(c, 6).alias(c) for c in ("recall", "hit", "complete", "precision")])


def rank_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the full ranking of each query, by counting."""
    points = table(spark, sf_dir, "embeddings")
    _, gold = label_ranks(spark, sf_dir)
    first = vectors.first_relevant_ranks(vector_queries(points), points, gold.withColumnRenamed("chunk_id", "vec_id"))
    return first.select("query_id", F.col("rank").alias("first_rank"), F.round(1 / F.col("rank"), 6).alias("rr"))


def rank_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ndcg(*label_ranks(spark, sf_dir)).select("query_id", "k", F.round("ndcg", 6).alias("ndcg"))


def rank_group_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.recall_metrics(*label_ranks(spark, sf_dir)).join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "label"), "query_id")
    out = metrics.group_means(rows, F.array(F.concat(F.lit("label:"), F.col("label").cast("string")), F.when(F.col("query_id") % 200 == 0, "even")))
    return out.select("group", "k", "n", *[F.round(c, 6).alias(c) for c in ("recall", "hit", "complete", "precision")])


def rank_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.wide(metrics.recall_metrics(*label_ranks(spark, sf_dir)), ["recall", "precision"])
    return out.select("query_id", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


def ood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels from 8 on stand for questions out of the domain; the score is the greatest similarity to the others."""
    points = table(spark, sf_dir, "embeddings")
    best = vectors.top_k(vector_queries(points), points.where("label < 8"), 1, exclude_self=True)
    return best.join(points.select(F.col("vec_id").alias("query_id"), (F.col("label") >= 8).alias("is_ood")), "query_id").select("query_id", F.round("score", 9).alias("score"), "is_ood")


def ood_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.auroc(ood(spark, sf_dir)).select(F.round("auroc", 6).alias("auroc"))


def experiment_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two experiments, by cosine and by dot product, as one comparison."""
    points = table(spark, sf_dir, "embeddings")
    rows = top = None
    for distance in ("cosine", "dot"):
        ranks = vectors.top_k(vector_queries(points), points, 30, distance, exclude_self=True).withColumnRenamed("vec_id", "chunk_id")
        _, gold = label_ranks(spark, sf_dir)
        m = metrics.question_metrics(ranks, gold).withColumn("model", F.lit(distance))
        t = ood(spark, sf_dir).withColumn("model", F.lit(distance))
        rows, top = (m, t) if rows is None else (rows.unionByName(m), top.unionByName(t))
    out = metrics.comparison(rows, top, ["model"])
    return out.select("model", *[F.round(c, 6).alias(c) for c in out.columns if c != "model"])


def evidence_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tx.evidence_tokens(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", t.alias("t")).select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("tokens_md5"))


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("evidence_id"), "text")
    return evidence.evidence_matches(items, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text"))


def evidence_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark, sf_dir).select("evidence_id", "chunk_id", "matched", F.round("coverage", 6).alias("coverage"), "is_relevant")


def evidence_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("evidence_id"))
    return evidence.evidence_report(items, matches(spark, sf_dir)).withColumn("avg_chunks", F.round("avg_chunks", 6))


def gold_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gains of chunks for questions that each have five benchmark items as evidence."""
    questions = table(spark, sf_dir, "benchmark").select(F.floor(F.col("item_id") / 5).alias("question_id"), F.col("item_id").alias("evidence_id"))
    gains, _ = evidence.gold_map(questions, matches(spark, sf_dir))
    return gains.withColumn("gain", F.round("gain", 6))


def bm25_index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    terms = bm25.term_stats(bm25.postings(docs), bm25.corpus_stats(docs))
    of = F.least("df", F.lit(64)).cast("long")
    figures = [F.count("*").alias("n_terms"), F.sum("df").alias("n_postings"), F.sum(F.length("term")).alias("n_chars"), F.min("term").alias("first_term")]
    return terms.groupBy(of.alias("df_up_to_64")).agg(*figures, F.round(F.min("idf"), 6).alias("least_idf"), F.round(F.max("idf"), 6).alias("most_idf"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    posted, stats = bm25.postings(docs), bm25.corpus_stats(docs)
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    hits = bm25.bm25_top_k(bm25.bm25_scores(asked, posted, bm25.term_stats(posted, stats), stats))
    return hits.select("query_id", "rank", "doc_id", F.round("score", 4).alias("score"))


def point_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.point_id(F.concat_ws("::", "source", F.col("doc_id").cast("string"))).alias("point_id"))


def cleaned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs, *clean.clean(docs)


def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(spark, sf_dir)[1].select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def clean_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clean.clean_report(*cleaned(spark, sf_dir))
    return out.select("doc_id", "chars_before", "chars_after", F.coalesce(F.size("warnings"), F.lit(0)).alias("n_warnings"), "reduction_pct")


def clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, _ = clean.clean_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(F.col("line") == "").alias("n_blank"))


def cleaned_markup(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = marked(table(spark, sf_dir, "documents"))
    return docs, *clean.clean_lines(docs, config=clean.CleanConfig(connectors=CONNECTORS))


def clean_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cleaning rules over documents with markup."""
    docs, lines, _ = cleaned_markup(spark, sf_dir)
    text, _ = clean.clean(docs, config=clean.CleanConfig(connectors=CONNECTORS))
    n = lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"))
    return text.join(n, "doc_id", "left").select("doc_id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def clean_markup_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned_markup(spark, sf_dir)[2].select("doc_id", "type", "line", "detail")


def markup_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections and heading paths of documents with markup."""
    out = sections.sections(marked(table(spark, sf_dir, "documents")))
    path = F.array_join(F.filter(F.array(*[F.col(f"h{n}") for n in range(1, 7)]), lambda h: h.isNotNull()), " > ")
    return out.select("doc_id", "section_no", F.length("content").alias("n_chars"), F.md5(F.col("content").cast("binary")).alias("content_md5"), F.nullif(path, F.lit("")).alias("path"))


def markup_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables with their captions in documents with markup."""
    out = sections.elements(marked(table(spark, sf_dir, "documents"))).where("is_table")
    return out.select("doc_id", F.col("table_no").cast("int").alias("table_no"), F.size(F.split("content", "\n")).alias("n_lines"), "caption", F.md5(F.col("content").cast("binary")).alias("content_md5"))


def dedupe_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered sources among the lexical hits of each benchmark item; the language is the section."""
    docs = table(spark, sf_dir, "documents")
    hits = bm25_topk(spark, sf_dir).join(docs.select("doc_id", "source", F.col("lang").alias("section")), "doc_id")
    return display.numbered_sources(hits)


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as points with their length as version: a text that comes again replaces the shorter one of its source and language."""
    docs = table(spark, sf_dir, "documents").select(F.concat_ws("::", "source", "lang").alias("key"), "doc_id", (F.length("text").cast("long") * 1000000 + F.col("doc_id")).alias("version"))
    return vectors.upserted(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), "key", "version").select("key", "doc_id")


def token_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    out = qa.length_stats(docs, ["lang", "source"], tx.token_count(F.col("text")), F.length("text"))
    return out.select("lang", "source", "n", *[F.round(c, 4).alias(c) for c in out.columns[3:]])


def table_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_digest(table(spark, sf_dir, "documents"), "doc_id")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.page_documents(table(spark, sf_dir, "pages"))


def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", "source_file", F.length("markdown").alias("n_chars"), F.md5(F.col("markdown").cast("binary")).alias("markdown_md5"), "status")


def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.sections(pages(spark, sf_dir), "page_id", "markdown").select("page_id", "section_no", F.length("content").alias("n_chars"), "breadcrumb")


def page_heading_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = sections.with_headings(exploded(pages(spark, sf_dir), "page_id", "markdown", python_lines=True), "page_id")
    return lines.where(F.col("line").rlike(sections.HEADING)).select("page_id", "line_no", F.length(F.regexp_extract("line", sections.HEADING, 1)).alias("level"), tx.breadcrumb(*[F.col(f"h{n}") for n in range(1, 7)]).alias("path"))


CHUNKING = chunkers.ChunkConfig(max_tokens=256, overlap=51)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunkers.hierarchical_chunks(pages(spark, sf_dir), "page_id", "markdown", CHUNKING)


def hier_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("page_id", "chunk_id", "chunk_index", F.md5(F.col("text").cast("binary")).alias("text_md5"), "token_count", "breadcrumb", "split_reason")


def hier_chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.chunk_stats(chunks(spark, sf_dir), ("chunker_type", "page_id"))


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunkers.hierarchical_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"), config=CHUNKING)
    return out.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum("content_token_count").alias("n_tokens"), F.max("token_count").alias("longest"))


def semantic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunkers.semantic_chunks(pages(spark, sf_dir), embed.hashing_embedder(64), "page_id", "markdown", CHUNKING)
    return out.select("page_id", "chunk_id", "chunk_index", F.md5(F.col("text").cast("binary")).alias("text_md5"), "token_count", "split_reason", "merged_short_piece")


def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: fusion of the lexical ranking and a ranking by document length."""
    lexical = bm25_topk(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"))
    long = lexical.join(docs, "doc_id").withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("n"), "doc_id")))
    return bm25.rrf([lexical, long]).select("query_id", "doc_id", F.round("score", 9).alias("score"))


def session_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return display.newest_sessions(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "vector_topk_cosine": search("cosine"), "vector_topk_dot": search("dot"), "vector_topk_euclidean": search("euclidean"), "vector_validate": vector_validate,
    "rank_recall_precision_hit": rank_recall_precision_hit, "rank_mrr": rank_mrr, "rank_ndcg": rank_ndcg, "rank_group_slices": rank_group_slices, "rank_wide": rank_wide, "ood_auroc": ood_auroc, "experiment_comparison": experiment_comparison,
    "evidence_tokens": evidence_tokens, "evidence_match": evidence_match, "evidence_report": evidence_report, "gold_relevance": gold_relevance,
    "bm25_index_stats": bm25_index_stats, "bm25_topk": bm25_topk, "hybrid_rrf": hybrid_rrf, "point_ids": point_ids, "dedupe_sources": dedupe_sources, "upsert_latest": upsert_latest,
    "clean_documents": clean_documents, "clean_report": clean_report, "clean_lines": clean_lines, "clean_markup": clean_markup, "clean_markup_warnings": clean_markup_warnings, "markup_sections": markup_sections, "markup_tables": markup_tables, "token_length_stats": token_length_stats, "table_sha": table_sha,
    "page_markdown": page_markdown, "page_sections": page_sections, "page_heading_paths": page_heading_paths, "hier_chunks": hier_chunks, "hier_chunk_stats": hier_chunk_stats, "document_chunks": document_chunks,
    "semantic_chunks": semantic_chunks, "session_history": session_history,
}

SQL: dict[str, str] = PLAIN_SQL | MARKED_SQL

__all__ = ["QUERIES", "SQL"]

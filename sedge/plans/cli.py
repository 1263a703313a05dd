"""Commands: load, clean, chunk, build, evaluate. Folders of Parquet in and out, so each works on a cluster."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.operators import chunkers, clean, embed, qa
from sedge.operators.vectors import DISTANCES, StoreConfig
from sedge.plans import evaluate, index
from sedge.sources import html


def load(spark: SparkSession, a: argparse.Namespace) -> None:
    """HTML or text files to raw documents; what was wholly processed before is skipped on demand."""
    files = html.with_ocr(html.binary_files(spark, a.input, a.pattern), force=True if a.force_ocr else None)
    if a.only_new:
        files = html.only_new(files, spark.read.parquet(f"{a.output}/documents"))
    if a.pattern.endswith((".html", ".htm")):
        good = html.page_documents(files.select("source", F.col("source").alias("url"), F.decode("content", F.lit("UTF-8")).alias("html")), "source")
        bad = files.select("source", F.lit(None).cast("string").alias("error")).where("false")
    else:
        good, bad = html.parsed(files, lambda content, force, languages: (content.decode(), 1), tuple(a.languages))
    mode = "append" if a.only_new else "overwrite"
    good.write.mode(mode).parquet(f"{a.output}/documents")
    bad.write.mode("overwrite").parquet(f"{a.output}/failed")


def clean_command(spark: SparkSession, a: argparse.Namespace) -> None:
    docs = spark.read.parquet(f"{a.input}/documents")
    cleaned, warnings = clean.clean(docs, "source", "markdown")
    cleaned.write.mode("overwrite").parquet(f"{a.output}/cleaned")
    index.write_json(clean.clean_report(docs, spark.read.parquet(f"{a.output}/cleaned"), warnings, "source", "markdown"), f"{a.output}/report")


def chunks_of(kind: str, docs: DataFrame, limit: int) -> DataFrame:
    config = chunkers.ChunkConfig(max_tokens=limit, overlap=min(100, limit // 5) if kind == "hierarchical" else min(50, limit // 5), min_tokens=min(30, limit - 1))
    return chunkers.hierarchical_chunks(docs, "source", "text", config) if kind == "hierarchical" else chunkers.semantic_chunks(docs, embed.hashing_embedder(), "source", "text", config)


def chunk(spark: SparkSession, a: argparse.Namespace) -> None:
    docs = spark.read.parquet(f"{a.cleaned_dir}/cleaned")
    stats = None
    for kind in ("hierarchical", "semantic"):
        chunks_of(kind, docs, a.max_tokens).write.mode("overwrite").parquet(f"{a.output_dir}/chunks_{kind}")
        one = qa.chunk_stats(spark.read.parquet(f"{a.output_dir}/chunks_{kind}"), ("chunker_type", "source")).where("chunker_type is not null")
        stats = one if stats is None else stats.unionByName(one)
    index.write_json(stats, f"{a.output_dir}/summary")
    if not (broken := qa.gates(stats.where("source is null"))).isEmpty():
        raise ValueError(f"chunks break a gate: {broken.first().asDict()}")


def build(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.model != "hashing":
        raise ValueError(f"the command can embed by 'hashing' only; pass an embedder of {a.model} to build_index()")
    chunks = index.chunk_table(spark, f"{a.chunks_dir}/chunks_{a.chunker}")
    config = StoreConfig(a.collection, a.expected_dim, a.distance, a.mode, a.local_path)
    index.build_index(spark, chunks, embed.hashing_embedder(a.expected_dim), config, a.local_path, a.model, a.chunker)


def evaluation(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = evaluate.questions(spark, a.questions, a.split)
    make = embed.hashing_embedder(a.expected_dim)
    queries = rows.select(F.col("id").alias("query_id"), make(F.col("question")).alias("embedding"))
    runs, by_question, by_group = {}, None, None
    for kind in ("hierarchical", "semantic"):
        chunks = index.chunk_table(spark, f"{a.chunks_dir}/chunks_{kind}")
        gold, report = evaluate.gold_of(rows, chunks, strict=False)
        index.write_json(report, f"{a.output_dir}/mapping_{kind}")
        index.write_json(evaluate.unmapped(rows, chunks, gold), f"{a.output_dir}/unmapped_{kind}")
        found, top = runs[kind, "hashing"] = evaluate.experiment(rows, queries, chunks.select("chunk_id", make(F.col("text")).alias("embedding")), gold)
        q, g = evaluate.per_question(rows, found, top, chunks, kind, "hashing", a.split), evaluate.per_group(rows, found, kind, "hashing", a.split)
        by_question, by_group = (q, g) if by_question is None else (by_question.unionByName(q), by_group.unionByName(g))
    index.write_csv(by_question, f"{a.output_dir}/per_question", index.PER_QUESTION)
    index.write_csv(by_group, f"{a.output_dir}/per_group", index.PER_GROUP)
    index.write_csv(evaluate.cube(runs), f"{a.output_dir}/comparison", index.COMPARISON)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sedge")
    sub = p.add_subparsers(required=True)
    x = sub.add_parser("load")
    x.add_argument("input"), x.add_argument("output"), x.add_argument("--pattern", default="*.html"), x.add_argument("--force_ocr", action="store_true"), x.add_argument("--languages", nargs="+", default=["vi", "en"]), x.add_argument("--only-new", action="store_true")
    x.set_defaults(run=load)
    x = sub.add_parser("clean")
    x.add_argument("input"), x.add_argument("output")
    x.set_defaults(run=clean_command)
    x = sub.add_parser("chunk")
    x.add_argument("--cleaned-dir", required=True), x.add_argument("--output-dir", required=True), x.add_argument("--max-tokens", type=int, default=1024)
    x.set_defaults(run=chunk)
    x = sub.add_parser("build")
    x.add_argument("--chunks-dir", required=True), x.add_argument("--chunker", choices=("hierarchical", "semantic"), default="hierarchical"), x.add_argument("--model", default="hashing"), x.add_argument("--expected-dim", type=int, default=64)
    x.add_argument("--distance", choices=DISTANCES, default="cosine"), x.add_argument("--mode", choices=("local", "memory"), default="local"), x.add_argument("--collection", default="chunks"), x.add_argument("--local-path", required=True)
    x.set_defaults(run=build)
    x = sub.add_parser("evaluate")
    x.add_argument("--split", choices=("dev", "test", "all"), default="dev"), x.add_argument("--chunks-dir", required=True), x.add_argument("--questions", required=True), x.add_argument("--output-dir", required=True), x.add_argument("--expected-dim", type=int, default=64)
    x.set_defaults(run=evaluation)
    return p


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    a.run(SparkSession.builder.getOrCreate(), a)


if __name__ == "__main__":
    main()

"""Gold evidence in chunks by the longest run of tokens they share, found through n-grams on one diagonal."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedge.functions.text import evidence_tokens, without_breadcrumb

COVERAGE, MATCHED = 0.3, 8


def grams(df: DataFrame, keys: list[str], tokens: str, size: str) -> DataFrame:
    """keys, pos, gram: a 64-bit hash of each run of so many tokens."""
    last = F.size(tokens) - F.col(size) + 1
    starts = F.when(last >= 1, F.sequence(F.lit(1), last))
    return df.select(*keys, tokens, size, F.explode(starts).alias("pos")).select(*keys, "pos", F.xxhash64(F.slice(tokens, F.col("pos"), F.col(size)), F.col(size)).alias("gram"))


def evidence_matches(evidence: DataFrame, chunks: DataFrame, least: int = MATCHED, coverage: float = COVERAGE, source: str | None = None) -> DataFrame:
    """evidence_id, chunk_id, matched, coverage, is_relevant for each pair with a common run of min(least, tokens of the evidence) or more.

    evidence: evidence_id, text; chunks: chunk_id, text; both with the source column if one is named, which then must agree.
    """
    same = [source] if source else []
    e = evidence.select("evidence_id", *same, evidence_tokens(F.col("text")).alias("tokens")).where(F.size("tokens") > 0)
    e = e.withColumn("total", F.size("tokens")).withColumn("n", F.least(F.lit(least), F.col("total")))
    c = chunks.select("chunk_id", *same, evidence_tokens(without_breadcrumb(F.col("text"))).alias("tokens"))
    sizes = [r["n"] for r in e.select("n").distinct().collect()]  # at most `least` values
    if not sizes:
        return e.select("evidence_id", F.lit(None).cast("string").alias("chunk_id"), F.lit(0).alias("matched"), F.lit(0.0).alias("coverage"), F.lit(False).alias("is_relevant")).where("false")
    a = grams(e, ["evidence_id", "total", "n", *same], "tokens", "n").withColumnRenamed("pos", "i")
    b = grams(c.withColumn("n", F.explode(F.array(*[F.lit(s) for s in sizes]))), ["chunk_id", "n", *same], "tokens", "n").withColumnRenamed("pos", "j")
    hits = b.join(a, ["gram", "n", *same]).select("evidence_id", "chunk_id", "total", "n", "i", (F.col("i") - F.col("j")).alias("diagonal")).distinct()
    run = W.partitionBy("evidence_id", "chunk_id", "diagonal").orderBy("i")
    islands = hits.withColumn("island", F.col("i") - F.row_number().over(run))
    runs = islands.groupBy("evidence_id", "chunk_id", "total", "n", "diagonal", "island").agg(F.count("*").alias("len"))
    out = runs.groupBy("evidence_id", "chunk_id", "total", "n").agg((F.max("len") + F.first("n") - 1).cast("int").alias("matched"))
    out = out.withColumn("coverage", F.col("matched") / F.col("total"))
    return out.select("evidence_id", "chunk_id", "matched", "coverage", ((F.col("coverage") >= coverage) & (F.col("matched") >= F.least(F.lit(least), F.col("total")))).alias("is_relevant"))


def gold_map(questions: DataFrame, matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(question_id, chunk_id, gain: best coverage) of relevant chunks, and the evidence (question_id, evidence_id) that has none.

    questions: question_id, evidence_id; unanswerable ones have no rows.
    """
    relevant = matches.where("is_relevant")
    gains = questions.join(relevant, "evidence_id").groupBy("question_id", "chunk_id").agg(F.max("coverage").alias("gain"))
    return gains, questions.join(relevant, "evidence_id", "left_anti")


def evidence_report(evidence: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: total, unmapped, avg, min and max of relevant chunks over the mapped evidence."""
    n = matches.where("is_relevant").groupBy("evidence_id").agg(F.count("*").alias("n"))
    every = evidence.select("evidence_id").join(n, "evidence_id", "left")
    return every.agg(F.count("*").alias("total"), F.count_if(F.col("n").isNull()).alias("unmapped"), F.avg("n").alias("avg_chunks"), F.min("n").alias("min_chunks"), F.max("n").alias("max_chunks"))


@F.pandas_udf(T.IntegerType())
def longest_common_run(a: pd.Series, b: pd.Series) -> pd.Series:
    """The exact longest common run of two token lists, however short."""
    return pd.Series([difflib.SequenceMatcher(None, list(x), list(y), autojunk=False).find_longest_match().size for x, y in zip(a, b, strict=True)])


def best_candidates(evidence: DataFrame, chunks: DataFrame, source: str) -> DataFrame:
    """For unmapped evidence, the chunk of its source with the greatest coverage; of equals the first by chunk_pos."""
    e = evidence.select("evidence_id", source, evidence_tokens(F.col("text")).alias("e"))
    c = chunks.select("chunk_id", "chunk_pos", source, evidence_tokens(without_breadcrumb(F.col("text"))).alias("c"))
    pairs = e.join(c, source).withColumn("matched", longest_common_run("e", "c")).withColumn("coverage", F.when(F.size("e") > 0, F.col("matched") / F.size("e")).otherwise(0.0))
    best = pairs.groupBy("evidence_id").agg(F.max_by(F.struct("chunk_id", "matched", "coverage"), F.struct("coverage", -F.col("chunk_pos"))).alias("b"))
    return best.select("evidence_id", "b.chunk_id", "b.matched", "b.coverage")

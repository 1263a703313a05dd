"""Mixing sources by temperature: shares to a power that bisection finds, then budgets of permuted blocks.

A source's share of all tokens, raised to an exponent from 0 (all alike) to 1 (as they are) and normalised, is its
weight. The exponent is the largest of two that bisection finds: the one whose weights' entropy is target_entropy
times the greatest, and the least at which no source is repeated more than max_repeats times. The budget in tokens
is given, or `extra` times the least that lets every source pass once, so that no document is lost.

A source's documents are dealt to blocks by a hash; pass by pass, the blocks follow in an order of their own, and
the last pass ends where the budget does, within a block at a document. position is a row's place in its source's
stream from 0 to 1: ordered by it, all sources run out together.

Defined results: a null source is a source of its own; a null text has no tokens; a source without tokens passes
once; repeated rows stay, and equal ones are taken or left together. The driver gathers one row a source; a source
has at most max_blocks blocks, which bounds every window but those over the documents of single blocks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sedge.llm.common import WORD

ROUNDS = 60


@dataclass(frozen=True)
class Mix:
    """max_repeats: most passes over any source; block_tokens: tokens of a block, or more where max_blocks bind."""

    target_entropy: float = 0.97
    max_repeats: float = 2.0
    budget: int | None = None
    extra: float = 1.0
    block_tokens: int = 1 << 14
    max_blocks: int = 1 << 12
    seed: int = 17


def weights(tokens: list[int], exponent: float) -> list[float]:
    total = sum(tokens)
    powers = [(t / total) ** exponent for t in tokens]
    norm = sum(powers)
    return [p / norm for p in powers]


def entropy(w: list[float]) -> float:
    return -sum(x * math.log(x) for x in w if x > 0)


def least_budget(tokens: list[int], w: list[float]) -> float:
    return max(t / x for t, x in zip(tokens, w, strict=True))


def bisected(too_flat) -> float:
    """The least exponent from 0 to 1 that isn't too flat."""
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        middle = (low + high) / 2
        low, high = (middle, high) if too_flat(middle) else (low, middle)
    return high


def exponent(tokens: list[int], mix: Mix) -> float:
    def repeats(x: float) -> float:
        w = weights(tokens, x)
        budget = mix.extra * least_budget(tokens, w) if mix.budget is None else mix.budget
        return max(budget * a / t for a, t in zip(w, tokens, strict=True))

    most = math.log(len(tokens))
    return max(bisected(lambda x: entropy(weights(tokens, x)) > mix.target_entropy * most), bisected(lambda x: repeats(x) > mix.max_repeats))


def budgets(tokens: dict[str, int], mix: Mix) -> dict[str, tuple[float, int]]:
    """The weight and the budget in tokens of each source that has tokens."""
    names = sorted(k for k, n in tokens.items() if n > 0)
    if not names:
        return {}
    sizes = [tokens[k] for k in names]
    w = weights(sizes, exponent(sizes, mix))
    total = mix.extra * least_budget(sizes, w) if mix.budget is None else mix.budget
    return {k: (x, round(x * total)) for k, x in zip(names, w, strict=True)}


def hashed(*parts: Column) -> Column:
    """The first 32 bits of MD5 over the parts joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 8), 16, 10).cast("long")


def mixed_documents(df: DataFrame, mix: Mix = Mix(), doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """df's rows, each as often as its source's budget takes it, with _tokens, _pass, _block, _slot, _weight, _position; columns of the names used here are replaced."""
    spark = df.sparkSession
    seed = F.lit(str(mix.seed))
    df = df.drop("_tokens", "_source", "_key", "_blocks", "_block", "_pass", "_slot", "_end", "_weight", "_position")
    docs = df.withColumn("_tokens", F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")).withColumn("_source", F.coalesce(F.col(source).cast("string"), F.lit("")))
    sizes = {r["_source"]: r["n"] for r in docs.groupBy("_source").agg(F.sum("_tokens").alias("n")).collect()}  # one row a source
    plan = budgets(sizes, mix)
    rows = []
    for name, n in sizes.items():
        weight, budget = plan.get(name, (0.0, 0))
        blocks = min(mix.max_blocks, max(1, -(-n // mix.block_tokens)))
        full, rest = divmod(budget, n) if n else (1, 0)
        rows += [(name, weight, max(budget, 1), n, blocks, p, n if p < full else rest) for p in range(full + (rest > 0))]
    passes = spark.createDataFrame(rows, "_source string, _weight double, _budget long, _all long, _blocks long, _pass int, _take long")
    # a few rows a source
    blocks = F.broadcast(passes.where("_pass = 0").select("_source", "_blocks"))
    docs = docs.join(blocks, "_source").withColumn("_key", hashed(seed, F.col(doc_id).cast("string"), F.col("_tokens").cast("string"))).withColumn("_block", F.pmod("_key", F.col("_blocks"))).drop("_blocks")
    order = hashed(seed, F.lit("block"), F.col("_pass").cast("string"), F.col("_source"), F.col("_block").cast("string"))
    in_pass = W.partitionBy("_source", "_pass").orderBy("_order", "_block")
    dealt = (
        docs.groupBy("_source", "_block").agg(F.sum("_tokens").alias("_size")).join(F.broadcast(passes.drop("_blocks")), "_source").withColumn("_order", order)
        .withColumn("_slot", F.row_number().over(in_pass) - 1)
        .withColumn("_before", F.sum("_size").over(in_pass) - F.col("_size"))
        .where((F.col("_before") < F.col("_take")) | (F.col("_all") == 0))
    )
    # the one block of a source's last pass in which its budget ends: its documents up to some key
    cut = dealt.where(F.col("_before") + F.col("_size") > F.col("_take")).select("_source", "_pass", "_block", (F.col("_take") - F.col("_before")).alias("_left"))
    by_key = W.partitionBy("_source", "_pass", "_block").orderBy("_key").rangeBetween(W.unboundedPreceding, 0)
    ends = (
        docs.select("_source", "_block", "_key", "_tokens").join(F.broadcast(cut), ["_source", "_block"]).withColumn("_sum", F.sum("_tokens").over(by_key))
        .groupBy("_source", "_pass", "_block").agg(F.coalesce(F.max(F.when(F.col("_sum") <= F.col("_left"), F.col("_key"))), F.lit(-1)).alias("_end"))
    )
    dealt = dealt.join(F.broadcast(ends), ["_source", "_pass", "_block"], "left").withColumn("_end", F.coalesce("_end", F.lit(1 << 32)))
    dealt = dealt.withColumn("_position", F.round((F.col("_pass") * F.col("_all") + F.col("_before")) / F.col("_budget"), 9))
    dealt = dealt.select("_source", "_block", "_pass", "_slot", "_end", F.round("_weight", 9).alias("_weight"), "_position")
    return docs.join(dealt, ["_source", "_block"]).where(F.col("_key") <= F.col("_end")).drop("_source", "_key", "_end")


SQL = """
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n FROM documents),
s AS (SELECT source, sum(n)::BIGINT AS n FROM d GROUP BY source),
p AS (SELECT source, n, n / (SELECT sum(n) FROM s) AS share FROM s WHERE n > 0),
be(i, lo, hi) AS (SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL SELECT i + 1, CASE WHEN flat THEN mid ELSE lo END, CASE WHEN flat THEN hi ELSE mid END FROM
  (SELECT i, lo, hi, (lo + hi) / 2 AS mid, (SELECT -sum(x / z * ln(x / z)) FROM (SELECT pow(share, (be.lo + be.hi) / 2) AS x, sum(pow(share, (be.lo + be.hi) / 2)) OVER () AS z FROM p)) > 0.97 * ln((SELECT count(*) FROM p)) AS flat FROM be WHERE i < 60)),
br(i, lo, hi) AS (SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL SELECT i + 1, CASE WHEN flat THEN mid ELSE lo END, CASE WHEN flat THEN hi ELSE mid END FROM
  (SELECT i, lo, hi, (lo + hi) / 2 AS mid, (SELECT max(pow(share, (br.lo + br.hi) / 2) / share) / min(pow(share, (br.lo + br.hi) / 2) / share) FROM p) * 1.25 > 2.0 AS flat FROM br WHERE i < 60)),
e AS (SELECT greatest((SELECT hi FROM be WHERE i = 60), (SELECT hi FROM br WHERE i = 60)) AS x),
w AS (SELECT source, n, pow(share, (SELECT x FROM e)) / (SELECT sum(pow(share, (SELECT x FROM e))) FROM p) AS weight FROM p),
b AS (SELECT s.source, s.n, coalesce(weight, 0) AS weight, greatest(1, least(4096, ceil(s.n / 16384)))::BIGINT AS blocks,
  coalesce(round_even(weight * (1.25 * (SELECT max(n / weight) FROM w)), 0), 0)::BIGINT AS budget FROM s LEFT JOIN w USING (source)),
ps AS (SELECT source, n, weight, greatest(budget, 1) AS budget, blocks, pass::INT AS pass, CASE WHEN n = 0 THEN 0 WHEN pass < budget // n THEN n ELSE budget % n END AS take
  FROM (SELECT *, unnest(generate_series(0, CASE WHEN n = 0 THEN 0 ELSE ceil(budget / n)::BIGINT - 1 END)) AS pass FROM b)),
k AS (SELECT d.*, ('0x' || substr(md5('17:' || doc_id || ':' || d.n), 1, 8))::BIGINT AS key, ('0x' || substr(md5('17:' || doc_id || ':' || d.n), 1, 8))::BIGINT % blocks AS block FROM d JOIN b USING (source)),
bs AS (SELECT k.source, k.block, sum(k.n)::BIGINT AS size FROM k GROUP BY ALL),
o AS (SELECT bs.*, ps.pass, ps.take, ps.n, ps.weight, ps.budget, ('0x' || substr(md5('17:block:' || pass || ':' || bs.source || ':' || block), 1, 8))::BIGINT AS ord FROM bs JOIN ps USING (source)),
c AS (SELECT *, row_number() OVER (PARTITION BY source, pass ORDER BY ord, block) - 1 AS slot, sum(size) OVER (PARTITION BY source, pass ORDER BY ord, block ROWS UNBOUNDED PRECEDING) - size AS before FROM o),
t AS (SELECT * FROM c WHERE before < take OR n = 0),
r AS (SELECT k.doc_id, k.source, k.n AS n_tokens, t.pass, k.block, t.slot::INT AS slot, round(t.weight, 9) AS weight, round((t.pass * t.n + t.before) / t.budget, 9)::DOUBLE AS position,
  t.before + t.size > t.take AND t.n > 0 AS is_cut, t.take - t.before AS room, sum(k.n) OVER (PARTITION BY k.source, t.pass, k.block ORDER BY k.key RANGE UNBOUNDED PRECEDING) AS upto
  FROM k JOIN t USING (source, block))
SELECT doc_id, source, n_tokens, pass, block, slot, weight, position FROM r WHERE NOT is_cut OR upto <= room
"""

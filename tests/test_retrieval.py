"""Vectors, BM25, evidence, metrics and plans against plain versions."""

import difflib
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedge.operators import bm25, display, embed, evidence, metrics, qa, vectors
from sedge.plans import cli, evaluate, index
from sedge.streaming import ingest


def points(spark, n=60, d=5, seed=1):
    r = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in r.normal(size=d)]) for i in range(n)]
    rows[3] = (3, rows[2][1])
    rows[4] = (4, [0.0] * d)
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>")


@pytest.mark.parametrize("distance", vectors.DISTANCES)
def test_top_k(spark, distance):
    rows, df = points(spark)
    q = df.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in vectors.top_k(q, df, 7, distance).collect()}
    m = np.array([x for _, x in rows], np.float32).astype(float)
    for i in range(0, 60, 10):
        a = m[i]
        s = {"cosine": lambda b, a=a: a @ b / ((np.linalg.norm(a) or 1) * (np.linalg.norm(b) or 1)), "dot": lambda b, a=a: a @ b, "euclidean": lambda b, a=a: -np.linalg.norm(a - b)}[distance]
        want = sorted(((s(m[j]), j) for j in range(60)), reverse=True)[:7]
        assert [got[i, k + 1][0] for k in range(7)] == [j for _, j in want]
        assert all(abs(got[i, k + 1][1] - x) < 1e-9 for k, (x, _) in enumerate(want))
    full = vectors.ranked(vectors.all_scores(q, df, distance)).where("rank <= 7").collect()
    assert {(r["query_id"], r["rank"]): r["vec_id"] for r in full} == {k: v[0] for k, v in got.items()}


@pytest.mark.parametrize("distance", vectors.DISTANCES)
@pytest.mark.parametrize("most", [vectors.MOST_BROADCAST, 64])
def test_first_relevant_ranks(spark, monkeypatch, distance, most):
    monkeypatch.setattr(vectors, "MOST_BROADCAST", most)  # 64: several blocks of queries, each written
    _, df = points(spark)
    q = df.where("vec_id % 7 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    gold = q.select("query_id").crossJoin(df.select("vec_id")).where("vec_id % 13 = query_id % 13 and query_id != 21")
    scores = vectors.all_scores(q, df, distance).where("query_id != vec_id").withColumn("score", F.round("score", 9))
    every = {(r["query_id"], r["vec_id"]): r["rank"] for r in vectors.ranked(scores).collect()}
    want: dict = {}
    for r in gold.where("query_id != vec_id").collect():
        rank = every[r["query_id"], r["vec_id"]]
        want[r["query_id"]] = min(rank, want.get(r["query_id"], rank))
    got = {r["query_id"]: r["rank"] for r in vectors.first_relevant_ranks(q, df, gold, distance).collect()}
    assert got == want and len(got) > 5
    assert vectors.first_relevant_ranks(q, df, gold.limit(0), distance).count() == 0
    top = {(r["query_id"], r["rank"]): r["vec_id"] for r in vectors.top_k(q, df, 7, distance).collect()}
    full = vectors.ranked(vectors.all_scores(q, df, distance)).where("rank <= 7").collect()
    assert top == {(r["query_id"], r["rank"]): r["vec_id"] for r in full}


def test_experiment_equals_a_full_ranking(spark):
    r = np.random.default_rng(5)
    vector = lambda: [float(x) for x in r.normal(size=4)]
    chunks = [(f"c{i}", vector()) for i in range(80)]
    chunks[9] = ("c9", chunks[8][1])
    asked = [(f"q{i}", vector()) for i in range(12)]
    asked[5] = ("q5", chunks[8][1])  # its two nearest chunks tie
    queries = spark.createDataFrame(asked, "query_id string, embedding array<float>")
    points_ = spark.createDataFrame(chunks, "chunk_id string, embedding array<float>")
    rows = spark.createDataFrame([(f"q{i}", i % 4 > 0) for i in range(12)], "id string, answerable boolean")
    gold = spark.createDataFrame([(f"q{i}", f"e{j}", f"c{int(r.integers(80))}", 1.0) for i in range(10) if i % 4 for j in range(2)], "query_id string, evidence_id string, chunk_id string, gain double")
    found, top = evaluate.experiment(rows, queries, points_, gold, (1, 3))
    full = vectors.ranked(vectors.all_scores(queries, points_, point="chunk_id"), "chunk_id")
    want = metrics.question_metrics(full.join(rows.where("answerable"), F.col("id") == F.col("query_id"), "left_semi"), gold, (1, 3))
    plain = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in x) for x in df.select(sorted(df.columns)).collect())
    assert plain(found) == plain(want)
    assert any(0 < x["rr"] < 1 / 3 for x in found.collect())
    best = full.where("rank = 1").select("query_id", "score", "chunk_id")
    assert plain(top.drop("is_ood")) == plain(best)
    assert {x["query_id"] for x in top.where("is_ood").collect()} == {"q0", "q4", "q8"}


def test_top_k_rejects(spark):
    _, df = points(spark)
    q = df.select(F.col("vec_id").alias("query_id"), "embedding")
    with pytest.raises(ValueError):
        vectors.top_k(q, df, 0)
    with pytest.raises(ValueError):
        vectors.top_k(q, df, 1, "manhattan")
    assert vectors.top_k(q.limit(0), df, 3).count() == 0


def test_vector_report(spark):
    rows = [(1, [1.0, 2.0]), (1, [float("nan"), 1.0]), (2, [1.0]), (3, None), (4, [float("inf"), 0.0])]
    r = vectors.vector_report(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).first()
    assert (r["n"], r["n_null"], r["n_wrong_dim"], r["n_not_finite"], r["dim"], r["n_duplicate_ids"]) == (5, 1, 1, 2, 2, 1)


def test_store(spark, tmp_path):
    config = vectors.StoreConfig("c", 2, path=f"file://{tmp_path}")
    chunks = spark.createDataFrame([("a::0", "t0", [1.0, 0.0]), ("a::1", "t1", [0.0, 1.0])], "chunk_id string, text string, embedding array<float>")
    store = vectors.VectorStore(spark, config).add(chunks)
    store.persist()
    store = vectors.VectorStore(spark, config).load().add(chunks.where("chunk_id = 'a::1'").withColumn("text", F.lit("new")), version=1)
    assert store.info().first()["points_count"] == 2
    hit = store.search(spark.createDataFrame([(7, [0.1, 1.0])], "query_id long, embedding array<float>"), 1).first()
    assert (hit["query_id"], hit["chunk_id"], hit["text"]) == (7, "a::1", "new")
    with pytest.raises(ValueError):
        store.compatible(3, "cosine")
    with pytest.raises(ValueError):
        store.add(chunks.withColumn("embedding", F.array(F.lit(1.0).cast("float"))))
    with pytest.raises(ValueError):
        store.add(chunks.withColumn("chunk_id", F.lit("same")))
    with pytest.raises(ValueError):
        vectors.StoreConfig("c", 2, "manhattan")


def test_bm25(spark):
    texts = ["the cat sat on the mat", "the dog sat", "cats and dogs", "a cat a cat a cat", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    posted, stats = bm25.postings(docs), bm25.corpus_stats(docs)
    terms = bm25.term_stats(posted, stats)
    got = {r["doc_id"]: r["score"] for r in bm25.bm25_scores(spark.createDataFrame([(1, "cat the")], "query_id long, text string"), posted, terms, stats).collect()}
    words = [t.split() for t in texts]
    n, avg = len(words), sum(map(len, words)) / len(words)
    df = {t: sum(t in w for w in words) for w in words for t in w}
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: 0.25 * mean if x < 0 else x for t, x in idf.items()}
    for d, w in enumerate(words):
        want = sum(idf[t] * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / avg)) for t in ("cat", "the"))
        assert abs(got.get(d, 0) - want) < 1e-9


def test_evidence(spark):
    r = random.Random(1)
    ev = [(i, " ".join(r.choices("abcdefg", k=r.randint(3, 25)))) for i in range(12)]
    ch = [(j, " ".join(r.choices("abcdefg", k=30)) + " " + ev[j % 12][1][: r.randint(5, 50)] + " tail") for j in range(20)]
    e, c = spark.createDataFrame(ev, "evidence_id long, text string"), spark.createDataFrame(ch, "chunk_id long, text string")
    got = {(x["evidence_id"], x["chunk_id"]): (x["matched"], x["is_relevant"]) for x in evidence.evidence_matches(e, c).collect()}
    for i, a in ev:
        for j, b in ch:
            x, y = a.split(), b.split()
            size = difflib.SequenceMatcher(None, x, y, autojunk=False).find_longest_match().size
            need = min(8, len(x))
            assert ((i, j) in got) == (size >= need)
            if size >= need:
                assert got[i, j] == (size, size / len(x) >= 0.3)
    best = evidence.best_candidates(e.withColumn("s", F.lit("x")), c.withColumn("s", F.lit("x")).withColumn("chunk_pos", F.col("chunk_id")), "s").collect()
    assert len(best) == 12


def test_metrics(spark):
    ranks = spark.createDataFrame([(1, c, i + 1) for i, c in enumerate("abcdef")] + [(2, c, i + 1) for i, c in enumerate("fedcba")] + [(3, "a", 1)], "query_id long, chunk_id string, rank int")
    gold = spark.createDataFrame([(1, "e1", "b", 1.0), (1, "e1", "c", 0.5), (1, "e2", "f", 0.4), (2, "e3", "z", 1.0)], "query_id long, evidence_id string, chunk_id string, gain double")
    got = {(r["query_id"], r["k"]): r for r in metrics.question_metrics(ranks, gold, (3, 10)).collect()}
    a = got[1, 3]
    assert (a["recall"], a["hit"], a["complete"], a["precision"], a["rr"]) == (0.5, 1, 0, 2 / 3, 0.5)
    want = (1 / math.log2(3) + 0.5 / 2) / (1 + 0.5 / math.log2(3) + 0.4 / 2)
    assert abs(a["ndcg"] - want) < 1e-12 and got[1, 10]["complete"] == 1
    assert [got[2, 10][m] for m in ("recall", "precision", "ndcg", "rr")] == [0, 0, 0, 0] and got[3, 3]["recall"] == 0
    wide = metrics.wide(metrics.recall_metrics(ranks, gold, (3, 10)), ["recall"], (3, 10))
    assert {r["query_id"]: r["recall_at_3"] for r in wide.collect()} == {1: 0.5, 2: 0.0, 3: 0.0}


@pytest.mark.parametrize("seed", range(3))
def test_auroc(spark, seed):
    r = random.Random(seed)
    rows = [(r.randint(0, 8) / 4, r.random() < 0.4) for _ in range(40)]
    ood, ind = [s for s, o in rows if o], [s for s, o in rows if not o]
    want = sum((a < b) + (a == b) / 2 for a in ood for b in ind) / (len(ood) * len(ind))
    assert abs(metrics.auroc(spark.createDataFrame(rows, "score double, is_ood boolean")).first()[0] - want) < 1e-12
    assert metrics.auroc(spark.createDataFrame([(1.0, True)], "score double, is_ood boolean")).first()[0] is None
    assert metrics.auroc(spark.createDataFrame([], "score double, is_ood boolean")).first()[0] is None


def test_auroc_of_many_scores(spark):
    """More distinct scores than parts."""
    r = random.Random(5)
    rows = [(round(r.gauss(float(o), 1), 3), o) for o in (r.random() < 0.3 for _ in range(3000))]
    ood, ind = [s for s, o in rows if o], [s for s, o in rows if not o]
    want = sum((a < b) + (a == b) / 2 for a in ood for b in ind) / (len(ood) * len(ind))
    assert abs(metrics.auroc(spark.createDataFrame(rows, "score double, is_ood boolean")).first()[0] - want) < 1e-12


def test_display(spark):
    hits = spark.createDataFrame([(1, 1, "s", "x"), (1, 2, "s", "x"), (1, 3, "t", None)], "query_id long, rank int, source string, section string")
    assert [(r["number"], r["label"]) for r in display.numbered_sources(hits).orderBy("number").collect()] == [(1, "s § x"), (2, "t")]


def test_assert_valid(spark):
    chunks = spark.createDataFrame([("a", "t"), ("b", "u")], "chunk_id string, text string")
    vec = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0, 0.0])], "chunk_id string, embedding array<double>")
    qa.assert_valid(chunks, vec, 2, k=3, distance="dot")
    for bad in (dict(chunks=chunks.limit(0)), dict(chunks=chunks.drop("text")), dict(chunks=chunks.union(chunks)), dict(chunks=chunks, vectors=vec.limit(1)), dict(chunks=chunks, vectors=vec, dim=3), dict(chunks=chunks, k=0), dict(chunks=chunks, distance="x"), dict(chunks=chunks, unmapped=chunks)):
        with pytest.raises(ValueError):
            qa.assert_valid(**bad)


def test_embedders(spark):
    calls = []

    def encode(texts):
        calls.append(len(texts))
        if len(texts) > 2:
            raise MemoryError
        return np.ones((len(texts), 3))

    assert embed.encode_with_retry(encode, list("abcde"), embed.EmbedderConfig("m", 8)).shape == (5, 3) and max(calls) == 5
    df = spark.createDataFrame([("same words",), ("same words",), (None,)], "text string")
    v = [r["embedding"] for r in embed.embedded(df, embed.hashing_embedder(8), model="e5-x").collect()]
    assert v[0] == v[1] and abs(sum(x * x for x in v[0]) - 1) < 1e-5
    assert embed.embedder_config("BAAI/bge-m3").batch_size == 32 and embed.embedder_config("x").model == "x"


QUESTION = {"id": "q1", "question": "what is written in alpha", "answerable": True, "split": "dev", "source_doc_tag": "A", "benchmark_group": "standard", "gold_evidence": [{"evidence_id": "e1", "source_file": "a.md", "evidence_text": "alpha beta gamma delta epsilon zeta eta theta iota"}]}


def test_plans(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "a.md").write_text("<h1>Alpha</h1><p>alpha beta gamma delta epsilon zeta eta theta iota kappa</p>")
    (raw / "b.md").write_text("<h1>Other</h1><p>nothing of that is written here at all today</p>")
    base = f"file://{tmp_path}"
    cli.main(["load", f"{base}/raw", f"{base}/out", "--pattern", "*.md"])
    docs = spark.read.parquet(f"{base}/out/documents")
    assert docs.count() == 2 and docs.where("status = 'success'").count() == 2
    cli.main(["clean", f"{base}/out", f"{base}/out"])
    cli.main(["chunk", "--cleaned-dir", f"{base}/out", "--output-dir", f"{base}/out", "--max-tokens", "64"])
    cli.main(["build", "--chunks-dir", f"{base}/out", "--local-path", f"{base}/index", "--expected-dim", "16"])
    manifest = json.loads(spark.read.text(f"{base}/index/manifest").first()[0])
    assert manifest["store"]["points"] == 2 and manifest["embedding"]["dim"] == 16
    ood = QUESTION | {"id": "q2", "question": "zzz yyy", "answerable": False, "gold_evidence": []}
    (tmp_path / "q.json").write_text(json.dumps([QUESTION, ood, QUESTION | {"id": "q3", "split": "test"}]))
    cli.main(["evaluate", "--chunks-dir", f"{base}/out", "--questions", f"{base}/q.json", "--output-dir", f"{base}/eval", "--expected-dim", "16"])
    rows = spark.read.option("header", True).csv(f"{base}/eval/comparison").collect()
    assert {r["chunker"] for r in rows} == {"hierarchical", "semantic"} and all(float(r["recall_at_10"]) == 1 for r in rows)
    by_question = spark.read.option("header", True).csv(f"{base}/eval/per_question")
    assert by_question.columns == list(index.PER_QUESTION) and by_question.count() == 4
    q1 = by_question.where("question_id = 'q1' and chunker = 'semantic'").first()
    assert float(q1["recall@3"]) == 1 and q1["top_chunk_source"] and by_question.where("question_id = 'q2'").first()["recall@3"] is None
    by_group = spark.read.option("header", True).csv(f"{base}/eval/per_group")
    assert by_group.columns == list(index.PER_GROUP) and {(r["group_type"], r["group_value"]) for r in by_group.collect()} == {("overall", "overall"), ("doc", "A"), ("group", "standard")}
    lost = QUESTION | {"gold_evidence": [{"evidence_id": "e9", "source_file": "a.md", "evidence_text": "alpha beta unheard words that no chunk has"}]}
    (tmp_path / "lost.json").write_text(json.dumps([lost, ood]))
    cli.main(["evaluate", "--chunks-dir", f"{base}/out", "--questions", f"{base}/lost.json", "--output-dir", f"{base}/lost", "--expected-dim", "16"])
    r = json.loads(spark.read.text(f"{base}/lost/unmapped_semantic").first()[0])
    assert r["evidence_id"] == "e9" and r["matched"] == 2 and r["chunk_id"]
    assert manifest["bm25"]["tokenizer"] == "whitespace"
    with pytest.raises(ValueError, match="embed by"):
        cli.main(["build", "--chunks-dir", f"{base}/out", "--local-path", f"{base}/index", "--model", "BAAI/bge-m3"])
    with pytest.raises(ValueError, match="chunk_index"):
        index.chunk_table(spark, f"{base}/out/documents")
    store = vectors.VectorStore(spark, vectors.StoreConfig("chunks", 16, path=f"{base}/index"))
    assert store.exists() and store.load().points.count() == 2
    with pytest.raises(ValueError, match="holds"):
        vectors.VectorStore(spark, vectors.StoreConfig("chunks", 8, path=f"{base}/index")).load()
    with pytest.raises(ValueError):
        evaluate.questions(spark, f"{base}/q.json", "none")
    assert index.table_digest(docs, "source").first() == index.table_digest(docs.repartition(3), "source").first()


def test_ingest(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    base = f"file://{tmp_path}"
    for n, text in enumerate(("# A\nfirst text", "# A\nsecond text")):
        (landing / f"{n}.json").write_text(json.dumps({"source": "a", "text": text}) + "\n")
        ingest.ingest(spark, f"{base}/in", f"{base}/chunks", f"{base}/check").awaitTermination(60)
    assert [r["text"] for r in ingest.current_chunks(spark, f"{base}/chunks").collect()] == ["[A]\n# A\nsecond text"]

"""DuckDB SQL for the catalog's queries: independent statements over the same tables, with the same columns."""

from __future__ import annotations

PAIRS = """q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v, label FROM embeddings WHERE vec_id % 100 = 0),
p AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings)"""

SCORES = {"cosine": "list_cosine_similarity(q.v, p.v)", "dot": "list_dot_product(q.v, p.v)", "euclidean": "-list_distance(q.v, p.v)"}


def topk(distance: str) -> str:
    return f"""WITH {PAIRS}, s AS (SELECT query_id, vec_id, {SCORES[distance]} AS score FROM q, p),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id DESC) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, round(score, 6) + 0.0 AS score FROM r WHERE rank <= 15"""


RANKS = f"""WITH {PAIRS}, s AS (SELECT query_id, vec_id AS chunk_id, list_cosine_similarity(q.v, p.v) AS score FROM q, p WHERE query_id <> vec_id),
ranks AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id DESC) AS rank FROM s QUALIFY rank <= 30),
gold AS (SELECT query_id, p.vec_id AS chunk_id, CASE WHEN p.vec_id % 2 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS gain, p.vec_id % 7 AS ev FROM q JOIN p USING (label) WHERE query_id <> p.vec_id),
ks AS (SELECT unnest([3, 5, 10, 15, 20, 30])::INT AS k),
qs AS (SELECT DISTINCT query_id FROM ranks),
tot AS (SELECT query_id, count(DISTINCT ev) AS tot FROM gold GROUP BY query_id),
hit AS (SELECT query_id, k, count(*) AS hits, count(DISTINCT ev) AS ev, sum(gain / log2(rank + 1)) AS dcg FROM ranks JOIN gold USING (query_id, chunk_id), ks WHERE rank <= k GROUP BY ALL),
seen AS (SELECT query_id, k, count(*) AS seen FROM ranks, ks WHERE rank <= k GROUP BY ALL),
best AS (SELECT query_id, k, sum(gain / log2(n + 1)) AS idcg FROM (SELECT query_id, gain, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, chunk_id) AS n FROM gold), ks WHERE n <= k GROUP BY ALL),
m AS (SELECT query_id, k, coalesce(hits, 0) AS hits, coalesce(ev, 0) / tot AS rec, seen, coalesce(dcg, 0) AS dcg, idcg FROM seen LEFT JOIN hit USING (query_id, k) LEFT JOIN best USING (query_id, k) LEFT JOIN tot USING (query_id)),
f AS (SELECT query_id, min(n) AS first_rank FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id DESC) AS n FROM s) JOIN gold USING (query_id, chunk_id) GROUP BY query_id)"""
#: Of the evidences of a query (its label's vectors by id modulo 7) those found; any; all.
RECALL, HIT, COMPLETE = "rec", "(rec > 0)::INT::DOUBLE", "(rec = 1)::INT::DOUBLE"
SIMILAR = "o AS (SELECT q.query_id, round(max(list_cosine_similarity(q.v, p.v)), 9) AS score, any_value(q.label) >= 8 AS is_ood FROM q, p WHERE query_id <> vec_id AND p.label < 8 GROUP BY q.query_id)"
AUROC = "(SELECT avg(CASE WHEN a.score < b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END) FROM o a, o b WHERE a.is_ood AND NOT b.is_ood)"

TOKENS = r"""regexp_extract_all(regexp_replace(regexp_replace(lower(nfc_normalize(coalesce(text, ''))), '[–—]', '-', 'g'), '[#*_`>|]+', ' ', 'g'), '[\p{L}\p{N}_]+(?:[.,]\p{Nd}+)?|>=|<=|≥|≤|>|<|%')"""
MATCHES = f"""WITH e AS (SELECT item_id AS evidence_id, {TOKENS} AS t FROM benchmark), c AS (SELECT doc_id AS chunk_id, {TOKENS} AS t FROM documents),
en AS (SELECT evidence_id, len(t) AS total, least(8, len(t)) AS n, t, unnest(generate_series(1, len(t) - least(8, len(t)) + 1)) AS i FROM e WHERE len(t) > 0),
eg AS (SELECT evidence_id, total, n, i, array_to_string(t[i:i + n - 1], ' ') AS g FROM en),
cn AS (SELECT chunk_id, n, t, unnest(generate_series(1, len(t) - n + 1)) AS j FROM c, (SELECT DISTINCT n FROM en) WHERE len(t) >= n),
cg AS (SELECT chunk_id, n, j, array_to_string(t[j:j + n - 1], ' ') AS g FROM cn),
h AS (SELECT DISTINCT evidence_id, chunk_id, total, n, i, i - j AS d FROM eg JOIN cg USING (n, g)),
r AS (SELECT *, i - row_number() OVER (PARTITION BY evidence_id, chunk_id, d ORDER BY i) AS island FROM h),
l AS (SELECT evidence_id, chunk_id, total, n, count(*) AS len FROM r GROUP BY evidence_id, chunk_id, total, n, d, island),
x AS (SELECT evidence_id, chunk_id, total, (max(len) + n - 1)::INT AS matched FROM l GROUP BY evidence_id, chunk_id, total, n),
m AS (SELECT evidence_id, chunk_id, matched, matched / total AS coverage, matched / total >= 0.3 AND matched >= least(8, total) AS is_relevant FROM x)"""

BM25 = r"""WITH d AS (SELECT doc_id, source, lang, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda w: w <> '') AS w FROM documents),
st AS (SELECT count(*) AS n_docs, avg(len(w)) AS avgdl FROM d),
pt AS (SELECT term, doc_id, doc_len, count(*) AS tf FROM (SELECT doc_id, len(w) AS doc_len, unnest(w) AS term FROM d) GROUP BY ALL),
raw AS (SELECT term, count(*) AS df, ln((SELECT n_docs FROM st) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM pt GROUP BY term),
tm AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
qt AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')) AS term FROM benchmark) GROUP BY ALL),
sc AS (SELECT query_id, doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * doc_len / (SELECT avgdl FROM st)))) AS score FROM pt JOIN tm USING (term) JOIN qt USING (term) GROUP BY ALL),
top AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc QUALIFY rank <= 15)"""

PLAIN = r"""list_filter(list_transform(string_split(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: regexp_replace(regexp_replace(x, '[ \t]{2,}', ' ', 'g'), '\s+$', '')), lambda x: NOT regexp_matches(x, '(?i)\.{8,}\s*(\d{1,4}|[ivxlcdm]{1,6})\s*\|?\s*$') AND NOT regexp_matches(x, '^[\s|]*\.{5,}[\s|]*$'))"""

#: What cleaning leaves of texts without markup, which the shared documents are.
CLEANED = rf"""SELECT doc_id, regexp_replace(regexp_replace(array_to_string(x, chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') || chr(10) AS t FROM (SELECT doc_id, {PLAIN} AS x FROM documents)"""

SQL: dict[str, str] = {
    "vector_topk_cosine": topk("cosine"),
    "vector_topk_dot": topk("dot"),
    "vector_topk_euclidean": topk("euclidean"),
    "vector_validate": """SELECT count(*) AS n, count(*) FILTER (embedding IS NULL) AS n_null, count(*) FILTER (len(embedding) <> (SELECT max(len(embedding)) FROM embeddings)) AS n_wrong_dim,
count(*) FILTER (len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0) AS n_not_finite, max(len(embedding))::INT AS dim, count(*) - count(DISTINCT vec_id) AS n_duplicate_ids FROM embeddings""",
    "rank_recall_precision_hit": f"{RANKS} SELECT query_id, k, round({RECALL}, 6) AS recall, {HIT} AS hit, {COMPLETE} AS complete, round(hits / seen, 6) AS precision FROM m",
    "rank_mrr": f"{RANKS} SELECT query_id, first_rank, round(1 / first_rank, 6) AS rr FROM f",
    "rank_ndcg": f"{RANKS} SELECT query_id, k, round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END, 6) AS ndcg FROM m",
    "rank_group_slices": f"""{RANKS}, x AS (SELECT m.*, hits / seen AS precision, {RECALL} AS recall, {HIT} AS hit, {COMPLETE} AS complete, label FROM m JOIN (SELECT query_id, label FROM q) USING (query_id)),
y AS (SELECT 'overall' AS "group", * FROM x UNION ALL SELECT 'label:' || label, * FROM x UNION ALL SELECT 'even', * FROM x WHERE query_id % 200 = 0)
SELECT "group", k, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(hit), 6) AS hit, round(avg(complete), 6) AS complete, round(avg(precision), 6) AS precision FROM y GROUP BY "group", k""",
    "rank_wide": f"""{RANKS} SELECT query_id, {", ".join(f"round(max(CASE WHEN k = {k} THEN {RECALL} END), 6) AS recall_at_{k}, round(max(CASE WHEN k = {k} THEN hits / seen END), 6) AS precision_at_{k}" for k in (3, 5, 10, 15, 20, 30))} FROM m GROUP BY query_id""",
    "ood_auroc": f"WITH {PAIRS}, {SIMILAR} SELECT round({AUROC}, 6) AS auroc",
    "experiment_comparison": f"""{RANKS}, {SIMILAR},
rr AS (SELECT query_id, min(rank) AS r FROM ranks JOIN gold USING (query_id, chunk_id) GROUP BY query_id),
a AS (SELECT avg({RECALL}) AS rec, avg({HIT}) AS hit, avg({COMPLETE}) AS com, avg(hits / seen) AS prec, avg(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END) AS nd FROM m WHERE k = 10),
b AS (SELECT avg(coalesce(1 / r, 0)) AS mrr FROM qs LEFT JOIN rr USING (query_id)),
t AS (SELECT avg(score) FILTER (NOT is_ood) AS i, avg(score) FILTER (is_ood) AS u FROM o)
SELECT unnest(['cosine', 'dot']) AS model, round(rec, 6) AS recall_at_10, round(hit, 6) AS hit_at_10, round(com, 6) AS complete_at_10, round(prec, 6) AS precision_at_10, round(nd, 6) AS ndcg_at_10, round(mrr, 6) AS mrr,
round(i, 6) AS top1_id, round(u, 6) AS top1_ood, round({AUROC}, 6) AS auroc, round(i - u, 6) AS margin FROM a, b, t""",
    "evidence_tokens": f"SELECT doc_id, len(t)::INT AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {TOKENS} AS t FROM documents)",
    "evidence_match": f"{MATCHES} SELECT evidence_id, chunk_id, matched, round(coverage, 6) AS coverage, is_relevant FROM m",
    "evidence_report": f"""{MATCHES}, k AS (SELECT e.evidence_id, count(m.chunk_id) AS n FROM e LEFT JOIN m ON m.evidence_id = e.evidence_id AND m.is_relevant GROUP BY e.evidence_id)
SELECT count(*) AS total, count(*) FILTER (n = 0) AS unmapped, round(avg(n) FILTER (n > 0), 6) AS avg_chunks, min(n) FILTER (n > 0) AS min_chunks, max(n) FILTER (n > 0) AS max_chunks FROM k""",
    "gold_relevance": f"{MATCHES} SELECT evidence_id // 5 AS question_id, chunk_id, round(max(coverage), 6) AS gain FROM m WHERE is_relevant GROUP BY ALL",
    "bm25_index_stats": f"{BM25} SELECT least(df, 64)::BIGINT AS df_up_to_64, count(*) AS n_terms, sum(df)::BIGINT AS n_postings, sum(length(term))::BIGINT AS n_chars, min(term) AS first_term, round(min(idf), 6) AS least_idf, round(max(idf), 6) AS most_idf FROM tm GROUP BY ALL",
    "bm25_topk": f"{BM25} SELECT query_id, rank::INT AS rank, doc_id, round(score, 4) AS score FROM top",
    "hybrid_rrf": f"""{BM25}, lg AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY length(text) DESC, doc_id) AS rank FROM top JOIN documents USING (doc_id)),
a AS (SELECT query_id, doc_id, rank FROM top UNION ALL SELECT * FROM lg) SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM a GROUP BY ALL""",
    "dedupe_sources": f"""{BM25}, l AS (SELECT query_id, d.source || ' § ' || d.lang AS label, min(rank) AS f FROM top JOIN d USING (doc_id) GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY f, label)::INT AS number, label FROM l""",
    "point_ids": """SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || lower(to_hex(('0x' || substr(h, 17, 2))::INT & 63 | 128)) || substr(h, 19, 2) || '-' || substr(h, 21, 12) AS point_id
FROM (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(source || '::' || doc_id)) AS h FROM documents)""",
    "upsert_latest": """SELECT key, doc_id FROM (SELECT source || '::' || lang AS key, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY length(text) * 1000000 + doc_id DESC, doc_id % 2 DESC) AS n FROM documents) WHERE n = 1""",
    "clean_lines": f"SELECT doc_id, len(x)::BIGINT AS n_lines, len(list_filter(x, lambda y: y = ''))::BIGINT AS n_blank FROM (SELECT doc_id, {PLAIN} AS x FROM documents)",
    "clean_documents": f"SELECT doc_id, md5(t) AS text_md5 FROM ({CLEANED})",
    "clean_report": f"""SELECT doc_id, b::INT AS chars_before, length(t)::INT AS chars_after, 0 AS n_warnings, CASE WHEN b = 0 THEN 0.0 ELSE round((1 - length(t) / b) * 100, 2) + 0.0 END::DOUBLE AS reduction_pct
FROM (SELECT * FROM ({CLEANED}) JOIN (SELECT doc_id, length(coalesce(text, '')) AS b FROM documents) USING (doc_id))""",
    "token_length_stats": r"""WITH d AS (SELECT lang, source, len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]')) AS t, length(coalesce(text, '')) AS c FROM documents)
SELECT lang, source, count(*) AS n, round(avg(t), 4) AS avg_tokens, round(quantile_cont(t, 0.5), 4) AS median_tokens, round(quantile_cont(t, 0.95), 4) AS p95_tokens, min(t)::INT AS min_tokens, max(t)::INT AS max_tokens,
round(avg(c), 4) AS avg_chars, round(quantile_cont(c, 0.5), 4) AS median_chars, round(quantile_cont(c, 0.95), 4) AS p95_chars, min(c)::INT AS min_chars, max(c)::INT AS max_chars FROM d GROUP BY ROLLUP (lang, source)""",
    "session_history": """WITH n AS (SELECT conv_id, count(*) AS n_turns, arg_min(text, turn) FILTER (role = 'user') AS t FROM conversations GROUP BY conv_id)
SELECT conv_id, n_turns, substr(t, 1, 55) AS preview, row_number() OVER (ORDER BY conv_id DESC)::INT AS place FROM n ORDER BY conv_id DESC LIMIT 30""",
}

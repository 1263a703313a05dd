"""Documents with markup that a rule puts on their lines, so that queries over shared tables meet headings, bullets, tables and contents; and SQL for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What becomes of a line by (7 x doc_id + 5 x its place from 1) modulo 29; {l} is the line, {i} its place. Other lines stay.
FORMS = {
    0: "# {l}", 1: "## {l}", 2: "### {l}", 3: "## {i}.2. {l}", 4: "- A. {l}", 5: "- 1.{i} {l}", 6: "{i}. RULES FOR ALL", 7: "{i}. {l}", 8: "## ab", 9: "## MỤC LỤC",
    10: "{l} ......... 12", 11: "- - {l}", 12: "- -", 13: "| a | b |", 14: "", 15: "<!-- image -->", 16: "## Care of", 17: "  {l}", 18: "BỘ Y TẾ", 19: "{i}. Short one", 20: "**Figures {i}**",
}
CONNECTORS = ("of",)
#: After a line of these forms come more.
MORE = {13: ("|---|---|", "| 1 | 2 |", "| 3 |"), 20: ("", "| c | d |", "| :--- | ---: |", "| 5 | {i} |", "", "after")}


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, text."""

    def form(line: Column, place: Column) -> Column:
        kind = F.pmod(7 * F.col("doc_id") + 5 * (place + 1), F.lit(29))
        out = None
        for n, x in FORMS.items():
            whole = "\n".join([x, *MORE.get(n, ())])
            made = F.replace(F.replace(F.lit(whole), F.lit("{i}"), (place + 1).cast("string")), F.lit("{l}"), line)
            out = F.when(kind == n, made) if out is None else out.when(kind == n, made)
        return out.otherwise(line)

    return docs.select("doc_id", F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), form), "\n").alias("text"))


def sql_form() -> str:
    whole = {n: " || chr(10) || ".join(f"'{y}'" for y in (x, *MORE.get(n, ()))) for n, x in FORMS.items()}
    whens = " ".join(f"WHEN {n} THEN replace(replace({x}, '{{i}}', i::VARCHAR), '{{l}}', l)" for n, x in whole.items())
    return f"CASE (7 * doc_id + 5 * i) % 29 {whens} ELSE l END"


def trim(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def end(x: str) -> str:
    return rf"regexp_replace({x}, '\s+$', '')"


def boundary(p: str) -> str:
    return rf"({p} = '' OR regexp_matches({p}, '[.;:?!]\s*$') OR regexp_matches({p}, '^[-+]\s'))"


MARKED = f"""m0 AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
m1 AS (SELECT doc_id, replace(replace(string_agg({sql_form()}, chr(10) ORDER BY i), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text FROM m0 GROUP BY doc_id),
m2 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM m1)"""

O = "PARTITION BY doc_id ORDER BY n"
DANGLES = rf"""(ends_with({trim('title')}, '-') OR regexp_replace(lower(regexp_extract({trim('title')}, '(\S+)$', 1)), '^[.,:;]+|[.,:;]+$', '', 'g') IN ('of'))"""
SUFFIX = r"(?i)^#{1,6}\s+([a-z]{1,3})\s*$"
CLEAN = rf"""WITH {MARKED},
t1 AS (SELECT *, sum(regexp_matches(l, '^#{{1,6}}\s+\S')::INT) OVER ({O}) AS seg FROM m2),
t2 AS (SELECT *, min(n) FILTER (regexp_matches({trim('l')}, '(?i)^#{{1,2}}\s*MỤC LỤC\s*$')) OVER (PARTITION BY doc_id, seg) AS toc, max(n) FILTER (regexp_matches(l, '(?i)\.{{8,}}\s*(\d{{1,4}}|[ivxlcdm]{{1,6}})\s*\|?\s*$')) OVER (PARTITION BY doc_id, seg) AS dots FROM t1),
a AS (SELECT doc_id, l, row_number() OVER ({O}) AS n FROM t2 WHERE NOT coalesce(n >= toc AND dots > toc, false)),
b1 AS (SELECT *, lead(l) OVER ({O}) AS nx FROM a),
b2 AS (SELECT *, regexp_matches(l, '^#{{1,6}}\s+') AND coalesce(regexp_matches(nx, '{SUFFIX}'), false) AND NOT regexp_matches({end('l')}, '[.;:?!]\s*$') AS j FROM b1),
b3 AS (SELECT *, sum((NOT j)::INT) OVER ({O}) AS isl FROM b2),
b4 AS (SELECT *, first_value(j) OVER w AS fj, first_value(n) OVER w AS f FROM b3 WINDOW w AS (PARTITION BY doc_id, isl ORDER BY n)),
b5 AS (SELECT *, j AND (CASE WHEN fj THEN n - f ELSE n - f - 1 END) % 2 = 0 AS mg FROM b4),
b6 AS (SELECT *, coalesce(lag(mg) OVER ({O}), false) AS gone FROM b5),
b AS (SELECT doc_id, CASE WHEN mg THEN {end('l')} || regexp_extract(nx, '{SUFFIX}', 1) ELSE l END AS l, row_number() OVER ({O}) AS n FROM b6 WHERE NOT gone),
c1 AS (SELECT *, {trim('l')} AS s, {trim("coalesce(lag(l) OVER (" + O + "), '')")} AS p FROM b),
c2 AS (SELECT *, (regexp_matches(s, '^-\s+([IVXLCDM]{{2,4}}|[A-Z])\.\s+(\S.*)$') OR regexp_matches(s, '^-\s+(\d+(?:\.\d+)+)\.?\s+(\S.*)$')) AND {boundary('p')} AS hit FROM c1),
c AS (SELECT doc_id, n, CASE WHEN hit THEN '## ' || regexp_replace(substr(s, 3), '^\s+', '') ELSE l END AS l, hit, s FROM c2),
d1 AS (SELECT doc_id, n, l, {trim('l')} AS s, {trim("coalesce(lag(l) OVER (" + O + "), '')")} AS p FROM c),
d2 AS (SELECT *, regexp_matches(s, '^(\d+)\.\s+(\S.*)$') AS num, regexp_extract(s, '^(\d+)\.\s+(\S.*)$', 2) AS rest FROM d1),
d3 AS (SELECT *, regexp_replace(rest, '[^\p{{L}}]', '', 'g') AS let FROM d2),
d4 AS (SELECT *, CASE WHEN num AND let = upper(let) AND let <> lower(let) AND {boundary('p')} THEN 1 WHEN num AND p = '' AND len(list_filter(regexp_split_to_array(rest, '\s+'), lambda w: w <> '')) <= 8 AND length(rest) - length(replace(rest, '.', '')) <= 1 THEN 2 WHEN num AND {boundary('p')} THEN 3 ELSE 0 END AS k FROM d3),
d AS (SELECT doc_id, n, CASE k WHEN 1 THEN '## ' || s WHEN 2 THEN '### ' || s ELSE l END AS l, k, s FROM d4),
e1 AS (SELECT doc_id, n, l, {trim('l')} AS s, regexp_extract(l, '^(#{{1,6}})\s+(.*)$', 2) AS title FROM d),
e2 AS (SELECT *, first_value(CASE WHEN s <> '' THEN {{'n': n, 's': s}} END IGNORE NULLS) OVER ({O} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx FROM e1),
e3 AS (SELECT *, coalesce(regexp_matches(l, '^(#{{1,6}})\s+(.*)$') AND {DANGLES} AND nx.n > n + 1, false) AS gap FROM e2),
e4 AS (SELECT *, gap AND NOT regexp_matches(nx.s, '^[#\-+|]') AND len(list_filter(regexp_split_to_array(nx.s, '\s+'), lambda w: w <> '')) <= 15 AS mg FROM e3),
e5 AS (SELECT *, last_value(CASE WHEN mg THEN nx.n END IGNORE NULLS) OVER ({O} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until FROM e4),
e AS (SELECT doc_id, n AS was, CASE WHEN mg THEN {end('l')} || ' ' || nx.s ELSE l END AS l, gap, mg, s, row_number() OVER ({O}) AS n FROM e5 WHERE NOT coalesce(n <= until, false)),
r1 AS (SELECT doc_id, n, l, regexp_matches(l, '^\s*\|') AS pipe, coalesce(regexp_matches(lead(l) OVER ({O}), '^\s*\|[\s\-:|]+\|[\s\-:|]*$'), false) AS sep FROM e),
r2 AS (SELECT *, sum((NOT pipe)::INT) OVER ({O}) AS isl FROM r1),
r3 AS (SELECT *, min(n) FILTER (sep) OVER (PARTITION BY doc_id, isl) AS start, len(string_split(regexp_replace({trim('l')}, '^\|+|\|+$', '', 'g'), '|')) AS cells FROM r2 WHERE pipe),
r4 AS (SELECT *, max(cells) FILTER (n = start) OVER (PARTITION BY doc_id, isl) AS head FROM r3 WHERE n >= start),
z1 AS (SELECT doc_id, n, l, regexp_extract(l, '^##\s+((\d+\.)+\d*\.?)\s+(.*)', 1) AS num, regexp_extract(l, '^##\s+((\d+\.)+\d*\.?)\s+(.*)', 3) AS rest FROM e
  WHERE NOT regexp_matches(l, '(?i)\.{{8,}}\s*(\d{{1,4}}|[ivxlcdm]{{1,6}})\s*\|?\s*$') AND NOT regexp_matches(l, '^[\s|]*\.{{5,}}[\s|]*$') AND NOT regexp_matches(l, '^\s*- [-+]\s*$') AND NOT regexp_matches(l, '(?i)^(#{{1,2}}\s*)?BỘ Y TẾ\s*$') AND {trim('l')} <> '<!-- image -->'),
z2 AS (SELECT doc_id, n, CASE WHEN num <> '' THEN repeat('#', least(6, 1 + len(list_filter(string_split(num, '.'), lambda x: regexp_matches(x, '^[0-9]+$'))))) || ' ' || num || ' ' || rest ELSE l END AS l FROM z1),
z AS (SELECT doc_id, n, {end(r"regexp_replace(regexp_replace(l, '^(\s*)- ([-+])\s*(\S.*)$', '\1- \3'), '[ \t]{2,}', ' ', 'g')")} AS l FROM z2)"""

SECTIONS = rf"""WITH {MARKED},
s0 AS (SELECT doc_id, unnest(x) AS l, generate_subscripts(x, 1) AS n FROM (SELECT doc_id, CASE WHEN x[-1] = '' THEN x[:-2] ELSE x END AS x FROM (SELECT doc_id, regexp_split_to_array(text, '[\n\x0b\x0c\x1c\x1d\x1e\x{{85}}\x{{2028}}\x{{2029}}]') AS x FROM m1))),
s1 AS (SELECT *, CASE WHEN regexp_matches(l, '^(#{{1,6}})[ \t]+(.+?)\s*$') THEN length(regexp_extract(l, '^(#{{1,6}})', 1)) END AS lev, regexp_extract(l, '^(#{{1,6}})[ \t]+(.+?)\s*$', 2) AS title FROM s0),
s2 AS (SELECT *, count(lev) OVER ({O}) AS sec FROM s1),
g AS (SELECT doc_id, sec, {trim("string_agg(l, chr(10) ORDER BY n)").replace(chr(92) + "s", chr(92) + "n")} AS content, max(lev) AS lev, max(title) FILTER (lev IS NOT NULL) AS title FROM s2 GROUP BY doc_id, sec),
h AS (SELECT a.doc_id, a.sec, a.content, b.sec AS bsec, b.lev AS blev, b.title AS btitle, min(b.lev) OVER (PARTITION BY a.doc_id, a.sec ORDER BY b.sec DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM g a LEFT JOIN g b ON b.doc_id = a.doc_id AND b.sec <= a.sec AND b.lev IS NOT NULL),
k AS (SELECT doc_id, sec, content, string_agg(btitle, ' > ' ORDER BY bsec) FILTER (above IS NULL OR blev < above) AS path FROM h GROUP BY ALL)"""

TABLES = rf"""{SECTIONS},
t1 AS (SELECT doc_id, n, l, starts_with({trim('l')}, '|') AS pipe, lead({trim('l')}) OVER ({O}) AS nx FROM s0),
t2 AS (SELECT *, coalesce(starts_with(nx, '|') AND len(list_filter(string_split(regexp_replace(nx, '^\|+|\|+$', '', 'g'), '|'), lambda c: NOT regexp_matches({trim('c')}, '^:?-{{3,}}:?$'))) = 0, false) AS sep, sum((NOT pipe)::INT) OVER ({O}) AS isl FROM t1),
t3 AS (SELECT *, CASE WHEN pipe THEN min(n) FILTER (pipe AND sep) OVER (PARTITION BY doc_id, isl) END AS start FROM t2),
t4 AS (SELECT *, last_value(CASE WHEN l <> '' THEN {{'l': {trim('l')}, 'i': coalesce(n >= start, false)}} END IGNORE NULLS) OVER ({O} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM t3),
t5 AS (SELECT doc_id, start, string_agg({end('l')}, chr(10) ORDER BY n) AS body, max(CASE WHEN n = start AND NOT last.i AND regexp_matches(last.l, '^\*\*[^\n]+\*\*$') THEN last.l END) AS caption FROM t4 WHERE n >= start GROUP BY doc_id, start),
t6 AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1)::INT AS table_no, caption, coalesce(caption || chr(10) || chr(10), '') || body AS content FROM t5)"""

SQL = {
    "markup_tables": f"{TABLES} SELECT doc_id, table_no, len(string_split(content, chr(10)))::INT AS n_lines, caption, md5(content) AS content_md5 FROM t6",
    "clean_markup": f"""{CLEAN}, w AS (SELECT doc_id, string_agg(l, chr(10) ORDER BY n) AS t, count(*) AS n_lines FROM z GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, md5({trim("regexp_replace(coalesce(t, ''), chr(10) || '{3,}', chr(10) || chr(10), 'g')")} || chr(10)) AS text_md5 FROM documents LEFT JOIN w USING (doc_id)""",
    "clean_markup_warnings": f"""{CLEAN}
SELECT doc_id, 'heading_promoted_bullet_disguised' AS type, n::INT AS line, substr(s, 1, 80) AS detail FROM c WHERE hit
UNION ALL SELECT doc_id, ['heading_promoted_high_confidence', 'heading_promoted_medium_confidence', 'heading_candidate_low_confidence_needs_review'][k], n::INT, substr(s, 1, 80) FROM d WHERE k > 0
UNION ALL SELECT doc_id, CASE WHEN mg THEN 'heading_dangling_connector_merged' ELSE 'heading_dangling_connector_not_merged' END, was::INT, substr(s, 1, 80) FROM e WHERE gap
UNION ALL SELECT doc_id, CASE WHEN n = start + 1 THEN 'table_separator_col_mismatch' ELSE 'table_row_col_mismatch' END, n::INT, 'header ' || head || ', row ' || cells FROM r4 WHERE n > start AND cells <> head""",
    "markup_sections": f"""{SECTIONS} SELECT doc_id, sec::INT AS section_no, length(content)::INT AS n_chars, md5(content) AS content_md5, path FROM k WHERE {trim('content')} <> ''""",
}

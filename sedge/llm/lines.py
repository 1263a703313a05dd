"""Quality rules over lines that many documents of a host share; DataFrame functions only.

Lines are normalised (lower case, digits to 0, separators to one space, trimmed) and hashed; each line counts once
for each distinct text of its host, so exact copies count once. A line of more than max(least, share x the host's
distinct texts) of them is boilerplate and is removed; a document that loses more than max_lost of its words is depleted.
Distinct texts are counted rather than rows, as else every line of a text that was copied often would be boilerplate.

Defined results: a null text has no words and fails the base rule; a null host is a host of its own; repeated rows
and equal or null ids each keep their row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedge.llm.common import SEPARATORS, saved

SPLIT = r"[ \t-\r]+"
SYMBOLS = "#*$%&|<>"
SALTS = 32


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once: Catalyst would else copy it into every lambda that uses it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPLIT), lambda w: w != "")


def repeated_words(words: Column, window: int = 8) -> Column:
    """Words that lie in a window of so many words found twice or more in the text, by 64-bit hashes of windows."""

    def covered(windows: Column) -> Column:
        def flagged(ordered: Column) -> Column:
            def twice(e: Column, k: Column) -> Column:
                return F.coalesce(F.get(ordered, k - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(ordered, k + 1)["h"] == e["h"], F.lit(False))

            return F.transform(F.filter(ordered, twice), lambda e: e["i"])

        starts = F.array_sort(let(F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), flagged))
        start = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(starts, start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(window), i - a["last"])).alias("n")), lambda a: a["n"])

    def of_hashes(hashes: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(hashes) - (window - 1)), lambda i: F.xxhash64(F.slice(hashes, i, window)))
        repeats = let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w)))
        return F.when(F.size(hashes) < window + 1, F.lit(0)).otherwise(repeats)

    return let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)


def base_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, SEPARATORS, "") != "")
    counts = F.struct(
        let(words_of(t), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words"))).alias("w"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
    )
    out = df.withColumn("_counts", counts)
    return (
        out.withColumns(
            {
                "n_words": F.col("_counts.w.n_words"),
                "word_chars": F.length(F.translate(t, SEPARATORS, "")).cast("long"),
                "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
                "n_dup_lines": F.col("_counts.n_dup_lines"),
                "n_repeat_words": F.col("_counts.w.n_repeat_words"),
            }
        )
        .withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
        .drop("_counts")
    )


def normal_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[1-9]", "0"), r"[ \t-\r]{2,}|[\t-\r]", " "))


def keyed(df: DataFrame, host: str, text: str) -> DataFrame:
    """df with _host and _doc, a key of the document's text (two hashes)."""
    t = F.coalesce(F.col(text), F.lit(""))
    return df.withColumns({"_host": F.coalesce(F.col(host), F.lit("")), "_doc": F.struct(F.xxhash64(t).alias("a"), F.hash(t).alias("b"))})


def frequent_lines(lines: DataFrame, texts: DataFrame, least: int, share: float) -> DataFrame:
    """_host, _line of the lines above their host's limit, from rows (_host, _line, _doc) and one row for each text."""
    counts = lines.select("_host", "_line", "_doc").distinct().groupBy("_host", "_line").agg(F.count("*").alias("n")).where(F.col("n") > least)
    limits = texts.groupBy("_host").agg(F.greatest(F.lit(float(least)), F.count("*") * share).alias("most"))
    return counts.join(limits, "_host").where(F.col("n") > F.col("most")).select("_host", "_line")


def line_hashes(text: Column) -> Column:
    """The hash, the words and the code points (with its end) of each line with a word, in order."""
    return F.transform(
        F.filter(F.split(text, "\n"), has_word),
        lambda x: let(normal_line(x), lambda y: F.struct(F.xxhash64(y).alias("line"), (F.length(y) - F.length(F.translate(y, " ", "")) + 1).alias("words"), (F.length(x) + 1).alias("chars"))),
    )


def has_word(line: Column) -> Column:
    return F.translate(line, SEPARATORS, "") != ""


def frequent_of_texts(df: DataFrame, host: str, text: str, least: int, share: float) -> DataFrame:
    """_host, _doc, _bad (hashes of its frequent lines), lost and _gone (words on them, and code points with line ends), for each distinct text that has such lines."""
    docs = keyed(df.select(host, text), host, text)
    texts = saved(docs.groupBy("_host", "_doc").agg(F.count("*").alias("copies")), "texts")
    lines = docs.select("_host", "_doc", F.explode(line_hashes(F.col(text))).alias("p")).select("_host", "_doc", F.col("p.line").alias("_line"), F.col("p.words").alias("words"), F.col("p.chars").alias("chars"))
    lines = saved(lines, "lines")  # hashes only; both the counting and the losses read them
    salt = F.pmod(F.xxhash64("_doc"), F.lit(SALTS))
    frequent = frequent_lines(lines, texts, least, share).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    lost = lines.withColumn("_salt", salt).join(frequent, ["_host", "_line", "_salt"]).groupBy("_host", "_doc", "_line").agg(F.sum("words").alias("words"), F.sum("chars").alias("chars"))
    lost = lost.groupBy("_host", "_doc").agg(F.collect_list("_line").alias("_bad"), F.sum("words").alias("lost"), F.sum("chars").alias("_gone"))  # no more than a text's own lines
    # a text of several copies was summed as often
    return lost.join(texts, ["_host", "_doc"]).select("_host", "_doc", "_bad", *[(F.col(c) / F.col("copies")).cast("long").alias(c) for c in ("lost", "_gone")])


def marked(df: DataFrame, docs: DataFrame, host: str, text: str, least: int, share: float) -> DataFrame:
    """docs (rows of df with more columns) with _bad and lost; null where a text has no frequent line."""
    lost = frequent_of_texts(df, host, text, least, share).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    # copies of one text can be many: they are spread over the salts before the join
    spread = F.pmod(F.xxhash64(*[c for c in df.columns if c != text]) if len(df.columns) > 1 else F.monotonically_increasing_id(), F.lit(SALTS))
    return keyed(docs, host, text).withColumn("_salt", spread).join(lost, ["_host", "_doc", "_salt"], "left")


def left_text(text: Column, bad: Column) -> Column:
    """The text without the lines whose hashes are in bad."""
    return F.when(bad.isNull(), text).otherwise(F.array_join(F.filter(F.split(text, "\n"), lambda x: ~(has_word(x) & F.array_contains(bad, F.xxhash64(normal_line(x))))), "\n"))


OWN = ("_host", "_doc", "_salt", "_counts", "_bad", "_gone", "_chars", "lost", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lost_words", "n_left_chars", "kept")


def without_frequent_lines(df: DataFrame, host: str = "source", text: str = "text", least: int = 5, share: float = 0.01) -> DataFrame:
    """df with the frequent lines removed from its text; no row goes."""
    df = df.drop("_host", "_doc", "_salt", "_bad", "_gone", "lost")
    return marked(df, df, host, text, least, share).withColumn(text, left_text(F.col(text), F.col("_bad"))).select(*df.columns)


def line_quality(
    df: DataFrame, host: str = "source", text: str = "text", least: int = 5, share: float = 0.01, max_lost: float = 0.5
) -> DataFrame:
    """df's rows with the frequent lines removed from the text, the base counts of the whole text, n_lost_words, n_left_chars, kept; columns of the names used here are replaced."""
    df = df.drop(*OWN)
    docs = base_counts(df, text).withColumn("_chars", F.length(F.coalesce(text, F.lit(""))).cast("long"))
    out = marked(df, docs, host, text, least, share).withColumn("n_lost_words", F.coalesce("lost", F.lit(0)))
    # from the lines' sums, so that whoever doesn't ask for the text needn't shuffle it
    out = out.withColumn("n_left_chars", F.greatest(F.col("_chars") - F.coalesce("_gone", F.lit(0)), F.lit(0)))
    out = out.withColumn(text, left_text(F.col(text), F.col("_bad")))
    depleted = F.col("n_lost_words") > max_lost * F.col("n_words")
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted).drop("_host", "_doc", "_salt", "_bad", "_gone", "_chars", "lost")


SQL = """
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, host, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 7], ' ')) AS h FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 7)) AS i FROM w WHERE len(ws) >= 8)),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, h) > 1),
rep AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM twice) GROUP BY doc_id),
ln AS (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM d),
good AS (SELECT doc_id, host, text, line FROM ln WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM good GROUP BY doc_id),
norm AS (SELECT doc_id, host, text, length(line) AS size, trim(regexp_replace(regexp_replace(lower(line), '[0-9]', '0', 'g'), '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ') AS line FROM good),
freq AS (SELECT host, line, count(DISTINCT text) AS n FROM norm GROUP BY host, line),
lim AS (SELECT host, greatest(5.0, count(DISTINCT text) * 0.01) AS most FROM d GROUP BY host),
lost AS (SELECT n.doc_id, sum(len(string_split(n.line, ' '))) AS n, sum(n.size + 1) AS chars FROM norm n JOIN freq f USING (host, line) JOIN lim l USING (host) WHERE f.n > 5 AND f.n > l.most GROUP BY n.doc_id),
c AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_lost_words,
  CAST(greatest(length(text) - coalesce(lost.chars, 0), 0) AS BIGINT) AS n_left_chars
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id)),
b AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lost_words, n_left_chars,
  (NOT base_failed AND NOT n_lost_words > 0.5 * n_words) AS kept
FROM b
"""

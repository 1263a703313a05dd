"""Markdown as a stream of elements: heading-aware sections, and tables with their captions, each once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sedge.functions.text import breadcrumb
from sedge.operators.lines import by_line, exploded, so_far, strip

HEADING = r"^(#{1,6})[ \t]+(.+?)\s*$"
SEPARATOR_CELL = r"^:?-{3,}:?$"
#: Words that open a caption line, besides text in double asterisks.
CAPTION_WORDS = ("Bảng",)
LEVELS = tuple(range(1, 7))


def cells(row: Column) -> Column:
    """The trimmed cells of a table row, parted at unescaped pipes."""
    return F.transform(F.split(F.regexp_replace(strip(row), r"^\|+|\|+$", ""), r"(?<!\\)\|", -1), lambda c: strip(c))


def is_separator(row: Column) -> Column:
    return strip(row).startswith("|") & F.forall(cells(row), lambda c: c.rlike(SEPARATOR_CELL))


def with_headings(lines: DataFrame, key: str, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """lines with section_no and h1 to h6: the heading of each level that is open at the line."""
    level = F.length(F.regexp_extract("line", HEADING, 1))
    x = lines.withColumn("_level", F.when(F.col("line").rlike(HEADING) & level.isin(*levels), level)).withColumn("_title", F.regexp_extract("line", HEADING, 2))
    w = so_far(key)
    x = x.withColumn("section_no", F.count("_level").over(w).cast("int"))
    for n in LEVELS:
        here = F.col("_level") == n
        x = x.withColumn(f"_p{n}", F.coalesce(F.max(F.when(here, F.col("line_no"))).over(w), F.lit(-1))).withColumn(f"_t{n}", F.last(F.when(here, F.col("_title")), ignorenulls=True).over(w))
    for n in LEVELS:
        above = F.greatest(F.lit(-2), *[F.col(f"_p{m}") for m in range(1, n)]) if n > 1 else F.lit(-2)
        x = x.withColumn(f"h{n}", F.when((F.col(f"_p{n}") >= 0) & (F.col(f"_p{n}") > above), F.col(f"_t{n}")))
    return x.drop("_level", "_title", *[f"_{c}{n}" for n in LEVELS for c in "pt"])


def with_tables(lines: DataFrame, key: str, captions: tuple[str, ...] = CAPTION_WORDS) -> DataFrame:
    """lines with table_no (rows of a table, dense from 0) and caption; lines that serve as captions, and the blanks after, go."""
    blank_left = F.regexp_replace("line", r"^[\s\p{Z}]+", "")
    x = lines.withColumn("_pipe", F.coalesce(blank_left.startswith("|"), F.lit(False)))
    x = x.withColumn("_sep_next", F.coalesce(is_separator(F.lead("line").over(by_line(key))), F.lit(False)))
    x = x.withColumn("_island", F.sum((~F.col("_pipe")).cast("int")).over(so_far(key)))
    start = F.min(F.when(F.col("_pipe") & F.col("_sep_next"), F.col("line_no"))).over(W.partitionBy(key, "_island"))
    x = x.withColumn("_start", F.when(F.col("_pipe"), start)).withColumn("_in", F.coalesce(F.col("line_no") >= F.col("_start"), F.lit(False)))
    before = by_line(key).rowsBetween(W.unboundedPreceding, -1)
    x = x.withColumn("_last", F.last(F.when(F.col("line") != "", F.struct("line_no", "line", "_in")), ignorenulls=True).over(before))
    text = strip(F.col("_last.line"))
    pattern = r"(?iu)^(?:\*\*[^\n]+\*\*" + (f"|(?:{'|'.join(captions)})\\s+[^\\n]+" if captions else "") + ")$"
    opens = F.col("_in") & (F.col("line_no") == F.col("_start"))
    x = x.withColumn("_cap", F.when(opens & ~F.col("_last._in") & text.rlike(pattern), F.struct(F.col("_last.line_no").alias("at"), text.alias("text"))))
    ahead = by_line(key).rowsBetween(0, W.unboundedFollowing)
    x = x.withColumn("_ahead", F.first(F.when(F.col("_in"), F.struct("line_no", F.col("_cap.at").alias("at"))), ignorenulls=True).over(ahead))
    used = ~F.col("_in") & F.coalesce(F.col("line_no") >= F.col("_ahead.at"), F.lit(False))
    x = x.withColumn("table_no", F.when(F.col("_in"), F.sum(opens.cast("int")).over(so_far(key)) - 1))
    x = x.withColumn("caption", F.when(F.col("_in"), F.last(F.when(opens, F.struct(F.col("_cap.text").alias("t"))), ignorenulls=True).over(so_far(key))["t"]))
    return x.where(~used).drop("_pipe", "_sep_next", "_island", "_start", "_in", "_last", "_cap", "_ahead")


def elements(df: DataFrame, key: str = "doc_id", text: str = "text", levels: tuple[int, ...] = LEVELS, captions: tuple[str, ...] = CAPTION_WORDS) -> DataFrame:
    """key, pos, section_no, h1 to h6, breadcrumb, is_table, table_no, caption, content: text and tables in order, blank ones dropped."""
    lines = with_headings(exploded(df, key, text, python_lines=True), key, levels)
    x = with_tables(lines, key, captions)
    fresh = ~F.col("table_no").eqNullSafe(F.lag("table_no").over(by_line(key))) | (F.col("section_no") != F.coalesce(F.lag("section_no").over(by_line(key)), F.lit(-1)))
    x = x.withColumn("pos", F.sum(fresh.cast("int")).over(so_far(key)))
    heads = [f"h{n}" for n in LEVELS]
    line = F.when(F.col("table_no").isNotNull(), F.regexp_replace("line", r"[\s\p{Z}]+$", "")).otherwise(F.col("line"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", line.alias("line")))), lambda e: e["line"])
    out = x.groupBy(key, "pos", "section_no", *heads, "table_no").agg(F.max("caption").alias("caption"), F.array_join(ordered, "\n").alias("content"))
    out = out.withColumn("is_table", F.col("table_no").isNotNull())
    out = out.withColumn("content", F.when(F.col("is_table") & F.col("caption").isNotNull(), F.concat_ws("\n\n", "caption", "content")).when(F.col("is_table"), F.col("content")).otherwise(F.regexp_replace("content", r"^\n+|\n+$", "")))
    empty_table = F.regexp_replace(F.regexp_replace(F.col("content"), r"(?m)^(?!\s*\|).*$", ""), r"[|:\-\s]", "") == ""
    out = out.where(F.when(F.col("is_table"), ~empty_table).otherwise(strip(F.col("content")) != ""))
    return out.withColumn("breadcrumb", breadcrumb(*[F.col(h) for h in heads]))


def sections(df: DataFrame, key: str = "doc_id", text: str = "text", levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """key, section_no, h1 to h6, breadcrumb, content: whole sections, tables left in; blank ones dropped."""
    heads = [f"h{n}" for n in LEVELS]
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda e: e["line"])
    x = with_headings(exploded(df, key, text, python_lines=True), key, levels).groupBy(key, "section_no", *heads).agg(F.array_join(ordered, "\n").alias("content"))
    x = x.withColumn("content", F.regexp_replace("content", r"^\n+|\n+$", "")).where(strip(F.col("content")) != "")
    return x.withColumn("breadcrumb", breadcrumb(*[F.col(h) for h in heads]))


def heading_only(text: Column) -> Column:
    """Every line that isn't blank is a heading or wholly in brackets."""
    return F.forall(F.split(text, r"\n"), lambda x: (strip(x) == "") | strip(x).startswith("#") | strip(x).rlike(r"^\[.*\]$"))

"""Cleaning of Markdown that came from a layout model, line by line, as window and filter operations.

Steps run in the order of the step list in clean_lines(); each sees what the one before it left, and warnings give
the 1-based line in the array of their own step.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sedge.functions.text import normalised
from sedge.operators.lines import by_line, exploded, joined, renumbered, rstrip, so_far, strip

# Patterns and words that decide what a line is.
DOT_LEADER = r"(?i)\.{8,}\s*(\d{1,4}|[ivxlcdm]{1,6})\s*\|?\s*$"
PURE_DOTS = r"^[\s|]*\.{5,}[\s|]*$"
GLUED_BULLET = r"^(\s*)- ([-+])\s*(\S.*)$"
ORPHAN_BULLET = r"^\s*- [-+]\s*$"
HEADING = r"^#{1,6}\s+\S"
HEADING_START = r"^#{1,6}\s+"
HEADING_TEXT = r"^(#{1,6})\s+(.*)$"
SUFFIX_LETTERS = "a-záàảãạăắặằẳẵâấầẩẫậđéèẻẽẹêếềểễệíìỉĩịóòỏõọôốồổỗộơớờởỡợúùủũụưứừửữựýỳỷỹỵ"
COMPLETE_END = r"[.;:?!]\s*$"
NUMBERED_LEVEL = r"^##\s+((\d+\.)+\d*\.?)\s+(.*)"
TABLE_ROW = r"^\s*\|"
TABLE_SEPARATOR = r"^\s*\|[\s\-:|]+\|[\s\-:|]*$"
LETTER_BULLET = r"^-\s+([IVXLCDM]{2,4}|[A-Z])\.\s+(\S.*)$"
DOTTED_BULLET = r"^-\s+(\d+(?:\.\d+)+)\.?\s+(\S.*)$"
BULLET_START = r"^[-+]\s"
NUMBERED_LINE = r"^(\d+)\.\s+(\S.*)$"
TOC_TITLES = ("MỤC LỤC",)
FRONT_MATTER = (
    r"^(#{1,2}\s*)?BỘ Y TẾ\s*$",
    r"^\s*---o0o---\s*$",
    r"^(#{1,2}\s*)?CHỦ BIÊN\s*$",
    r"^(#{1,2}\s*)?ĐỒNG CHỦ BIÊN\s*$",
    r"^\s*(PGS\.TS\.|GS\.TS\.|TS\.BS\.|ThS\.BS\.)\s+",
)
CONNECTORS = ("và", "của", "trong", "là", "để", "với", "theo", "khi", "cho", "hoặc", "có", "từ", "do", "các", "những", "đến", "sau", "trên", "dưới", "về", "như", "nếu")
MEDIUM_WORDS, MERGE_WORDS, IMAGE = 8, 15, "<!-- image -->"


@dataclass(frozen=True)
class CleanConfig:
    """Words of the corpus's language, and what to keep. preserve_indent keeps a line's leading blanks as they are."""

    drop_images: bool = True
    preserve_indent: bool = False
    toc_titles: tuple[str, ...] = TOC_TITLES
    front_matter: tuple[str, ...] = FRONT_MATTER
    connectors: tuple[str, ...] = CONNECTORS
    legacy_font: dict[str, str] = field(default_factory=dict)


def is_boundary(previous: Column) -> Column:
    """The line before is blank, a whole sentence or a bullet, so this one continues nothing."""
    p = strip(F.coalesce(previous, F.lit("")))
    return (p == "") | p.rlike(COMPLETE_END) | p.rlike(BULLET_START)


def n_words(x: Column) -> Column:
    return F.size(F.filter(F.split(x, r"[\s\p{Z}]+"), lambda w: w != ""))


def without_toc(lines: DataFrame, key: str, config: CleanConfig) -> DataFrame:
    """A contents heading goes with all up to the next heading, if a dot leader follows it there."""
    title = F.lit(False)
    for t in config.toc_titles:
        title = title | strip(F.col("line")).rlike(rf"(?iu)^#{{1,2}}\s*{t}\s*$")
    marked = lines.withColumn("_seg", F.sum(F.col("line").rlike(HEADING).cast("int")).over(so_far(key)))
    whole = W.partitionBy(key, "_seg")
    marked = marked.withColumn("_toc", F.min(F.when(title, F.col("line_no"))).over(whole)).withColumn("_dots", F.max(F.when(F.col("line").rlike(DOT_LEADER), F.col("line_no"))).over(whole))
    gone = F.coalesce((F.col("line_no") >= F.col("_toc")) & (F.col("_dots") > F.col("_toc")), F.lit(False))
    return renumbered(marked.where(~gone).drop("_seg", "_toc", "_dots"), key)


def with_whole_headings(lines: DataFrame, key: str) -> DataFrame:
    """A heading and a heading of one to three letters right after it are one; of a chain, every second joins the one before."""
    following = F.lead("line").over(by_line(key))
    suffix = rf"(?iu)^#{{1,6}}\s+([{SUFFIX_LETTERS}]{{1,3}})\s*$"
    joins = F.col("line").rlike(HEADING_START) & F.coalesce(following.rlike(suffix), F.lit(False)) & ~rstrip(F.col("line")).rlike(COMPLETE_END)
    x = lines.withColumn("_join", joins).withColumn("_island", F.sum((~F.col("_join")).cast("int")).over(so_far(key)))
    first = F.min("line_no").over(W.partitionBy(key, "_island"))
    # an island is a line that doesn't join, then those that do; before the first such line, only those that do
    offset = F.when(F.min(F.struct("line_no", "_join")).over(W.partitionBy(key, "_island"))["_join"], F.col("line_no") - first).otherwise(F.col("line_no") - first - 1)
    x = x.withColumn("_merge", F.col("_join") & (offset % 2 == 0))
    x = x.withColumn("_gone", F.coalesce(F.lag("_merge").over(by_line(key)), F.lit(False)))
    x = x.withColumn("_line", F.when(F.col("_merge"), F.concat(rstrip(F.col("line")), F.regexp_extract(following, suffix, 1))).otherwise(F.col("line")))
    return renumbered(x.where(~F.col("_gone")).select(key, "line_no", F.col("_line").alias("line")), key)


def promoted_bullets(lines: DataFrame, key: str) -> DataFrame:
    """Bullets that are headings by their number or letter; column warning has the kind."""
    s = strip(F.col("line"))
    hit = (s.rlike(DOTTED_BULLET) | s.rlike(LETTER_BULLET)) & is_boundary(F.lag("line").over(by_line(key)))
    made = F.concat(F.lit("## "), F.regexp_replace(F.substring(s, 3, 1 << 30), r"^\s+", ""))
    return lines.select(key, "line_no", F.when(hit, made).otherwise(F.col("line")).alias("line"), F.when(hit, "heading_promoted_bullet_disguised").alias("warning"), s.alias("detail"))


def promoted_numbers(lines: DataFrame, key: str) -> DataFrame:
    """'N. text' lines that are headings: all capitals, short after a blank, or doubtful (only a warning)."""
    s = strip(F.col("line"))
    previous = strip(F.coalesce(F.lag("line").over(by_line(key)), F.lit("")))
    rest = F.regexp_extract(s, NUMBERED_LINE, 2)
    letters = F.regexp_replace(rest, r"[^\p{L}]", "")
    capitals = (letters == F.upper(letters)) & (letters != F.lower(letters))
    boundary, numbered = is_boundary(F.lag("line").over(by_line(key))), s.rlike(NUMBERED_LINE)
    dots = F.length(rest) - F.length(F.replace(rest, F.lit("."), F.lit("")))
    high, medium = numbered & capitals & boundary, numbered & (previous == "") & (n_words(rest) <= MEDIUM_WORDS) & (dots <= 1)
    line = F.when(high, F.concat(F.lit("## "), s)).when(medium, F.concat(F.lit("### "), s)).otherwise(F.col("line"))
    kind = F.when(high, "heading_promoted_high_confidence").when(medium, "heading_promoted_medium_confidence").when(numbered & boundary, "heading_candidate_low_confidence_needs_review")
    return lines.select(key, "line_no", line.alias("line"), kind.alias("warning"), s.alias("detail"))


def ends_dangling(x: Column, connectors: tuple[str, ...]) -> Column:
    t = strip(x)
    last = F.regexp_replace(F.lower(F.regexp_extract(t, r"(\S+)$", 1)), r"^[.,:;]+|[.,:;]+$", "")
    return t.endswith("-") | last.isin(*connectors)


def joined_dangling(lines: DataFrame, key: str, config: CleanConfig) -> DataFrame:
    """A heading that ends in a hyphen or connector takes the short paragraph after the gap; else it is only reported."""
    ahead = by_line(key).rowsBetween(1, W.unboundedFollowing)
    s = strip(F.col("line"))
    x = lines.withColumn("_next", F.first(F.when(s != "", F.struct("line_no", s.alias("s"))), ignorenulls=True).over(ahead))
    heading = F.col("line").rlike(HEADING_TEXT) & ends_dangling(F.regexp_extract("line", HEADING_TEXT, 2), config.connectors)
    gap = heading & F.col("_next").isNotNull() & (F.col("_next.line_no") > F.col("line_no") + 1)
    merge = gap & ~F.col("_next.s").rlike(r"^[#\-+|]") & (n_words(F.col("_next.s")) <= MERGE_WORDS)
    x = x.withColumn("_merge", F.coalesce(merge, F.lit(False))).withColumn("_gap", F.coalesce(gap, F.lit(False)))
    x = x.withColumn("_until", F.last(F.when(F.col("_merge"), F.col("_next.line_no")), ignorenulls=True).over(by_line(key).rowsBetween(W.unboundedPreceding, -1)))
    kind = F.when(F.col("_merge"), "heading_dangling_connector_merged").when(F.col("_gap"), "heading_dangling_connector_not_merged")
    line = F.when(F.col("_merge"), F.concat(rstrip(F.col("line")), F.lit(" "), F.col("_next.s"))).otherwise(F.col("line"))
    gone = F.coalesce(F.col("line_no") <= F.col("_until"), F.lit(False))
    return x.where(~gone).select(key, "line_no", line.alias("line"), kind.alias("warning"), s.alias("detail"))


def n_cells(row: Column) -> Column:
    return F.size(F.split(F.regexp_replace(strip(row), r"^\|+|\|+$", ""), r"\|", -1))


def table_warnings(lines: DataFrame, key: str) -> DataFrame:
    """key, type, line, detail for tables whose separator or rows have other cell counts than the header."""
    row = F.col("line").rlike(TABLE_ROW)
    x = lines.withColumn("_row", row).withColumn("_sep_next", F.coalesce(F.lead("line").over(by_line(key)).rlike(TABLE_SEPARATOR), F.lit(False)))
    x = x.withColumn("_island", F.sum((~F.col("_row")).cast("int")).over(so_far(key))).where("_row")
    island = W.partitionBy(key, "_island")
    x = x.withColumn("_start", F.min(F.when(F.col("_sep_next"), F.col("line_no"))).over(island)).where(F.col("line_no") >= F.col("_start"))
    x = x.withColumn("_cells", n_cells(F.col("line"))).withColumn("_header", F.max(F.when(F.col("line_no") == F.col("_start"), F.col("_cells"))).over(island))
    bad = x.where((F.col("line_no") > F.col("_start")) & (F.col("_cells") != F.col("_header")))
    kind = F.when(F.col("line_no") == F.col("_start") + 1, "table_separator_col_mismatch").otherwise("table_row_col_mismatch")
    return bad.select(key, kind.alias("type"), (F.col("line_no") + 1).alias("line"), F.format_string("header %d, row %d", "_header", "_cells").alias("detail"))


def filtered(lines: DataFrame, key: str, config: CleanConfig) -> DataFrame:
    """Junk lines out; then heading levels by number, glued bullets, runs of blanks, ends of lines."""
    line = F.col("line")
    junk = line.rlike(DOT_LEADER) | line.rlike(PURE_DOTS) | line.rlike(ORPHAN_BULLET)
    if config.front_matter:
        junk = junk | line.rlike("(?iu)" + "|".join(f"(?:{p})" for p in config.front_matter))
    if config.drop_images:
        junk = junk | (strip(line) == IMAGE)
    number = F.regexp_extract(line, NUMBERED_LEVEL, 1)
    level = F.least(F.size(F.filter(F.split(number, r"\."), lambda p: p.rlike("^[0-9]+$"))) + 1, F.lit(6))
    levelled = F.concat(F.repeat(F.lit("#"), level), F.lit(" "), number, F.lit(" "), F.regexp_extract(line, NUMBERED_LEVEL, 3))
    out = lines.where(~junk).withColumn("line", F.when(line.rlike(NUMBERED_LEVEL), levelled).otherwise(line))
    out = out.withColumn("line", F.regexp_replace("line", GLUED_BULLET, "$1- $3"))
    runs = r"(?<=\S)[ \t]{2,}" if config.preserve_indent else r"[ \t]{2,}"
    return out.withColumn("line", rstrip(F.regexp_replace("line", runs, " ")))


def warnings_of(lines: DataFrame, key: str) -> DataFrame:
    return lines.where(F.col("warning").isNotNull()).select(key, F.col("warning").alias("type"), (F.col("line_no") + 1).alias("line"), F.substring("detail", 1, 80).alias("detail"))


def clean_lines(df: DataFrame, key: str = "doc_id", text: str = "text", config: CleanConfig = CleanConfig()) -> tuple[DataFrame, DataFrame]:
    """The cleaned lines (key, line_no, line) and the warnings (key, type, line, detail)."""
    lines = exploded(df.withColumn("_t", normalised(F.col(text), config.legacy_font)), key, "_t")
    lines = with_whole_headings(without_toc(lines, key, config), key)
    found = []
    for step in (lambda x: promoted_bullets(x, key), lambda x: promoted_numbers(x, key), lambda x: joined_dangling(x, key, config)):
        lines = step(lines)
        found.append(warnings_of(lines, key))
        lines = lines.select(key, "line_no", "line")
    lines = renumbered(lines, key)
    found.append(table_warnings(lines, key))
    return filtered(lines, key, config), reduce(DataFrame.unionByName, found)


def clean(df: DataFrame, key: str = "doc_id", text: str = "text", config: CleanConfig = CleanConfig()) -> tuple[DataFrame, DataFrame]:
    """(key, text) cleaned, one row for each row of df, and the warnings. key must be unique."""
    lines, warnings = clean_lines(df, key, text, config)
    whole = joined(lines, key)
    body = strip(F.regexp_replace(F.coalesce("text", F.lit("")), r"\n{3,}", "\n\n"))
    return df.select(key).join(whole, key, "left").select(key, F.concat(body, F.lit("\n")).alias("text")), warnings


def clean_report(df: DataFrame, cleaned: DataFrame, warnings: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, chars_before, chars_after, reduction_pct, warnings."""
    by = warnings.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("line", "type", "detail"))).alias("warnings"))
    sizes = df.select(key, F.length(F.coalesce(F.col(text), F.lit(""))).alias("chars_before")).join(cleaned.select(key, F.length("text").alias("chars_after")), key)
    pct = F.when(F.col("chars_before") == 0, 0.0).otherwise(F.round((1 - F.col("chars_after") / F.col("chars_before")) * 100, 2) + 0.0)
    return sizes.withColumn("reduction_pct", pct).join(by, key, "left")

"""Texts as ordered lines and back. Every window over lines has the same partitioning and order, so one exchange serves them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sedge.functions.text import split_lines

#: White space as str.strip() knows it.
BLANK = r"[\s\p{Z}\x1c-\x1f\x85]"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, f"^{BLANK}+|{BLANK}+$", "")


def rstrip(x: Column) -> Column:
    return F.regexp_replace(x, f"{BLANK}+$", "")


def exploded(df: DataFrame, key: str, text: str = "text", python_lines: bool = False) -> DataFrame:
    """key, line_no, line; parted at LF, or as str.splitlines() does."""
    t = F.coalesce(F.col(text), F.lit(""))
    return df.select(key, F.posexplode(split_lines(t) if python_lines else F.split(t, "\n")).alias("line_no", "line"))


def by_line(key: str, *more: str) -> WindowSpec:
    return W.partitionBy(key, *more).orderBy("line_no")


def so_far(key: str, *more: str) -> WindowSpec:
    return by_line(key, *more).rowsBetween(W.unboundedPreceding, 0)


def renumbered(lines: DataFrame, key: str) -> DataFrame:
    """Line numbers dense from 0 after lines went."""
    return lines.withColumn("_n", F.row_number().over(by_line(key)) - 1).drop("line_no").withColumnRenamed("_n", "line_no")


def joined(lines: DataFrame, *keys: str, out: str = "text") -> DataFrame:
    """One text for each group of keys, lines in order."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return lines.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias(out))

"""Documents in: HTML to Markdown by column functions, plus text and binary files, with failures kept apart."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.functions.text import nfc, unescaped

#: Elements whose content is no text.
SILENT = ("script", "style", "noscript", "template", "head")


def html_to_markdown(html: Column) -> Column:
    """Headings to #, list items to -, br and block ends to new lines, other tags away, entities decoded; malformed markup is only text and tags."""
    t = F.regexp_replace(html, r"(?s)<!--.*?(?:-->|$)", "")
    for name in SILENT:
        t = F.regexp_replace(t, rf"(?is)<{name}\b[^>]*>.*?(?:</{name}\s*>|$)", "")
    t = F.regexp_replace(t, r"\s+", " ")
    for n in range(1, 7):
        t = F.regexp_replace(t, rf"(?i)<h{n}\b[^>]*>\s*", "\n\n" + "#" * n + " ")
    t = F.regexp_replace(t, r"(?i)<li\b[^>]*>\s*", "\n- ")
    t = F.regexp_replace(t, r"(?i)<br\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"(?i)</?(?:p|div|section|article|ul|ol|table|tr|h[1-6]|header|footer|nav|main|body|html)\b[^>]*>", "\n\n")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    t = unescaped(t)
    t = F.regexp_replace(t, r"[ \t ]+", " ")
    t = F.regexp_replace(t, r" ?\n ?", "\n")
    return F.concat(F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\s+|\s+$", ""), F.lit("\n"))


def page_documents(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Raw documents: key, source_file, markdown, force_ocr, languages, num_pages, status."""
    return pages.select(
        key, F.coalesce(F.col("url"), F.col(key).cast("string")).alias("source_file"), html_to_markdown(F.coalesce(F.col(html), F.lit(""))).alias("markdown"),
        F.lit(False).alias("force_ocr"), F.array(F.lit("vi"), F.lit("en")).alias("languages"), F.lit(1).alias("num_pages"), F.when(F.col(html).isNull(), "empty").otherwise("success").alias("status"),
    )


def text_files(spark: SparkSession, path: str, pattern: str = "*_clean.md") -> DataFrame:
    """source (the file's name, NFC), text for whole text files."""
    x = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True)
    return x.select(nfc(F.url_decode(F.element_at(F.split(F.input_file_name(), "/"), -1))).alias("source"), F.col("value").alias("text"))


def binary_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """source, content, sha256; an empty folder is an error."""
    x = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    if x.isEmpty():
        raise ValueError(f"no {pattern} in {path}")
    return x.select(F.element_at(F.split("path", "/"), -1).alias("source"), "content", F.sha2("content", 256).alias("sha256"))


def with_ocr(files: DataFrame, settings: DataFrame | None = None, force: bool | None = None) -> DataFrame:
    """files with force_ocr: the flag if given, else the file's own setting (source, force_ocr), else false."""
    if force is not None:
        return files.withColumn("force_ocr", F.lit(force))
    if settings is None:
        return files.withColumn("force_ocr", F.lit(False))
    own = settings.select("source", F.col("force_ocr").alias("_own"))
    return files.join(own, "source", "left").withColumn("force_ocr", F.coalesce("_own", F.lit(False))).drop("_own")


def only_new(files: DataFrame, done: DataFrame, key: str = "source") -> DataFrame:
    """Files that aren't among the wholly processed ones (markdown and metadata both there)."""
    whole = done.where(F.col("markdown").isNotNull() & F.col("status").isNotNull()).select(key)
    return files.join(whole, key, "left_anti")


def converters(make: Callable[[bool, tuple[str, ...]], Callable[[bytes], tuple[str, int]]]) -> Callable[[bytes, bool, list[str]], tuple[str, int]]:
    """A parser for parsed() that makes one converter for each setting of force_ocr and languages in each Python worker, and keeps it."""
    made: dict = {}

    def parse(content: bytes, force: bool, languages: list[str]) -> tuple[str, int]:
        key = (force, tuple(languages))
        if key not in made:
            made[key] = make(*key)
        return made[key](content)

    return parse


def parsed(files: DataFrame, parse: Callable[[bytes, bool, list[str]], tuple[str, int]], languages: tuple[str, ...] = ("vi", "en")) -> tuple[DataFrame, DataFrame]:
    """Run any parser (bytes, force_ocr, languages) -> (markdown, pages) on each file; good documents, and (source, error) of the rest."""
    wanted = list(dict.fromkeys(languages))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for source, content, force in zip(batch["source"], batch["content"], batch["force_ocr"], strict=True):
                try:
                    markdown, n = parse(bytes(content), bool(force), wanted)
                    rows.append((source, markdown, bool(force), n, "success", None))
                except Exception as error:  # one bad file must not end the job
                    rows.append((source, None, bool(force), None, "failed", f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["source", "markdown", "force_ocr", "num_pages", "status", "error"]).astype({"num_pages": "Int32"})

    out = files.select("source", "content", "force_ocr").mapInPandas(run, "source string, markdown string, force_ocr boolean, num_pages int, status string, error string")
    good = out.where("error is null").drop("error").withColumn("languages", F.array(*[F.lit(x) for x in wanted]))
    return good, out.where("error is not null").select("source", "error")

"""Text functions, cleaning, sections, tables and chunkers against small plain specifications."""

import html
import re
import unicodedata
import uuid

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sedge.functions import text as tx
from sedge.operators import chunkers, clean, embed, lines, qa, sections
from sedge.sources import html as pages


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def column(spark, texts, make):
    return [r[0] for r in frame(spark, texts).orderBy("doc_id").select(make(F.col("text"))).collect()]


def test_normalised(spark):
    texts = ["a\r\nb\rc", "é", "&amp; &eacute; &lt;x&gt;", " 5  x ", None, ""]
    assert column(spark, texts, tx.normalised) == ["a\nb\nc", "é", "& é <x>", "≥ 5  x β", None, ""]
    assert column(spark, ["abc"], lambda t: tx.replaced(t, {"a": "x", "x": "y"})) == ["ybc"]


def test_split_lines(spark):
    texts = ["a\nb\r\nc\x0bd\x0ce\x1cf\x85g h i", "a\n", "a\n\n", "", "x"]
    got = column(spark, texts, tx.split_lines)
    assert [g if t else [] for g, t in zip(got, texts, strict=True)] == [t.splitlines() for t in texts]


def test_evidence_tokens(spark):
    def plain(t):
        t = unicodedata.normalize("NFC", t).lower().replace("–", "-").replace("—", "-")
        return re.findall(r"\w+(?:[.,]\d+)?|>=|<=|≥|≤|>|<|%", re.sub(r"[#*_`>|]+", " ", t))

    texts = ["# Dose ≥ 3,5 mg/kg — 20%", "a_b | c <= 4.25", "Điều trị: ≤ 12 giờ", "x>y >= z", ""]
    assert column(spark, texts, tx.evidence_tokens) == [plain(t) for t in texts]


def test_breadcrumbs_and_ids(spark):
    assert column(spark, ["[a > b]\nbody", "[x] text", "[only]"], tx.without_breadcrumb) == ["body", "[x] text", ""]
    ids = ["a::1", "tệp.md::20", ""]
    assert column(spark, ids, tx.point_id) == [str(uuid.uuid5(uuid.UUID(tx.POINT_NAMESPACE), i)) for i in ids]
    texts = ["one two, three!", "é_1 (x)", ""]
    assert column(spark, texts, tx.token_count) == [chunkers.count_tokens(t) for t in texts]


CLEAN = {
    "toc": ("## MỤC LỤC\nA ........... 3\nB\n## Real\nx", "## Real\nx\n"),
    "toc_kept": ("##MỤC LỤC\nno dots\n## Real", "##MỤC LỤC\nno dots\n## Real\n"),
    "broken": ("## Chăm só\n## c\nx", "## Chăm sóc\nx\n"),
    "broken_chain": ("## A\n## b\n## c", "## Ab\n## c\n"),
    "broken_stop": ("## A.\n## b", "## A.\n## b\n"),
    "broken_long": ("## A\n## bcde", "## A\n## bcde\n"),
    "bullet_roman": ("- II. Title", "## II. Title\n"),
    "bullet_dotted": ("x.\n- 1.2. Title", "x.\n### 1.2. Title\n"),
    "bullet_unfinished": ("x and\n- 1.2. Title", "x and\n- 1.2. Title\n"),
    "bullet_single": ("- 1. Title", "- 1. Title\n"),
    "number_high": ("1. ƠN TRỜI ƯU", "## 1. ƠN TRỜI ƯU\n"),
    "number_medium": ("\n1. One two three four five six seven eight", "### 1. One two three four five six seven eight\n"),
    "number_low": ("\n1. One two three four five six seven eight nine", "1. One two three four five six seven eight nine\n"),
    "dangling": ("## Care and\n## Theo dõi và\n\nchăm sóc", "## Care and\n## Theo dõi và chăm sóc\n"),
    "dangling_hyphen": ("## Post-\n\npartum", "## Post- partum\n"),
    "dangling_no_gap": ("## Theo\nx", "## Theo\nx\n"),
    "dangling_bullet": ("## Theo\n\n- x", "## Theo\n\n- x\n"),
    "dangling_long": ("## Theo\n\n" + "w " * 16, "## Theo\n\n" + " ".join("w" * 16) + "\n"),
    "filters": ("<!-- image -->\na ......... 12\n......\n- -\nBộ y tế\n- -Text\n## 1.2.3.4.5.6. X\nb  c  ", "- Text\n###### 1.2.3.4.5.6. X\nb c\n"),
    "nested": ("- a\n  - b", "- a\n - b\n"),
    "blank": ("a\n\n\n\nb", "a\n\nb\n"),
    "empty": ("", "\n"),
}


def test_clean(spark):
    names = list(CLEAN)
    got, _ = clean.clean(frame(spark, [CLEAN[n][0] for n in names]))
    by = {r["doc_id"]: r["text"] for r in got.collect()}
    for i, n in enumerate(names):
        assert by[i] == CLEAN[n][1], n


def test_clean_warnings(spark):
    table = "| a | b |\n|---|---|---|\n| 1 | 2 |\n| 1 |"
    df = frame(spark, [table, "\n1. ABC\n\n2. Short one", "## Theo\n\n" + "w " * 16])
    cleaned, warnings = clean.clean(df)
    got = {(r["doc_id"], r["type"], r["line"]) for r in warnings.collect()}
    assert got == {(0, "table_separator_col_mismatch", 2), (0, "table_row_col_mismatch", 4), (1, "heading_promoted_high_confidence", 2), (1, "heading_promoted_medium_confidence", 4), (2, "heading_dangling_connector_not_merged", 1)}
    report = {r["doc_id"]: r for r in clean.clean_report(df, cleaned, warnings).collect()}
    assert report[0]["chars_before"] == len(table) and len(report[1]["warnings"]) == 2


def plain_headings(text):
    stack, out = {}, []
    for line in text.splitlines():
        if m := re.match(r"^(#{1,6})[ \t]+(.+?)\s*$", line):
            stack = {k: v for k, v in stack.items() if k < len(m[1])} | {len(m[1]): m[2]}
        out.append(" > ".join(stack[k] for k in sorted(stack)))
    return out


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["# A", "## B", "### C", "# D", "## E", "text", "", "####### no", "#### F"]), min_size=1, max_size=12).map("\n".join), min_size=1, max_size=6))
def test_heading_stack(spark, texts):
    got = sections.with_headings(lines.exploded(frame(spark, texts), "doc_id", python_lines=True), "doc_id").withColumn("b", tx.breadcrumb(*[F.col(f"h{n}") for n in range(1, 7)]))
    by = {(r["doc_id"], r["line_no"]): r["b"] for r in got.collect()}
    for i, t in enumerate(texts):
        for n, crumb in enumerate(plain_headings(t)):
            assert by[i, n] == crumb


def test_tables(spark):
    t = "# H\nintro\n\n**Table 1**\n\n| a | b |\n|---|:---:|\n| 1 | 2 |\nafter\n| not | table |\n\n| x |\n| y |\n|---|\n| z |"
    rows = [(r["is_table"], r["content"]) for r in sections.elements(frame(spark, [t])).orderBy("pos").collect()]
    assert rows == [(False, "# H\nintro"), (True, "**Table 1**\n\n| a | b |\n|---|:---:|\n| 1 | 2 |"), (False, "after\n| not | table |\n\n| x |"), (True, "| y |\n|---|\n| z |")]
    assert sections.elements(frame(spark, ["| |\n|---|\n| |", "", None])).count() == 0


def test_split_table():
    table = "Bảng 1\n\n| a |\n|---|\n" + "\n".join(f"| {'w ' * 5}{i} |" for i in range(6))
    parts = chunkers.split_table(table, 40, 1)
    assert all(p.startswith("Bảng 1\n\n| a |\n|---|\n| w") for p in parts) and len(parts) > 1
    rows = [x for p in parts for x in p.splitlines()[4:]]
    assert list(dict.fromkeys(rows)) == table.splitlines()[4:]
    assert chunkers.split_table("| a |\n|---|\n| " + "w " * 99 + "|", 10) == ["| a |\n|---|\n| " + "w " * 99 + "|"]
    assert chunkers.split_table("no table", 1) == ["no table"]


@given(st.text(alphabet="ab. \n!;", max_size=200), st.integers(2, 20))
def test_split_text_keeps_all(text, budget):
    parts = chunkers.split_text(text, budget, 0)
    assert "".join(parts) == text
    assert all(chunkers.count_tokens(p) <= budget for p in parts)


def test_chunks(spark):
    body = " ".join(f"Sentence number {i} is here." for i in range(60))
    text = f"# Top\n\n## Part one\n{body}\n\n## Part two\n\n| a | b |\n|---|---|\n" + "\n".join(f"| {i} | cell {i} |" for i in range(40)) + "\n\n# Empty\n"
    config = chunkers.ChunkConfig(max_tokens=80, overlap=10, min_tokens=10)
    df = frame(spark, [text, "", "# Only heading"])
    for made in (chunkers.hierarchical_chunks(df, config=config), chunkers.semantic_chunks(df, embed.hashing_embedder(16), config=config)):
        rows = made.where("doc_id = 0").orderBy("chunk_index").collect()
        assert [r["chunk_index"] for r in rows] == list(range(len(rows))) and len({r["chunk_id"] for r in rows}) == len(rows)
        assert all(r["token_count"] <= 80 for r in rows) and any(r["is_table"] and r["table_parts"] > 1 for r in rows)
        joined = "\n".join(r["text"] for r in rows)
        assert all(f"number {i} is" in joined for i in range(60)) and all(f"cell {i} |" in joined for i in range(40))
        assert made.where("doc_id = 1").isEmpty()
        stats = qa.chunk_stats(made).where("chunker_type is null").first()
        assert stats["duplicate_ids"] == 0 and stats["too_long"] == 0 and stats["total"] == made.count()
    with pytest.raises(ValueError):
        chunkers.ChunkConfig(max_tokens=10, overlap=10)


def test_short_pieces_merge(spark):
    df = frame(spark, ["# A\nA long enough sentence that stands first here.\n\nTiny."])
    out = chunkers.semantic_chunks(df, embed.hashing_embedder(8), config=chunkers.ChunkConfig(max_tokens=60, overlap=5, min_tokens=5, percentile=0.0))
    assert out.count() >= 1 and not out.where("token_count > 60").count()


def failing():
    def encode(texts):
        raise RuntimeError("no model")

    return encode


def test_failed_embedding(spark):
    df = frame(spark, ["# A\nOne sentence here. Another one there. A third."])
    bad = embed.embedder(failing, embed.EmbedderConfig("m"), null_on_error=True)
    rows = chunkers.semantic_chunks(df, bad, config=chunkers.ChunkConfig(max_tokens=60, overlap=5, min_tokens=5, raise_on_error=False)).collect()
    assert len(rows) == 1 and rows[0]["semantic_fallback"] and not rows[0]["was_split"]
    with pytest.raises(Exception, match="embedding failed"):
        chunkers.semantic_chunks(df, bad, config=chunkers.ChunkConfig(max_tokens=60, overlap=5, min_tokens=5)).collect()


def test_html(spark):
    page = "<html><head><title>x</title></head><body><!-- c --><script>if (a</p>b) {}</script><h1>Title &amp; more</h1><p>One<br>two <b>bold<p>Three<ul><li>a<li>b</ul><h2>Sub</h2>end"
    got = column(spark, [page, ""], pages.html_to_markdown)
    assert got[0] == "# Title & more\n\nOne\ntwo bold\n\nThree\n\n- a\n- b\n\n## Sub\n\nend\n" and got[1] == "\n"
    assert column(spark, ["&lt;b&gt; &eacute;"], tx.unescaped) == [html.unescape("&lt;b&gt; &eacute;")]


def test_files(spark, tmp_path):
    (tmp_path / "a_clean.md").write_text("# A\ntext")
    (tmp_path / "b.pdf").write_bytes(b"good")
    (tmp_path / "c.pdf").write_bytes(b"\xff\xff")
    assert [tuple(r) for r in pages.text_files(spark, f"file://{tmp_path}").collect()] == [("a_clean.md", "# A\ntext")]
    files = pages.with_ocr(pages.binary_files(spark, f"file://{tmp_path}"), spark.createDataFrame([("b.pdf", True)], "source string, force_ocr boolean"))
    good, bad = pages.parsed(files, lambda content, force, languages: (content.decode(), 1), ("en", "en", "vi"))
    assert [(r["source"], r["markdown"], r["force_ocr"], r["languages"]) for r in good.collect()] == [("b.pdf", "good", True, ["en", "vi"])]
    assert [r["source"] for r in bad.collect()] == ["c.pdf"]
    assert [r["source"] for r in pages.only_new(files, good).collect()] == ["c.pdf"]
    with pytest.raises(ValueError):
        pages.binary_files(spark, f"file://{tmp_path}", "*.docx")

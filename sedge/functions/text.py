"""Text functions: normalising, tokens, breadcrumbs, ids. Columns in, columns out; Python only where Spark has no equal."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The symbol-font code points that stand for signs, and the decorative ones to delete.
SYMBOL_SIGNS = {"\uf0b3": "≥", "\uf0a3": "≤", "\uf062": "β"}
SYMBOL_DECORATION = ("\uf02b", "\uf0b7")

# Fixed value: the namespace of RFC 4122 for URLs, for point ids.
POINT_NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"

#: What ends a line for str.splitlines().
LINE_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


@F.pandas_udf(T.StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(T.StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else html.unescape(t))


def nfc(text: Column) -> Column:
    """Unicode NFC; ASCII texts are normal already, so Python gets only a null for them."""
    return F.coalesce(_nfc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def unescaped(text: Column) -> Column:
    """HTML entities decoded, all named ones too; Python gets only texts with an ampersand."""
    return F.coalesce(_unescape(F.when(F.contains(text, F.lit("&")), text)), text)


def newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def symbols(text: Column) -> Column:
    """Symbol-font signs replaced, decoration deleted, in one pass."""
    return F.translate(text, "".join(SYMBOL_SIGNS) + "".join(SYMBOL_DECORATION), "".join(SYMBOL_SIGNS.values()))


def replaced(text: Column, table: dict[str, str]) -> Column:
    """Literal replacements in order, such as a map for legacy fonts."""
    for old, new in table.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def normalised(text: Column, legacy: dict[str, str] | None = None) -> Column:
    """All steps that come before lines: newlines, NFC, entities, legacy fonts, symbols."""
    return symbols(replaced(unescaped(nfc(newlines(text))), legacy or {}))


def split_lines(text: Column) -> Column:
    """As str.splitlines(): no empty last line."""
    lines = F.split(text, LINE_BREAKS)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def evidence_tokens(text: Column, normal: bool = True) -> Column:
    """Tokens for matching evidence: markup to spaces, dashes alike, words with a decimal part, comparison signs, per cent."""
    t = F.lower(nfc(text) if normal else text)
    t = F.regexp_replace(t, "[–—]", "-")
    t = F.regexp_replace(t, r"[#*_`>|]+", " ")
    return F.regexp_extract_all(t, F.lit(r"[\p{L}\p{N}_]+(?:[.,]\p{Nd}+)?|>=|<=|≥|≤|>|<|%"), F.lit(0))


def words(text: Column) -> Column:
    """The lexical index's default tokens: lower case, parted by white space."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def first_tokenizer(*named: tuple[str, Callable[[], Callable[[Column], Column]]]) -> Callable[[Column], Column]:
    """The first word tokenizer of a chain whose maker can import what it needs, else words(); its tokenizer_name is recorded with an index."""
    for name, make in named:
        try:
            tokens = make()
        except ImportError:
            continue
        tokens.tokenizer_name = name
        return tokens
    return words


words.tokenizer_name = "whitespace"


def token_count(text: Column) -> Column:
    """The default, additive token counter: words and single symbols. Recorded by this name in manifests."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"))


def breadcrumb(*levels: Column) -> Column:
    return F.concat_ws(" > ", *levels)


def with_breadcrumb(piece: Column, crumb: Column) -> Column:
    return F.when(F.coalesce(crumb, F.lit("")) == "", piece).otherwise(F.concat(F.lit("["), crumb, F.lit("]\n"), piece))


def without_breadcrumb(text: Column) -> Column:
    """A first line that is wholly in brackets goes."""
    return F.regexp_replace(text, r"\A\[[^\n]*\](?:\n|\z)", "")


def point_id(chunk_id: Column, namespace: str = POINT_NAMESPACE) -> Column:
    """uuid5 of the chunk id: SHA-1 of namespace and name, with version and variant bits set."""
    raw = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(chunk_id, "UTF-8")))
    part = lambda a, n: F.substring(raw, a, n)
    variant = F.substring(F.lower(F.hex(F.conv(part(17, 2), 16, 10).cast("long").bitwiseAND(0x3F).bitwiseOR(0x80))), -2, 2)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(19, 2)), part(21, 12))

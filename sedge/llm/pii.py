"""Personal data: patterns propose spans, checksums confirm them, context words nearby move their score.

The base kinds (email, ip, card, phone) follow the contract exactly and always stay. The method adds iban (mod-97),
ssn and local_phone (by context). A span is (kind, start, end, score), in code points, end exclusive, score 0 to 1.

Defined results: a null text counts as empty; every scan is linear in the text; added spans that touch a base span
are dropped; redaction replaces overlapping spans by the mark of the first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedge.llm.common import drop_copies, small_batches, trim

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "local_phone")
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only begin at the start of a run of digits, which keeps the scan linear
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
LOCAL_PHONE = re.compile(r"(?<![0-9+(.-])(?:\([0-9]{3}\)|[0-9]{3})[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])")

#: Score without context, and words that raise it when one stands within REACH code points.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.4, "local_phone": 0.3}
CONTEXT = {
    "email": ("mail", "contact", "write", "correo"),
    "ip": ("ip", "address", "server", "host", "login"),
    "card": ("card", "visa", "credit", "payment", "tarjeta", "karte", "carte"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "anruf", "appel"),
    "iban": ("iban", "account", "konto", "compte", "cuenta", "bank"),
    "ssn": ("ssn", "social", "security", "tax", "id"),
    "local_phone": ("phone", "tel", "call", "mobile", "fax"),
}
#: Words that lower the score of what looks like a number for something else.
AGAINST = {"ip": ("version", "release", "section"), "card": ("isbn", "order", "invoice"), "ssn": ("isbn", "part"), "local_phone": ("isbn", "order", "part")}
REACH, BONUS, MALUS, KEEP = 40, 0.35, 0.3, 0.6
LETTERS = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def mod97(text: str) -> bool:
    """The IBAN checksum of letters and digits."""
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The local part can't hold an @, so each @ has one candidate: the run before it, back to the last match."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            last = m.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            yield m.span()


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            yield m.span()


def ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in IBAN.finditer(text):
        # words that follow may have been taken too: the longest stretch of groups that the checksum confirms
        ends = [i for i in range(15, len(m[0]) + 1) if i == len(m[0]) or m[0][i] == " "]
        for end in reversed(ends):
            if 15 <= len(whole := m[0][:end].replace(" ", "")) <= 34 and mod97(whole):
                yield m.start(), m.start() + end
                break


def ssns(text: str) -> Iterator[tuple[int, int]]:
    for m in SSN.finditer(text):
        if m[1] not in ("000", "666") and m[1][0] != "9" and m[2] != "00" and m[3] != "0000":
            yield m.span()


def local_phones(text: str) -> Iterator[tuple[int, int]]:
    for m in LOCAL_PHONE.finditer(text):
        yield m.span()


def scored(text: str, kind: str, start: int, end: int) -> float:
    near = {w.lower() for w in LETTERS.findall(text[max(0, start - REACH) : start]) + LETTERS.findall(text[end : end + REACH])}
    score = PRIOR[kind] + BONUS * any(w in near for w in CONTEXT[kind]) - MALUS * any(w in near for w in AGAINST.get(kind, ()))
    return round(min(1.0, max(0.0, score)), 3)


def find(text: str) -> list[dict]:
    """All spans of one text, by kind in the order of KINDS, then start."""
    out: list[tuple[str, int, int]] = []
    if "@" in text:
        out += [("email", *s) for s in emails(text)]
    out += [("ip", *s) for s in ips(text)]
    out += [("card", *s) for s in cards(text)]
    if "+" in text:
        out += [("phone", *s) for s in phones(text)]
    base = sorted((s, e) for _, s, e in out)
    more = [("iban", *s) for s in ibans(text)] + [("ssn", *s) for s in ssns(text)] + [("local_phone", *s) for s in local_phones(text)]
    spans = [{"kind": k, "start": s, "end": e, "score": scored(text, k, s, e)} for k, s, e in out]
    for k, s, e in more:
        score = scored(text, k, s, e)
        if score >= KEEP and not any(s < y and x < e for x, y in base):
            spans.append({"kind": k, "start": s, "end": e, "score": score})
    return spans


def redacted(text: str, spans: list[dict]) -> str:
    """The text with each span, or union of overlapping ones, replaced by its mark."""
    parts, at = [], 0
    for span in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if span["start"] >= at:
            parts += [text[at : span["start"]], f"[{span['kind'].upper()}]"]
        at = max(at, span["end"])
    return "".join([*parts, text[at:]])


@F.arrow_udf(SPANS)
def pii_spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    drop_copies()
    for texts in batches:
        yield pa.array([find(t or "") for t in texts.to_pylist()], SPAN_TYPE)
        trim()


@F.arrow_udf(T.StringType())
def redacted_text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    drop_copies()
    for texts in batches:
        yield pa.array([redacted(t, find(t)) if t else t for t in texts.to_pylist()], pa.string())
        trim()


def with_spans(df: DataFrame, text: str = "text", name: str = "spans") -> DataFrame:
    """df with the spans of its text in a column that replaces any of that name; a null text has none."""
    small_batches(df.sparkSession)
    return df.withColumn(name, pii_spans(F.col(text)))


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the spans in its text replaced by marks such as [EMAIL]; no row goes."""
    small_batches(df.sparkSession)
    return df.withColumn(text, redacted_text(F.col(text)))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))

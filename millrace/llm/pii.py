"""Operator 3, personal data: patterns propose spans, checksums confirm them, context adjusts the score.

Every document is read whole by one task; nothing is shuffled. Each pattern is scanned in time linear in
the text (possessive runs, and e-mail local parts are read backwards from the ``@``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_NOT_DIGIT = re.compile(r"[^0-9]")

#: Score of a confirmed span, and what a context word within REACH characters adds.
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.85, "ssn": 0.4}
CONTEXT = {
    "email": re.compile(r"(?i)mail|contact|write to"),
    "ip": re.compile(r"(?i)\bip\b|address|host|server"),
    "card": re.compile(r"(?i)card|visa|credit|payment|amex"),
    "phone": re.compile(r"(?i)phone|call|tel|mobile|fax"),
    "iban": re.compile(r"(?i)iban|bank|account|konto|cuenta|compte"),
    "ssn": re.compile(r"(?i)ssn|social|security"),
}
ADD, REACH = 0.1, 40
#: Kinds outside the base need this score to be reported; a bare 3-2-4 number so needs a context word.
LEAST = 0.5


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Check digits of ISO 13616: the first four characters go last, letters become 10 to 35."""
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    low, at = 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at + 1)
        start = at
        if m:
            while start > low and text[start - 1] in _LOCAL:
                start -= 1
        if m and start < at:
            yield start, m.end()
            low = m.end()
            at = text.find("@", low)
        else:
            at = text.find("@", at + 1)


def find_spans(text: str) -> list[tuple[int, int, int, float]]:
    """(start, end, number of the kind, score) in order; offsets are code points, the end is exclusive."""
    found = []
    if "@" in text:
        found += [(s, e, 0) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                found.append((m.start(), m.end(), 3))
    for m in _IBAN.finditer(text):
        if len(code := m[0].replace(" ", "")) >= 15 and mod97(code):
            found.append((m.start(), m.end(), 4))
    for m in _SSN.finditer(text):
        found.append((m.start(), m.end(), 5))
    out = []
    for s, e, k in sorted(found, key=lambda x: (x[0], x[2])):
        kind = KINDS[k]
        near = CONTEXT[kind].search(text, max(0, s - REACH), s) or CONTEXT[kind].search(text, e, e + REACH)
        score = round(SCORE[kind] + (ADD if near else 0), 3)
        if k < len(BASE) or score >= LEAST:
            out.append((s, e, k, score))
    return out


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``spans`` array<struct<kind, start, end, value, score>>, in order, for every row.

    Null text counts as empty and has no spans; a null id is carried through; repeated rows each give a
    row; an empty table gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            spans = []
            for text in pdf["t"]:
                spans.append([(KINDS[k], s, e, text[s:e], score) for s, e, k, score in find_spans(text)])
            names = ("kind", "start", "end", "value", "score")
            yield pd.DataFrame({"doc_id": pdf["id"], "spans": [[dict(zip(names, x, strict=True)) for x in y] for y in spans]})

    schema = "doc_id long, spans array<struct<kind string, start long, end long, value string, score double>>"
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return rows.mapInPandas(run, schema)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from the spans of ``detect``."""
    text = lambda only: F.array_join(
        F.transform(
            F.filter("spans", lambda x: x["kind"].isin(*BASE)) if only else F.col("spans"),
            lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")),
        ), ",",
    )
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(text(True).cast("binary"), 256).alias("base_sha256"),
        text(False).alias("spans"), *[count(k).alias(f"n_{k}") for k in KINDS[len(BASE) :]],
        F.coalesce(F.array_max(F.transform("spans", lambda x: x["score"])), F.lit(0.0)).alias("top_score"),
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the text with every span replaced by its kind in angle brackets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text in pdf["t"]:
                parts, low = [], 0
                for s, e, k, _ in find_spans(text):
                    if s >= low:
                        parts += [text[low:s], f"<{KINDS[k]}>"]
                    low = max(low, e)
                out.append("".join([*parts, text[low:]]))
            yield pd.DataFrame({"doc_id": pdf["id"], "text": out})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return rows.mapInPandas(run, "doc_id long, text string")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(detect(table(spark, sf_dir, "documents")))

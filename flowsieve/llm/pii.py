"""Operator 4, personal data: patterns propose spans, checksums confirm them, words nearby move their score.

Every kind has a prior. A confirmed checksum and a context word near the span raise the score, and a
kind that is not one of the base kinds is reported from THRESHOLD on. Spans of the base kinds stay
whatever their score; the score is for the reader. Spans are in code points, the end exclusive.

All patterns begin where a run of their characters begins, so each takes time in proportion to the
text, however long its runs are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve.llm.common import slices, table

# The base kinds in their order, then the kinds that the method adds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")
# Score of a bare match, and of a match whose check holds.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.3, "phone": 0.6, "iban": 0.3, "ssn": 0.4}
CHECKED = {"card": 0.8, "iban": 0.9}
# Words that speak for a kind when they stand near a span.
CONTEXT = {
    "email": "email mail contact write",
    "ip": "ip address host server login",
    "card": "card visa mastercard credit karte carte tarjeta",
    "phone": "phone call tel telephone mobile fax telefon",
    "iban": "iban bank account konto compte cuenta",
    "ssn": "ssn social security number",
}
NEAR = 0.2
THRESHOLD = 0.6
#: Code points on each side of a span in which a context word counts.
WINDOW = 48
#: Least and most digits of a card and of a phone number.
CARD_DIGITS = (14, 19)
PHONE_DIGITS = (10, 15)

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_DIGIT = re.compile("[0-9]")
_WORDS = {k: re.compile(r"(?<!\w)(?:" + "|".join(v.split()) + r")(?!\w)", re.I) for k, v in CONTEXT.items()}


class Span(NamedTuple):
    start: int
    kind: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    """The Luhn check: from the right, every second digit is doubled and its digits are added."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = (ord(c) - 48) << (k & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod_97(code: str) -> bool:
    """The ISO 7064 check of account numbers: country and check digits go last, letters become numbers."""
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 2 * CARD_DIGITS[1]:
            digits = m[0].replace(" ", "").replace("-", "")
            if CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if PHONE_DIGITS[0] <= sum(c.isdigit() for c in m[0]) <= PHONE_DIGITS[1]:
            yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in _IBAN.finditer(text):
        if mod_97(m[0].replace(" ", "")):
            yield m.span()


def _score(text: str, kind: str, start: int, end: int) -> float:
    near = _WORDS[kind].search(text[max(0, start - WINDOW) : start]) or _WORDS[kind].search(text[end : end + WINDOW])
    return min(1.0, CHECKED.get(kind, PRIOR[kind]) + (NEAR if near else 0.0))


def find_spans(text: str | None) -> list[Span]:
    """All spans of a text by start, then by kind in the order of KINDS."""
    if not text:
        return []
    finders = [("email", _emails)] if "@" in text else []
    if _DIGIT.search(text):
        finders += [("ip", _ips), ("card", _cards), ("iban", _ibans), ("ssn", lambda t: (m.span() for m in _SSN.finditer(t)))]
        if "+" in text:
            finders.append(("phone", _phones))
    found = []
    for kind, finder in finders:
        for start, end in finder(text):
            score = _score(text, kind, start, end)
            if kind in BASE_KINDS or score >= THRESHOLD:
                found.append(Span(start, KINDS.index(kind), end, score))
    return sorted(found)


def masked(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span, or run of overlapping spans, replaced by the name of its first kind."""
    if not spans:
        return text
    out, done, k = [], 0, 0
    while k < len(spans):
        start, kind, end, _ = spans[k]
        while k + 1 < len(spans) and spans[k + 1].start < end:
            k += 1
            end = max(end, spans[k].end)
        out += [text[done:start], f"<{KINDS[kind].upper()}>"]
        done, k = end, k + 1
    return "".join([*out, text[done:]])


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[s.kind]}:{s.start}:{s.end}" for s in spans)


def mask(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with the personal data in its texts masked; null, empty and clean texts stay as they are."""
    place, names = df.columns.index(text_col), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            column = batch.column(place)
            texts = [masked(t, find_spans(t)) for t in column.to_pylist()]
            yield batch.set_column(place, batch.schema.field(place), pa.array(texts, column.type))

    out = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema])
    return df.mapInArrow(run, out).select(*names)


_COUNTS = [f"n_{k}" for k in BASE_KINDS]
_NEW = [*((c, T.LongType(), pa.int64()) for c in _COUNTS), ("base_sha256", T.StringType(), pa.string()), ("spans", T.StringType(), pa.string()), ("scores", T.ArrayType(T.DoubleType()), pa.list_(pa.float64()))]


def find(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df without its text, with the counts of base spans, base_sha256, spans and their scores.

    One row for each row, equal rows included. A null text is an empty one: no spans. Texts of any
    length are read whole. Columns of df with the names of new columns are replaced.
    """
    new = [n for n, _, _ in _NEW]
    kept = [f for f in df.schema if f.name.lower() not in {*new, text_col.lower()}]
    places, place = [df.columns.index(f.name) for f in kept], df.columns.index(text_col)

    def row(text: str | None) -> tuple:
        spans = find_spans(text)
        base = [s for s in spans if s.kind < len(BASE_KINDS)]
        kinds = [s.kind for s in base]
        return (*(kinds.count(k) for k in range(len(BASE_KINDS))), sha256(_joined(base).encode()).hexdigest(), _joined(spans), [round(s.score, 6) for s in spans])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [row(t) for t in batch.column(place).to_pylist()]
            made = [pa.array([r[k] for r in rows], kind) for k, (_, _, kind) in enumerate(_NEW)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in places), *made], [*(f.name for f in kept), *new])

    return df.mapInArrow(run, T.StructType([*(T.StructField(f.name, f.dataType) for f in kept), *(T.StructField(n, t) for n, t, _ in _NEW)]))


def op4_pii(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id"), F.col("text"))
    return find(docs).select("doc_id", *_COUNTS, "base_sha256", "spans", "scores")

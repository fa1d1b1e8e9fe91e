"""Personal data: regular expressions propose spans, checks confirm them, context moves their score.

Base kinds are reported whenever their pattern and check hold; the kinds that the method adds
(IBAN, checked modulo 97; US social security number) only from a score of ``LEAST`` on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import bounded_batches, carried, text_slices
from plumbline.llm.textbuf import buffers

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
LEAST = 0.5
NEAR = 48

# Each kind's score before its context, and words that raise it.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
CONTEXT = {
    "email": "mail contact write",
    "ip": "ip address host server login",
    "card": "card credit visa mastercard amex payment",
    "phone": "phone tel call mobile fax cell",
    "iban": "iban account bank konto",
    "ssn": "ssn social security",
}
# Characters of an IBAN by country (ISO 13616).
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20,
    "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27,
    "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24,
    "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]+)")  # a later start in a run of digits fares no better
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_CONTEXT = {k: re.compile(r"\b(?:" + "|".join(v.split()) + r")", re.I) for k, v in CONTEXT.items()}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d) % 9 or (9 if d else 0)
    return total % 10 == 0


def mod97(account: str) -> bool:
    """Whether an IBAN without spaces has a right check number."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def _is_byte(digits: str) -> bool:
    """Whether a number, however many zeros it begins with, is at most 255."""
    digits = digits.lstrip("0")
    return len(digits) < 4 and int(digits or "0") < 256


def _emails(text: str) -> Iterator[tuple[int, int]]:
    after, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            after = m.end()
        at = text.find("@", m.end() if m else at + 1)


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while m := _IBAN.search(text, at):
        at = m.start() + 1
        left, end = IBAN_LENGTHS.get(m[1], 0), m.start()
        while left and end < m.end():
            left -= text[end] != " "
            end += 1
        if not left and IBAN_LENGTHS.get(m[1]) and not text[end : end + 1].isalnum() and mod97(text[m.start() : end].replace(" ", "")):
            yield m.start(), end
            at = end


def find_spans(text: str, has_at: bool = True, has_digit: bool = True) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of all spans, by start and then in the kinds' order; code points."""
    found: list[tuple[int, int, int]] = []
    if has_at:
        found += [(a, 0, b) for a, b in _emails(text)]
    if has_digit:
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_is_byte, m.groups()))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
        found += [(a, 4, b) for a, b in _ibans(text)]
        found += [(m.start(), 5, m.end()) for m in _SSN.finditer(text)]
    out = []
    for start, k, end in sorted(found):
        kind = KINDS[k]
        near = _CONTEXT[kind].search(text[max(0, start - NEAR) : start]) or _CONTEXT[kind].search(text[end : end + NEAR // 2])
        score = min(1.0, SCORES[kind] + 0.3 * bool(near))
        if kind in BASE or score >= LEAST:
            out.append((kind, start, end, round(score, 2)))
    return out


def redact(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its (first) kind."""
    out, at = [], 0
    for kind, start, end, _ in spans:
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_redacted: bool = False) -> DataFrame:
    """For each document: the id column, spans (array of kind, start, end, score) and, with
    ``with_redacted``, row: a struct of all its columns in which the text's spans are replaced by
    their kinds.

    A null text is empty and has no spans (in a row it stays null); repeated rows have a row each.
    Positions count code points; ends are exclusive.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
    bounded_batches(docs.sparkSession)
    digit = np.isin(np.arange(256), range(48, 58))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 0, fill=False):
                data, off = buffers(pc.fill_null(part.column(0), ""))
                digits, ats = (np.diff(np.concatenate([[0], np.cumsum(x)])[off]) > 0 for x in (digit[data], data == 64))
                spans: list[list[dict]] = [[] for _ in range(part.num_rows)]
                changed: dict[int, str] = {}
                for i in np.flatnonzero(digits | ats).tolist():
                    text = part.column(0)[i].as_py()
                    own = find_spans(text, bool(ats[i]), bool(digits[i]))
                    spans[i] = [dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in own]
                    if own and with_redacted:
                        changed[i] = redact(text, own)
                columns = [*part.columns[1:], pa.array(spans, pa.list_(span))]
                if with_redacted:
                    mask = np.zeros(part.num_rows, bool)
                    mask[list(changed)] = True
                    columns.append(pc.replace_with_mask(part.column(0), pa.array(mask), pa.array(list(changed.values()), part.column(0).type)))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col(text_col).alias("_text"), F.col(id_col).alias("_id"), *([carried(docs, [c for c in docs.columns if c != text_col]).alias("_rest")] if with_redacted else []))
    kinds = dict(rows.dtypes) | {"spans": "array<struct<kind:string,start:bigint,end:bigint,score:double>>"}
    names = ["_id", *(["_rest"] if with_redacted else []), "spans", *(["_text"] if with_redacted else [])]
    out = rows.mapInArrow(find, ", ".join(f"{c} {kinds[c]}" for c in names))
    row = F.struct(*((F.col("_text") if c == text_col else F.col(f"_rest.`{c}`")).alias(c) for c in docs.columns)).alias("row")
    return out.select(F.col("_id").alias(id_col), "spans", *([row] if with_redacted else []))


def span_list(spans: Column | str, kinds: tuple[str, ...] | None = None) -> Column:
    """Spans, or those of some kinds, as kind:start:end joined by commas."""
    own = F.filter(spans, lambda s: s["kind"].isin(*kinds)) if kinds else F.col(spans)
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_report(found: DataFrame, id_col: str, base: tuple[str, ...]) -> DataFrame:
    """One row a document: how many spans there are of each base kind, a digest of the base spans,
    all spans and, where spans have scores, their scores in the same order."""
    def of(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    count = [of(k) for k in base]
    scored = "score" in found.schema["spans"].dataType.elementType.names
    scores = F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",").alias("scores")
    return found.select(id_col, *count, F.sha2(span_list("spans", base), 256).alias("base_sha256"), span_list("spans").alias("spans"), *([scores] if scored else []))

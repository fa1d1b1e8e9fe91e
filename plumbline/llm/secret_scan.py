"""Secrets: an Aho-Corasick automaton finds keywords, regular expressions are tried at its hits
only, and checksums embedded in tokens confirm them.

Base kinds are reported whenever their pattern holds; the kinds that the method adds need a right
checksum (GitHub and npm tokens), a decodable header (JSON web tokens) or a fixed form.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm.shared import bounded_batches, text_slices
from plumbline.llm.textbuf import buffers

KINDS = ("assign", "access", "hex", "github", "npm", "slack", "google", "stripe", "private_key", "jwt")
BASE = KINDS[:3]
HEX_LEAST = 32

# What the automaton looks for, in small letters, and the kind tried there.
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "slack": ("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-"),
    "google": ("aiza",),
    "stripe": ("sk_live_", "rk_live_"),
    "private_key": ("-----begin",),
    "jwt": ("eyj",),
}
# The forms, tried at the place of a keyword.
PATTERNS = {
    "assign": re.compile(r"""(?:password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "github": re.compile(r"gh[opsur]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "npm": re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "slack": re.compile(r"xox[abprs]-[0-9A-Za-z-]{10,}"),
    "google": re.compile(r"AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])"),
    "stripe": re.compile(r"[rs]k_live_[0-9A-Za-z]{16,}"),
    "private_key": re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    "jwt": re.compile(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
}
_RUN = re.compile(r"[A-Za-z0-9_-]+")  # what follows it decides for every start of a token inside
_HEX = re.compile(r"[0-9a-f]{%d,}" % HEX_LEAST)
_IS_HEX = np.isin(np.arange(256), [*range(48, 58), *range(97, 103)])
_DIGITS62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def base62(n: int, width: int) -> str:
    out = ""
    while n:
        n, d = divmod(n, 62)
        out = _DIGITS62[d] + out
    return out.rjust(width, "0")


def checksum_holds(token: str) -> bool:
    """Whether the last six characters are the CRC-32 of those before (after the prefix) in base 62."""
    body = token.split("_", 1)[1]
    return base62(zlib.crc32(body[:-6].encode()), 6) == body[-6:]


def _jwt_header(token: str) -> bool:
    head = token.split(".", 1)[0]
    try:
        found = json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, RecursionError):  # no base64, no JSON, or one nested too deep to be a header
        return False
    return isinstance(found, dict) and "alg" in found


def _confirmed(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[1]) >= 8
    if kind == "access":
        return len(m[0]) >= 16
    if kind in ("github", "npm"):
        return checksum_holds(m[0])
    return kind != "jwt" or _jwt_header(m[0])


def find_spans(text: str, small: str | None = None, has_hex: bool = True) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans, by start and then in the kinds' order; code points.
    ``small`` is the text with A-Z made small.  Matches of a kind don't overlap: the leftmost goes
    first, and one that is not confirmed still takes its place."""
    small = text.encode().lower().decode() if small is None else small
    after = dict.fromkeys(KINDS, 0)
    found: list[tuple[int, int, int]] = []
    hits = sorted((end - n + 1, kind) for end, (kind, n) in _automaton().iter(small))
    for start, kind in hits:
        if start >= after[kind] and (m := PATTERNS[kind].match(text, start)):
            after[kind] = m.end()
            if _confirmed(kind, m):
                found.append((start, KINDS.index(kind), m.end()))
        elif kind == "jwt" and start >= after[kind]:
            after[kind] = _RUN.match(text, start).end()
    if has_hex:
        found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its (first) kind."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_redacted: bool = False) -> DataFrame:
    """For each document: the id column, spans (array of kind, start, end) and, with
    ``with_redacted``, redacted: the text with its spans replaced by their kinds.

    A null text is empty and has no spans (its redacted text is empty too); repeated rows have a
    row each.  Positions count code points; ends are exclusive.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    bounded_batches(docs.sparkSession)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 1):
                data, off = buffers(part.column(1))
                gaps = np.concatenate([[-1], np.flatnonzero(~_IS_HEX[data]), [len(data)]])
                long = gaps[:-1][np.diff(gaps) > HEX_LEAST]  # before runs of hex digits, texts' ends ignored
                near = np.zeros(part.num_rows + 1, bool)
                for a, b in zip(long, gaps[1:][np.diff(gaps) > HEX_LEAST], strict=True):
                    near[np.searchsorted(off, a + 1, "right") - 1 : np.searchsorted(off, b, "right")] = True
                spans, red = [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    small = text.lower() if text.isascii() else text.encode().lower().decode()
                    own = find_spans(text, small, bool(near[i]))
                    spans.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in own])
                    red.append(redact(text, own) if with_redacted else None)
                columns = [part.column(0), pa.array(spans, pa.list_(span)), *([pa.array(red, pa.string())] if with_redacted else [])]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [id_col, "spans", *(["redacted"] if with_redacted else [])]
    schema = f"`{id_col}` {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>" + ", redacted string" * with_redacted
    return docs.select(id_col, text_col).mapInArrow(find, schema)

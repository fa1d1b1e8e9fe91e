"""Arrow-batched Python functions, for what no built-in expression can say."""

from __future__ import annotations

import difflib
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

DIMENSIONS = 384
_TOKEN = re.compile(r"\w+|[^\w\s]")


def encode_texts(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """A unit vector of hashed tokens and token pairs for each text; equal texts have equal vectors.
    A text without tokens has the first unit vector."""
    found = [_TOKEN.findall(t) for t in texts]
    of = np.repeat(np.arange(len(texts)), list(map(len, found)))
    numbers: dict[str, int] = {}
    token = np.array([numbers.setdefault(t, len(numbers)) for own in found for t in own], np.int64)
    raw = [t.encode("utf-8", "surrogatepass") for t in numbers]
    crc = np.array([zlib.crc32(t) for t in raw], np.int64)
    side = np.flatnonzero(of[1:] == of[:-1])
    pairs, pair = np.unique(token[side] * len(raw) + token[side + 1], return_inverse=True)
    pair_crc = np.array([zlib.crc32(raw[p % len(raw)], zlib.crc32(b" ", int(crc[p // len(raw)]))) for p in pairs.tolist()], np.int64)
    h = np.concatenate([crc[token], pair_crc[pair]])
    where = np.concatenate([of, of[side]]) * dimensions + (h >> 1) % dimensions
    out = np.bincount(where, np.where(h & 1, 1.0, -1.0), len(texts) * dimensions).reshape(-1, dimensions)
    norm = np.linalg.norm(out, axis=1)
    out[norm == 0, 0] = norm[norm == 0] = 1.0
    return (out / norm[:, None]).astype(np.float32)


#: Texts that an encoder gets at once.
BATCH = 256


def encoder(encode=encode_texts, batch: int = BATCH):
    """An encoder column: any function from a list of texts to an array of unit vectors can take the
    default's place.  It is called with up to ``batch`` different texts at a time, and what it loads it
    should keep for the worker.  A null is encoded as an empty text."""

    @F.pandas_udf("array<float>")
    def vectors(text: pd.Series) -> pd.Series:
        own = text.fillna("").tolist()
        texts = list(dict.fromkeys(own))
        of = dict(zip(texts, (v for a in range(0, len(texts), batch) for v in np.asarray(encode(texts[a : a + batch]), np.float32)), strict=True))
        return pd.Series([of[t] for t in own], dtype=object)

    return vectors


def sequence_ratio(q_prints, c_prints, q_text, c_text):
    """2M/T of two fingerprints, or of the normalized texts if either has none.  The standard
    library's rule on popular elements (of second sequences of 200 or more) holds, so the ratio
    depends on the order.  What the library works out of a second sequence is kept for a batch, and
    so is the ratio of a pair of sequences."""

    @F.pandas_udf("double")
    def ratio(qp: pd.Series, cp: pd.Series, qt: pd.Series, ct: pd.Series) -> pd.Series:
        seconds: dict[tuple | str, difflib.SequenceMatcher] = {}
        known: dict[tuple, float] = {}

        def one(a, b, s, t):
            a, b = (tuple(x) if x is not None else () for x in (a, b))
            if not (a and b):
                a, b = s or "", t or ""
            if (a, b) not in known:
                if b not in seconds:
                    seconds[b] = difflib.SequenceMatcher(None, "", b)
                seconds[b].set_seq1(a)
                known[a, b] = seconds[b].ratio()
            return known[a, b]

        return pd.Series([one(*x) for x in zip(qp, cp, qt, ct, strict=True)], dtype="float64")

    return ratio(q_prints, c_prints, q_text, c_text)

"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of 1 to 3 characters of the text in small letters are hashed into ``2**BITS`` features.
Document frequencies are counted over all learnable documents.  Weights are fitted on a bounded
sample by follow-the-regularised-leader (proximal, per coordinate) with an elastic-net penalty;
most become zero.  A temperature, fitted on a part of the sample that the weights never saw, makes
probabilities of the scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.sampling import held_out, labelled_sample
from plumbline.llm.shared import bounded_batches, carried, text_slices

BITS = 15
NGRAMS = (1, 2, 3)
SAMPLE_ROWS = 1200
SAMPLE_BYTES = 24 << 20
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.5, 3
UNKNOWN = "und"
#: Characters whose n-grams are counted at once.
PIECE = 1 << 19


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _counts(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, count) of every n-gram feature of each text, in this order.  Characters are
    taken ``PIECE`` at a time, so that a long text needs little more than itself."""
    n = np.zeros(len(texts) << bits, np.int64)
    small, size, first = [], 0, 0
    for i, text in enumerate(texts):
        text = text.lower()
        if size and size + len(text) > PIECE:
            _add(n, small, first, bits)
            small, size, first = [], 0, i
        if len(text) <= PIECE:
            small.append(text)
            size += len(text)
            continue
        for a in range(0, len(text), PIECE):
            _add(n, [text[a : a + PIECE + NGRAMS[-1] - 1]], i, bits, PIECE)
        first = i + 1
    _add(n, small, first, bits)
    key = np.flatnonzero(n)
    return key >> bits, key & ((1 << bits) - 1), n[key]


def _add(n: np.ndarray, small: list[str], first: int, bits: int, starts: int | None = None) -> None:
    """Adds the n-grams of some texts, the first of which has the number ``first``, to the counts;
    with ``starts`` only those that begin before it."""
    off = np.cumsum([0, *map(len, small)])
    c = np.frombuffer("".join(small).encode("utf-32-le", "surrogatepass"), "<u4")
    of = np.repeat(np.arange(first, first + len(small)), np.diff(off))
    g = np.zeros(len(c), np.uint32)
    for k in NGRAMS:
        if len(c) < k:
            break
        g = g[: len(c) - k + 1] * np.uint32(0x01000193) + c[k - 1 :] + np.uint32(k)
        mixed = (g ^ (g >> np.uint32(15))) * np.uint32(0x9E3779B1)
        inside = of[: len(g)] == of[k - 1 :]
        if starts is not None:
            inside[starts:] = False
        key = ((of[: len(g)] << bits) + (mixed >> np.uint32(32 - bits)))[inside]
        if starts is None:
            n += np.bincount(key, minlength=len(n))
        else:
            at = first << bits
            n[at : at + (1 << bits)] += np.bincount(key - at, minlength=1 << bits)


def _groups(texts: list[str], bits: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of which the dense count table stays small."""
    step = max(1, (1 << 21) >> bits)
    for a in range(0, len(texts), step):
        yield a, min(len(texts), a + step)


def document_frequencies(docs: DataFrame, text_col: str = "text", bits: int = BITS) -> np.ndarray:
    """In how many texts each feature occurs; a task sends at most one row a feature."""
    bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for part in text_slices(batch, 0):
                texts = part.column(0).to_pylist()
                for a, b in _groups(texts, bits):
                    df += np.bincount(_counts(texts[a:b], bits)[1], minlength=1 << bits)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["feature", "n"])

    total = np.zeros(1 << bits, np.int64)
    for r in docs.select(text_col).mapInArrow(count, "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).toLocalIterator():
        total[r["feature"]] = r["n"]
    return total


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float
    bits: int

    def vectors(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, feature, value) of the texts' unit TF-IDF vectors."""
        of, feature, n = _counts(texts, self.bits)
        value = (1 + np.log(n)) * self.idf[feature]
        norm = np.sqrt(np.bincount(of, value * value, len(texts)))
        return of, feature, value / norm[of]

    def scores(self, texts: list[str]) -> np.ndarray:
        of, feature, value = self.vectors(texts)
        return np.stack([np.bincount(of, value * self.weights[feature, k], len(texts)) for k in range(len(self.languages))], 1)

    def probabilities(self, texts: list[str]) -> np.ndarray:
        return softmax(self.scores(texts) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], features: int, classes: int, seed: int = 1) -> np.ndarray:
    """Weights after ``EPOCHS`` passes over (features, values, class) rows in a fixed random order."""
    z, n = np.zeros((features, classes)), np.zeros((features, classes))
    order = np.random.default_rng(seed)

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            at, value, y = rows[i]
            za, na = z[at], n[at]
            w = weights(za, na)
            p = softmax(value @ w)
            p[y] -= 1
            g = value[:, None] * p
            square = g * g
            z[at] = za + g - (np.sqrt(na + square) - np.sqrt(na)) / ALPHA * w
            n[at] = na + square
    return weights(z, n)


def fit_temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, by golden section over its logarithm."""
    def loss(t: float) -> float:
        return -np.log(softmax(scores / np.exp(t))[np.arange(len(y)), y] + 1e-12).mean()

    a, b, ratio = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", bits: int = BITS, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> Model | None:
    """A model learned from documents with a language outside the held-out fold; None if there are
    none.  Frequencies are counted over all of these; weights and temperature are fitted on at most
    ``rows`` texts a language and ``most_bytes`` of text."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    counts, sample = labelled_sample(docs, known, lang_col, rows, most_bytes, id_col, text_col, id_col)
    sample = {k: own for k, texts in sample.items() if (own := [t for t in texts if has_letter(t)])}
    if not sample:
        return None
    df = document_frequencies(known, text_col, bits)
    idf = np.log((1 + sum(counts.values())) / (1 + df)) + 1
    languages = sorted(sample)
    model = Model(languages, idf, np.zeros((1 << bits, len(languages))), 1.0, bits)
    train, check = [], []
    for k, lang in enumerate(languages):
        texts = sample[lang]
        cut = len(texts) - len(texts) // 5
        check += [(t, k) for t in texts[cut:]]
        for a, b in _groups(texts[:cut], bits):
            of, feature, value = model.vectors(texts[:cut][a:b])
            ends = np.searchsorted(of, np.arange(b - a + 1))
            train += [(feature[i:j], value[i:j], k) for i, j in zip(ends[:-1], ends[1:], strict=True)]
    model.weights = fit_ftrl(train, 1 << bits, len(languages))
    if check and len(languages) > 1:
        scores = np.concatenate([model.scores([t for t, _ in check[a:b]]) for a, b in _groups([t for t, _ in check], bits)])
        model.temperature = fit_temperature(scores, np.array([k for _, k in check]))
    model.weights = model.weights.astype(np.float32)
    return model


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", whole_rows: bool = False) -> DataFrame:
    """For each document: the id column, lang_pred and score, the calibrated probability of that
    language; with ``whole_rows`` also ``row``, a struct of all its columns.

    A text that is null or has no letter is "und" with score 1.0, and so, with score 0.0, is every
    other text if nothing could be learned.  Only the text is read for a prediction.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    bounded_batches(docs.sparkSession)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in text_slices(batch, 0, fill=False):
                texts = part.column(0).to_pylist()
                lang, score = [UNKNOWN] * len(texts), [1.0] * len(texts)
                able = [i for i, t in enumerate(texts) if has_letter(t)]
                if model is None:
                    for i in able:
                        score[i] = 0.0
                else:
                    for a, b in _groups(able, model.bits):
                        p = model.probabilities([texts[i] for i in able[a:b]])
                        for i, k, s in zip(able[a:b], p.argmax(1).tolist(), p.max(1).tolist(), strict=True):
                            lang[i], score[i] = model.languages[k], min(1.0, s)
                columns = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), *([part.column(0)] if whole_rows else [])]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *columns], names=names)

    rows = docs.select(F.col(text_col).alias("_text"), F.col(id_col).alias("_id"), *([carried(docs, [c for c in docs.columns if c != text_col]).alias("_rest")] if whole_rows else []))
    kinds = dict(rows.dtypes)
    names = ["_id", *(["_rest"] if whole_rows else []), "lang_pred", "score", *(["_text"] if whole_rows else [])]
    out = rows.mapInArrow(label, ", ".join(f"{c} {kinds.get(c, 'string' if c == 'lang_pred' else 'double')}" for c in names))
    row = F.struct(*((F.col("_text") if c == text_col else F.col(f"_rest.`{c}`")).alias(c) for c in docs.columns)).alias("row")
    return out.select(F.col("_id").alias(id_col), "lang_pred", "score", *([row] if whole_rows else []))

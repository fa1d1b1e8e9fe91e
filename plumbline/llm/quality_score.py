"""Quality by compression: texts like the good ones compress better with a dictionary built from
good texts than with one built from bad ones.

Two zstandard dictionaries hold labelled texts.  A text's evidence is the difference of its two
compressed sizes divided by the square root of its own, as the spread of a sum of many small
differences grows.  That alone becomes a score: isotonic regression, fitted on labelled texts that
the dictionaries do not hold (``FOLDS`` parts take turns), tells how many texts of such a difference
are good, so a greater difference never has a lower score.  A dictionary is either made of the most
telling passages or of whole texts, whichever tells those texts apart better: few labelled texts ask
for the former, many for the latter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.sampling import held_out, labelled_sample
from plumbline.llm.shared import bounded_batches, text_slices

#: Sizes of dictionaries of chosen passages and of whole texts.
PASSAGE_BYTES, DICTIONARY_BYTES = 32 << 10, 1 << 20
LEVEL = 9
FOLDS = 5
SAMPLE_ROWS = 4000
SAMPLE_BYTES = 48 << 20
KEEP = 0.7


@dataclass
class Model:
    """Both dictionaries and the calibration: scores at some differences, straight lines between."""

    good: bytes
    bad: bytes
    trained: bool
    difference: np.ndarray
    value: np.ndarray

    def score(self, sizes: np.ndarray) -> np.ndarray:
        return np.interp(differences(sizes), self.difference, self.value)


def compressors(good: bytes, bad: bytes, trained: bool) -> list[zstandard.ZstdCompressor]:
    out = []
    for raw in (good, bad):
        held = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(dict_data=held, write_content_size=False, write_dict_id=False))
    return out


def sizes(texts: list[str], tools: list[zstandard.ZstdCompressor]) -> np.ndarray:
    """For each text: its size compressed with the good dictionary, with the bad one, and itself."""
    good, bad = tools
    raws = (t.encode() for t in texts)
    return np.array([(len(good.compress(r)), len(bad.compress(r)), len(r)) for r in raws], float).reshape(-1, 3)


def differences(sizes: np.ndarray) -> np.ndarray:
    good, bad, raw = sizes.T
    return (bad - good) / np.sqrt(raw + 1)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing function of x nearest to y: values at the centres of runs of like value,
    found by joining neighbours that are out of order."""
    x, at = np.unique(x, return_inverse=True)
    runs: list[list[float]] = []  # value, weight, weighted sum of x
    for centre, w, total in zip(x, np.bincount(at, weight), np.bincount(at, weight * y), strict=True):
        runs.append([total / w, w, centre * w])
        while len(runs) > 1 and runs[-2][0] >= runs[-1][0]:
            v, w, s = runs.pop()
            u = runs[-1]
            runs[-1] = [(u[0] * u[1] + v * w) / (u[1] + w), u[1] + w, u[2] + s]
    return np.array([s / w for _, w, s in runs]), np.array([v for v, _, _ in runs])


def _dictionary(texts: list[str], trained: bool) -> bytes:
    """Chosen passages of the texts, or the first of the texts up to a size, of which the last is cut.
    Raises ZstdError if there is too little text to choose from."""
    raw = [t.encode() for t in texts if t]
    if trained:
        return zstandard.train_dictionary(min(PASSAGE_BYTES, max(256, sum(map(len, raw)) // 8)), raw).as_bytes()
    return b"\n".join(reversed(raw))[-DICTIONARY_BYTES:].rjust(8, b"\n")


def _calibrated(sample: dict[int, list[str]], counts: dict[int, int], trained: bool) -> tuple[float, Model]:
    """A model with dictionaries of one kind, and its mean squared error on texts that they lack."""
    x, y = [], []
    for part in range(FOLDS):
        tools = compressors(*(_dictionary([t for i, t in enumerate(sample[k]) if i % FOLDS != part] or sample[k], trained) for k in (1, 0)), trained)
        for k in (0, 1):
            x.append(differences(sizes(sample[k][part::FOLDS], tools)))
            y.append(np.full(len(x[-1]), float(k)))
    x, y = np.concatenate(x), np.concatenate(y)
    weight = np.where(y == 1, counts[1] / (y == 1).sum(), counts[0] / (y == 0).sum())
    at, value = isotonic(x, y, weight)
    error = np.average((np.interp(x, at, value) - y) ** 2, weights=weight)
    return float(error), Model(*(_dictionary(sample[k], trained) for k in (1, 0)), trained, at, value)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> Model | None:
    """A model learned from labelled documents outside the held-out fold (1 is good, 0 is bad): at
    most ``rows`` whole texts a label and ``most_bytes`` in all.  The dictionaries hold as many of them
    as fit; the regression sees each text against dictionaries without its own part, weighted as the
    labels occur in the whole table.  None if a label is missing."""
    counts, sample = labelled_sample(docs, labels, label_col, rows, most_bytes, id_col, text_col)
    if not sample.get(0) or not sample.get(1):
        return None
    models = [_calibrated(sample, counts, False)]
    try:
        models.append(_calibrated(sample, counts, True))
    except zstandard.ZstdError:  # too little text for chosen passages
        pass
    return min(models, key=lambda m: m[0])[1]


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep_from: float = KEEP) -> DataFrame:
    """For each document: the id column, held_out, score and predicted (1 from ``keep_from`` on).

    A null text counts as empty, and that has a score like any other; without a model every score
    is 0.5.  Only the text is read for a score.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    bounded_batches(docs.sparkSession)

    def grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        tools = compressors(model.good, model.bad, model.trained) if model else None
        for batch in batches:
            for part in text_slices(batch, 0):
                score = model.score(sizes(part.column(0).to_pylist(), tools)) if model else np.full(part.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(score), pa.array((score >= keep_from).astype(np.int32))], names=[id_col, "held_out", "score", "predicted"])

    schema = f"`{id_col}` {kind}, held_out boolean, score double, predicted int"
    return docs.select(F.col(text_col).alias("_text"), id_col, held_out(id_col).alias("held_out")).mapInArrow(grade, schema)

"""Quality rules: statistics of whole documents, fixed limits on some, and gradient-boosted trees.

The trees are fitted here (second-order boosting over binned features) and flattened into numpy
node arrays, so scoring is a few array steps a tree.  Features for which more can only be worse
have a monotonic constraint: a split on them may never raise the score of the higher side, and the
bounds that this sets hold in the whole subtree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.sampling import labelled_sample
from plumbline.llm.shared import bounded_batches, text_slices
from plumbline.llm.textbuf import Hasher, U, buffers, byte_codes, grams, mix, owners, runs

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # percent of the words
KEEP = 0.5
TREES, DEPTH, RATE, BINS, LEAF = 60, 3, 0.2, 32, 5
SAMPLE_ROWS = 4000
SAMPLE_BYTES = 48 << 20

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features of the trees, and whether a score may only fall (-1) as they grow.
FEATURES = {
    "log_words": 0, "mean_word_chars": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_word_share": -1,
    "upper_share": -1, "digit_share": -1, "pipe_lines_share": -1, "exclamations_per_word": -1, "words_per_line": 0,
    "stops_per_word": 0, "same_neighbour_share": -1,
}

_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_SYMBOL = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])
_CODES = byte_codes()


def _per_text(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[off])


def _repeats(key: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    out = np.zeros(len(key), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def statistics(texts: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The contract's statistics of each text, and the trees' features (a row a text)."""
    data, off = buffers(texts)
    inside = ~_SPACE[data]
    start, end = runs(inside, off)
    word_off = np.searchsorted(start, off)
    n = np.diff(word_off)
    hasher = Hasher(data, _CODES)
    h = hasher.spans(start, end)
    of = owners(word_off)
    salt = mix(np.arange(len(texts), dtype=U) + U(1))

    g = grams(h, WINDOW)
    own = np.arange(len(g)) + WINDOW <= word_off[1:][of[: len(g)]]
    at = np.flatnonzero(own)
    at = at[_repeats(g[at] ^ salt[of[at]])]
    depth = np.zeros(len(h) + 1, np.int64)
    np.add.at(depth, at, 1)
    np.add.at(depth, at + WINDOW, -1)
    repeated = np.cumsum(depth)[:-1] > 0

    line, stop = runs(data != 10, off)
    has_word = np.concatenate([[0], np.cumsum(inside, dtype=np.int64)])
    full = has_word[stop] > has_word[line]
    line, stop = line[full], stop[full]
    line_of = np.searchsorted(off, line, "right") - 1
    key = hasher.spans(line, stop) ^ salt[line_of]
    order = np.argsort(key, kind="stable")
    again = order[1:][key[order][1:] == key[order][:-1]]
    n_lines = np.bincount(line_of, minlength=len(texts))

    stats = {
        "n_words": n,
        "word_chars": _per_text(inside & ((data & 0xC0) != 0x80), off),
        "n_symbols": _per_text(_SYMBOL[data], off),
        "n_dup_lines": np.bincount(line_of[again], minlength=len(texts)),
        "n_repeat_words": _per_text(repeated, word_off),
    }
    w, chars = np.maximum(n, 1), np.maximum(stats["word_chars"], 1)
    near = np.zeros(len(h), bool)
    near[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    columns = [
        np.log1p(n), stats["word_chars"] / w, stats["n_symbols"] / w, stats["n_dup_lines"] / np.maximum(n_lines, 1), stats["n_repeat_words"] / w,
        _per_text((data >= 65) & (data <= 90), off) / chars, _per_text((data >= 48) & (data <= 57), off) / chars,
        _per_text(data == 124, off) / np.maximum(n_lines, 1), _per_text(data == 33, off) / w, n / np.maximum(n_lines, 1),
        _per_text(data == 46, off) / w, _per_text(near, word_off) / w,
    ]
    return stats, np.stack(columns, 1)


def base_failed(stats: dict[str, np.ndarray]) -> np.ndarray:
    return (stats["n_words"] < LEAST_WORDS) | (100 * stats["n_repeat_words"] > MOST_REPEATED * stats["n_words"])


@dataclass
class Trees:
    """All trees' nodes end to end: a leaf points to itself."""

    root: np.ndarray
    feature: np.ndarray
    limit: np.ndarray
    low: np.ndarray
    high: np.ndarray
    value: np.ndarray
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.root:
            node = np.full(len(x), root)
            for _ in range(DEPTH):
                node = np.where(x[rows, self.feature[node]] <= self.limit[node], self.low[node], self.high[node])
            out += self.value[node]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, weight: np.ndarray, signs: list[int], trees: int = TREES, l2: float = 1.0) -> Trees:
    """Boosted trees for the log loss.  ``signs``: -1, 0 or 1 for each feature's constraint."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    share = float(np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3))
    bias = float(np.log(share / (1 - share)))
    margin = np.full(len(y), bias)
    nodes: list[list] = []  # feature, limit, low, high, value
    roots = []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, least: float, most: float, step: np.ndarray) -> int:
        """Adds the subtree over some rows, all of whose values lie between two bounds."""
        me = len(nodes)
        value = float(np.clip(-g[rows].sum() / (h[rows].sum() + l2), least, most))
        nodes.append([0, np.inf, me, me, RATE * value])
        best = (1e-6, 0, 0, 0.0, 0.0)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        if depth < DEPTH and len(rows) >= 2 * LEAF:
            for f, c in enumerate(cuts):
                b = bins[rows, f]
                n = np.bincount(b, minlength=len(c) + 1).cumsum()[:-1]
                lg, lh = (np.bincount(b, v[rows], len(c) + 1).cumsum()[:-1] for v in (g, h))
                lv, rv = (np.clip(-a / (d + l2), least, most) for a, d in ((lg, lh), (total_g - lg, total_h - lh)))
                gain = -(lg * lv + (lh + l2) / 2 * lv**2 + (total_g - lg) * rv + (total_h - lh + l2) / 2 * rv**2) + (total_g * value + (total_h + l2) / 2 * value**2)
                ok = (n >= LEAF) & (len(rows) - n >= LEAF) & (signs[f] * (rv - lv) >= 0)
                if ok.any() and (k := int(np.where(ok, gain, -np.inf).argmax())) >= 0 and gain[k] > best[0]:
                    best = (float(gain[k]), f, k, float(lv[k]), float(rv[k]))
        if best[0] <= 1e-6:
            step[rows] = RATE * value
            return me
        _, f, k, lv, rv = best
        left = bins[rows, f] <= k
        middle = (lv + rv) / 2
        bounds = {0: ((least, most), (least, most)), 1: ((least, middle), (middle, most)), -1: ((middle, most), (least, middle))}[signs[f]]
        nodes[me][:2] = [f, float(cuts[f][k])]
        nodes[me][2] = grow(rows[left], g, h, depth + 1, *bounds[0], step)
        nodes[me][3] = grow(rows[~left], g, h, depth + 1, *bounds[1], step)
        return me

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        step = np.zeros(len(y))
        roots.append(grow(np.arange(len(y)), weight * (p - y), weight * p * (1 - p), 0, -np.inf, np.inf, step))
        margin += step
    feature, limit, low, high, value = zip(*nodes, strict=True)
    return Trees(np.array(roots), np.array(feature), np.array(limit), np.array(low), np.array(high), np.array(value), bias)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> Trees | None:
    """Trees learned from labelled documents (1 is good, 0 is bad) outside the held-out fold: at
    most ``rows`` whole texts a label and ``most_bytes`` in all, weighted as the labels occur in the
    whole table.  None if a label is missing."""
    counts, sample = labelled_sample(docs, labels, label_col, rows, most_bytes, id_col, text_col)
    if not sample.get(0) or not sample.get(1):
        return None
    parts = [statistics(pa.array(sample[k][a : a + 200], pa.large_string()))[1] for k in (0, 1) for a in range(0, len(sample[k]), 200)]
    y = np.repeat([0.0, 1.0], [len(sample[0]), len(sample[1])])
    weight = np.where(y == 1, counts[1] / len(sample[1]), counts[0] / len(sample[0])) * len(y) / (counts[0] + counts[1])
    return fit_trees(np.concatenate(parts), y, weight, list(FEATURES.values()))


def judge(docs: DataFrame, trees: Trees | None, id_col: str = "doc_id", text_col: str = "text", keep_from: float = KEEP) -> DataFrame:
    """For each document: the id column, the statistics, base_failed, kept and score.

    A document is kept unless the fixed limits fail or the trees' score is under ``keep_from``;
    without trees the limits alone decide and every score is 0.5.  Null and empty texts have no
    words and fail; repeated rows have a row each.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    bounded_batches(docs.sparkSession)
    names = [id_col, *STATS, "base_failed", "kept", "score"]

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in batches:
            for part in text_slices(batch, 0):
                stats, x = statistics(part.column(0))
                failed = base_failed(stats)
                score = trees.score(x) if trees else np.full(len(x), 0.5)
                yield pa.RecordBatch.from_arrays([part.column(1), *(pa.array(stats[s].astype(np.int64)) for s in STATS), pa.array(failed), pa.array(~failed & (score >= keep_from)), pa.array(score)], names=names)

    schema = f"`{id_col}` {kind}, " + ", ".join(f"{s} bigint" for s in STATS) + ", base_failed boolean, kept boolean, score double"
    return docs.select(F.col(text_col).alias("_text"), id_col).mapInArrow(rate, schema)

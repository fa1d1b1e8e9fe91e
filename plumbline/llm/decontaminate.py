"""Benchmark decontamination by winnowing.

Both sides keep the least hash of ``GRAM`` consecutive words in each window of ``WINDOW`` words.
Two texts that share a window have the same least gram in it, so joining these fingerprints finds
every shared window; each hit is then extended to whole windows of words, which are compared in
full (by a 64-bit hash of the words).  Items too short for a window are looked up as they are.

The benchmark is the stated query set: its distinct items are taken in blocks of about
``BLOCK_BYTES`` of text, each broadcast once, so its size bounds neither memory nor the broadcast.
Each block is one scan of the documents; of all but the first only the hits are written, by the
digest of the text that they are in, and joined to the documents in the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import bounded_batches, carried, text_slices, written
from plumbline.llm.textbuf import Hasher, U, buffers, byte_codes, grams, mix, runs

WINDOW = 13
GRAM = 5
BLOCK_BYTES = 16 << 20
CELLS = 1 << 16
_WORD = np.isin(np.arange(256), [*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])
_CODES = byte_codes(lower=True)


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of the texts, and where each text's words begin."""
    data, off = buffers(texts)
    start, end = runs(_WORD[data], off)
    return Hasher(data, _CODES).spans(start, end), np.searchsorted(start, off)


def least_grams(h: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """The least gram of each window of words, those across texts included."""
    g, span = grams(h, gram), window - gram + 1
    if len(g) < span:
        return np.zeros(0, U)
    least, have = g, 1
    while 2 * have <= span:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < span:
        least = np.minimum(least[: len(g) - span + 1], least[span - have : span - have + len(g) - span + 1])
    return least


def _inside(n: int, off: np.ndarray, k: int) -> np.ndarray:
    """Which of n runs of k words, one from each word on, lie within one text."""
    where = np.arange(n)
    return where + k <= off[np.searchsorted(off, where, "right")]


def _at(h: np.ndarray, where: np.ndarray, k: int) -> np.ndarray:
    """grams(h, k) at some places only."""
    g = h[where].copy()
    for j in range(1, k):
        g *= U(0x9E3779B97F4A7C15)
        g += h[where + j]
    return mix(g + U(k))


class _Table:
    """A set of hashes, with a bit table before it, and the items of each."""

    def __init__(self, h: np.ndarray, item: np.ndarray):
        pairs = np.unique(np.rec.fromarrays([h, item], names="h,i"))
        self.keys, first = np.unique(pairs["h"], return_index=True)
        self.first, self.items = np.append(first, len(pairs)), pairs["i"].astype(np.int32)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.keys >> U(44)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in h that are in the set, and the key's number of each."""
        may = np.flatnonzero(self.seen[(h >> U(44)).astype(np.int64)])
        if not len(may) or not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, h[may]), len(self.keys) - 1)
        hit = self.keys[at] == h[may]
        return may[hit], at[hit]


class Index:
    """The windows of some benchmark items: their fingerprints and their full hashes."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int = WINDOW, gram: int = GRAM):
        self.ids, self.window, self.gram = ids, window, gram
        h, off = words(pa.array([t or "" for t in texts], pa.large_string()))
        n = np.diff(off)
        item = np.repeat(np.arange(len(ids)), n)
        full = grams(h, window)
        inside = _inside(len(full), off, window)
        where = np.flatnonzero(inside)
        self.full = _Table(full[where], item[where])
        self.prints = _Table(least_grams(h, window, gram)[where], np.zeros(len(where), np.int64))
        self.short: dict[int, _Table] = {}
        for k in sorted(set(n[(n > 0) & (n < window)].tolist())):
            own = np.flatnonzero(n == k)
            self.short[k] = _Table(_at(h, off[own], k), own)

    def hits(self, h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Which words lie inside an occurring window, and the pairs (text, item) that occur."""
        depth = np.zeros(len(h) + 1, np.int64)
        pairs: set[tuple[int, int]] = set()

        def note(where: np.ndarray, key: np.ndarray, table: _Table, k: int) -> None:
            np.add.at(depth, where, 1)
            np.add.at(depth, where + k, -1)
            text = np.searchsorted(off, where, "right") - 1
            for t, x in np.unique(np.stack([text, key]), axis=1).T.tolist():
                pairs.update((t, i) for i in table.items[table.first[x] : table.first[x + 1]].tolist())

        if len(self.full.keys):
            least = least_grams(h, self.window, self.gram)
            if len(least):
                new = np.flatnonzero(np.append(True, least[1:] != least[:-1]))  # neighbours mostly share it
                found, _ = self.prints.find(least[new])
                if len(found):
                    size = np.diff(np.append(new, len(least)))[found]
                    where = np.repeat(new[found], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                    where = where[where + self.window <= off[np.searchsorted(off, where, "right")]]
                    hit, key = self.full.find(_at(h, where, self.window))
                    note(where[hit], key, self.full, self.window)
        for k, table in self.short.items():
            g = grams(h, k)
            hit, key = table.find(g)
            ok = hit + k <= off[np.searchsorted(off, hit, "right")]
            note(hit[ok], key[ok], table, k)
        return np.cumsum(depth)[:-1] > 0, sorted(pairs)


def _blocks(items: DataFrame, item_col: str, text_col: str, most: int) -> Iterator[tuple[list[str], list[str | None]]]:
    """The distinct items in blocks of about ``most`` bytes of text; ids as strings, a null one as ''.
    Items are dealt to ``CELLS`` cells by hash, and a block is a run of cells that are not empty."""
    rows = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).distinct()
    cell = F.pmod(F.xxhash64("id", "text"), F.lit(CELLS)).alias("cell")
    sizes = {r["cell"]: r["n"] for r in rows.groupBy(cell).agg(F.sum(F.octet_length("text")).alias("n")).collect()}  # <= CELLS rows
    runs, size = [[0, 0]], 0
    for k in sorted(sizes):
        if size and size + sizes[k] > most:
            runs.append([k, k])
            size = 0
        size += sizes[k]
        runs[-1][1] = k
    if len(runs) > 1:
        rows = written(rows, "benchmark")
    for first, last in runs:
        got = (rows if len(runs) == 1 else rows.where(cell.between(first, last))).collect()  # about `most` bytes
        yield [r["id"] for r in got], [r["text"] for r in got]


def find_benchmark(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES, whole_rows: bool = False,
) -> DataFrame:
    """For each document: the id column, n_words, hits (array of [start, stop) word ranges inside
    occurring windows), items (sorted array of the ids, as strings, of items with such windows) and,
    with ``whole_rows``, row: a struct of all its columns.

    Null and empty texts have no words and no hits; so do all documents if there are no items.
    Repeated documents have a row each; an item id that repeats counts once.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rest = carried(docs, [c for c in docs.columns if c != text_col] if whole_rows else [id_col]).alias("rest")
    whole = docs.select(F.col(text_col).alias("text"), rest)
    found, more = None, []
    for ids, texts in _blocks(items, item_col, item_text_col, block_bytes):
        shared = spark.sparkContext.broadcast(Index(ids, texts, window, gram))
        if found is None:
            found = whole.mapInArrow(_scan(shared), f"text string, rest {dict(whole.dtypes)['rest']}, n_words bigint, {HITS}")
        else:
            only = docs.select(F.col(text_col).alias("text"), F.struct(_mark(text_col).alias("mark")).alias("rest"))
            hit = only.mapInArrow(_scan(shared, hits_only=True), f"rest struct<mark:binary>, {HITS}")
            more.append(written(hit.select("rest.mark", "hits", "items").groupBy("mark").agg(F.first("hits").alias("hits"), F.first("items").alias("items")), "hits"))
    if more:
        found = _merged(found, reduce(DataFrame.unionByName, more))
    row = F.struct(*((F.col("text") if c == text_col else F.col(f"rest.`{c}`")).alias(c) for c in docs.columns)).alias("row") if whole_rows else None
    return found.select(F.col(f"rest.`{id_col}`").alias(id_col), "n_words", "hits", "items", *([row] if whole_rows else []))


HITS = "hits array<struct<start:bigint,stop:bigint>>, items array<string>"


def _mark(text: str) -> Column:
    return F.unhex(F.sha2(text, 256))


def _merged(found: DataFrame, more: DataFrame) -> DataFrame:
    """The first block's rows with the hits of the others, which are by text."""
    of_text = more.groupBy("mark").agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("more_hits"), F.flatten(F.collect_list("items")).alias("more_items"))  # a row a block
    of_text = written(of_text, "hits")
    both = found.withColumn("mark", _mark("text")).join(of_text, "mark", "left")

    def add(runs: Column, s: Column) -> Column:
        last = F.try_element_at(runs, F.lit(-1))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["stop"], s["stop"]).alias("stop"))
        touching = (F.size(runs) > 0) & (s["start"] <= last["stop"])
        return F.when(touching, F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(joined))).otherwise(F.concat(runs, F.array(s)))

    kind = dict(found.dtypes)["hits"]
    spans = F.array_sort(F.concat("hits", F.coalesce("more_hits", F.array().cast(kind))))
    items = F.array_sort(F.array_distinct(F.concat("items", F.coalesce("more_items", F.array().cast("array<string>")))))
    return both.withColumns({"hits": F.aggregate(spans, F.array().cast(kind), add), "items": items}).drop("mark", "more_hits", "more_items")


def _scan(shared, hits_only: bool = False):
    """The hits of each row's text with the rest of the row; with ``hits_only``, of rows that have
    any and without the text."""
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for part in text_slices(batch, 0, fill=False):
                h, off = words(pc.fill_null(part.column(0), ""))
                hit, pairs = index.hits(h, off)
                spans: list[list[dict]] = [[] for _ in range(part.num_rows)]
                for a, b in zip(*runs(hit, off), strict=True):
                    t = int(np.searchsorted(off, a, "right") - 1)
                    spans[t].append({"start": int(a - off[t]), "stop": int(b - off[t])})
                found: list[list[str]] = [[] for _ in range(part.num_rows)]
                for t, i in pairs:
                    found[t].append(index.ids[i])
                columns = [pa.array(spans, pa.list_(span)), pa.array([sorted({*x}) for x in found], pa.list_(pa.string()))]
                if hits_only:
                    some = pa.array([t for t, x in enumerate(found) if x], pa.int64())
                    yield pa.RecordBatch.from_arrays([x.take(some) for x in (part.column(1), *columns)], names=["rest", "hits", "items"])
                else:
                    yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(np.diff(off), pa.int64()), *columns], names=["text", "rest", "n_words", "hits", "items"])

    return scan


def contamination(found: DataFrame, share: int = 20) -> DataFrame:
    """:func:`find_benchmark`'s rows with n_hit, n_items, items_sha256 and contaminated: words are
    hit, and they are at least one in ``share`` of the document's."""
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda a, s: a + s["stop"] - s["start"])
    return found.withColumn("n_hit", n_hit).withColumns({
        "n_items": F.size("items").cast("bigint"),
        "items_sha256": F.sha2(F.array_join("items", ","), 256),
        "contaminated": (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")),
    })


def oracle_sql(window: int = WINDOW) -> str:
    """What :func:`contamination` gives for ``documents`` and ``benchmark``, in DuckDB's SQL."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH item AS (SELECT coalesce(item_id::VARCHAR, '') AS id, {words} AS w FROM benchmark),
sized AS (SELECT id, w, least({window}, len(w)) AS m FROM item WHERE len(w) > 0),
wanted AS (SELECT DISTINCT id, m, array_to_string(w[i : i + m - 1], ' ') AS form FROM (SELECT id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM sized)),
doc AS (SELECT row_number() OVER () AS k, doc_id, {words} AS w FROM documents),
run AS (SELECT k, m, i, array_to_string(w[i : i + m - 1], ' ') AS form
  FROM (SELECT k, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM doc, (SELECT DISTINCT m FROM sized) WHERE len(w) >= m)),
hit AS (SELECT k, i, m, id FROM run JOIN wanted USING (m, form)),
place AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT k, unnest(range(i, i + m)) AS p FROM hit) GROUP BY k),
found AS (SELECT k, count(DISTINCT id) AS n_items, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM hit GROUP BY k)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN place USING (k) LEFT JOIN found USING (k)
"""

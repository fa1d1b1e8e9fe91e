"""Exact nearest neighbours by inner product.

Few queries are broadcast, and every task keeps the best of its own rows for each of them.  More are
dealt into blocks, and so is the base: a block of one meets a block of the other through the
shuffle, as one matrix product, and only its best rows go on.  Either way it is one plan, and what a
task holds does not grow with the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries up to which they are broadcast: with 384 numbers each, 12 MB.
BLOCK_ROWS = 4096
#: A shuffled block of queries has so many times more on average.
LARGER = 4
#: Rows of the base, and queries, that are multiplied at once.
STEP_ROWS, STEP_QUERIES = 1024, 2048
#: Digits of a score that count; what sums of another order differ by does not part equal vectors.
DIGITS = 12
FOUND = "query_id bigint, base_id bigint, score double"


def _rows(ids: pa.Array, vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors as a matrix, without vectors that have a null or no finite element."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    widths = np.diff(vectors.offsets.to_numpy())
    if len(widths) and (widths != widths[0]).any():
        raise ValueError(f"vectors of unlike length: {widths.min()} and {widths.max()}")
    x = flat.reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 0))
    able = np.isfinite(x).all(1)
    return ids.to_numpy()[able], x[able]


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of scores the k highest, equal ones by the lower id."""
    n, columns = score.shape
    k, ids = min(k, columns), np.broadcast_to(ids, score.shape)
    if not k or not n:
        return score[:, :0], ids[:, :0]
    least = np.partition(score, columns - k, axis=1)[:, columns - k]
    row, column = np.nonzero(score >= least[:, None])  # k a row, more if the last are equal
    s, i = score[row, column], ids[row, column]
    order = np.lexsort((i, -s, row))
    at = order[np.searchsorted(row, np.arange(n))[:, None] + np.arange(k)]
    return s[at], i[at]


class _Search:
    """The best rows so far for some queries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.score, self.found = np.zeros((len(ids), 0)), np.zeros((len(ids), 0), np.int64)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        if not len(ids) or not len(self.ids):
            return
        if vectors.shape[1] != self.vectors.shape[1]:
            raise ValueError(f"vectors of unlike length: {self.vectors.shape[1]} and {vectors.shape[1]}")
        parts = []
        for a in range(0, len(self.ids), STEP_QUERIES):
            own = slice(a, a + STEP_QUERIES)
            score, found = _best(np.round(self.vectors[own] @ vectors.T, DIGITS), ids, self.k)
            parts.append(_best(np.concatenate([self.score[own], score], 1), np.concatenate([self.found[own], found], 1), self.k))
        self.score, self.found = (np.concatenate(x) for x in zip(*parts, strict=True))

    def result(self) -> Iterator[pa.RecordBatch]:
        n = self.score.shape[1]
        for a in range(0, len(self.ids) if n else 0, STEP_QUERIES):
            own = slice(a, a + STEP_QUERIES)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids[own], n)), pa.array(self.found[own].ravel()), pa.array(self.score[own].ravel())], names=["query_id", "base_id", "score"])


def top_k(queries: DataFrame, base: DataFrame, k: int, query_id: str = "id", base_id: str = "id", vector: str = "embedding") -> DataFrame:
    """(query_id, base_id, score, rank): the k rows of ``base`` with the highest inner product for
    each query, ranked from 1; equal scores by the lower id.

    Rows whose id or vector is null, or whose vector has a null or no finite element, take no part.
    Vectors of unlike length end the query with a ValueError.  A query that is a row of ``base``
    finds itself.
    """
    def plain(df: DataFrame, name: str) -> DataFrame:
        v = F.col(vector) if df.schema[vector].dataType.simpleString() == "array<float>" else F.col(vector).cast("array<double>")  # floats are widened by tasks
        return df.where(F.col(name).isNotNull() & F.col(vector).isNotNull()).select(F.col(name).cast("bigint").alias("id"), v.alias("v"))

    asked, rows = plain(queries, query_id), plain(base, base_id)
    n = asked.count()
    found = rows.mapInArrow(_against(asked, k), FOUND) if n <= BLOCK_ROWS else _by_blocks(asked, rows, k, n)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "base_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _against(asked: DataFrame, k: int):
    table = asked.toArrow().combine_chunks()  # BLOCK_ROWS at most
    held = (np.zeros(0, np.int64), np.zeros((0, 0))) if not table.num_rows else _rows(table["id"].combine_chunks(), table["v"].combine_chunks())
    shared = asked.sparkSession.sparkContext.broadcast(held)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _Search(*shared.value, k)
        for batch in batches:
            for a in range(0, batch.num_rows, STEP_ROWS):
                search.add(*_rows(*batch.slice(a, STEP_ROWS).columns))
        yield from search.result()

    return scan


def _by_blocks(asked: DataFrame, rows: DataFrame, k: int, n: int) -> DataFrame:
    """Each block of queries with each block of the base; the base is cut only as far as tasks need
    work, since each of its blocks costs a copy of the queries."""
    own = -(-n // (LARGER * BLOCK_ROWS))
    other = max(1, -(-int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")) // own))
    cell = lambda m: F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = asked.select(cell(own).alias("q"), every(other).alias("b"), F.lit(0).alias("side"), "id", "v")
    right = rows.select(every(own).alias("q"), cell(other).alias("b"), F.lit(1).alias("side"), "id", "v")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, search = None, [], None

        def done() -> Iterator[pa.RecordBatch]:
            if search is not None:
                yield from search.result()

        for batch in batches:
            q, b, side = (batch.column(c).to_numpy() for c in range(3))
            edges = np.flatnonzero(np.diff(q) | np.diff(b) | np.diff(side)) + 1
            for start, stop in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                if start == stop:
                    continue
                if (q[start], b[start]) != at:
                    yield from done()
                    at, parts, search = (q[start], b[start]), [], None
                if side[start] == 0:
                    parts.append(_rows(*batch.slice(start, stop - start).columns[3:]))
                    continue
                if search is None:
                    if len({x.shape[1] for _, x in parts if len(x)}) > 1:
                        raise ValueError("vectors of unlike length")
                    parts = [p for p in parts if len(p[0])]
                    search = _Search(*(np.concatenate(x) for x in zip(*parts, strict=True)), k) if parts else _Search(np.zeros(0, np.int64), np.zeros((0, 0)), k)
                for a in range(start, stop, STEP_ROWS):
                    search.add(*_rows(*batch.slice(a, min(STEP_ROWS, stop - a)).columns[3:]))
        yield from done()

    met = left.unionByName(right).repartition(own * other, "q", "b").sortWithinPartitions("q", "b", "side")
    return met.select("q", "b", "side", "id", "v").mapInArrow(scan, FOUND)


def within_reach(base: DataFrame, k: int, base_id: str = "id", vector: str = "embedding") -> DataFrame:
    """The rows of ``base`` that a search for k can find: of equal vectors those with the k lowest
    ids.  Each task drops the others before the shuffle, so copies cost no product."""
    same = F.sha2(F.to_json(F.struct(vector)), 256)
    nth = F.row_number().over(Window.partitionBy("_same").orderBy(base_id))
    able = base.where(F.col(base_id).isNotNull() & F.col(vector).isNotNull()).select(base_id, vector)
    return able.withColumn("_same", same).withColumn("_nth", nth).where(F.col("_nth") <= k).select(base_id, vector)


def post_filter(found: DataFrame, allowed: DataFrame, allowed_id: str = "id") -> DataFrame:
    """Ranked first, filtered after: rows that are not allowed have taken their places, so there may
    be fewer than k.  This is how the index search treats allowed and deleted rows."""
    return found.join(allowed.select(F.col(allowed_id).alias("base_id")).distinct(), "base_id", "left_semi")


def pre_filter(queries: DataFrame, base: DataFrame, allowed: DataFrame, k: int, allowed_id: str = "id", base_id: str = "id", **options) -> DataFrame:
    """Filtered first: the k best among allowed rows."""
    return top_k(queries, base.join(allowed.select(F.col(allowed_id).alias(base_id)).distinct(), base_id, "left_semi"), k, base_id=base_id, **options)

"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Large-item matching: pieces above a third of the capacity pair at most twice per sequence, each
with the largest partner that fits; smaller pieces then best-fit the gaps, largest first.  Both
steps depend on nothing but how many pieces there are of each length.  So the plan is made from
that histogram (at most ``capacity`` numbers, whatever the input), and places are then dealt out to
pieces by their rank among those of their length, each task by itself: no piece is moved.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.shared import bounded_batches, text_slices, written
from plumbline.llm.tokens import encoder

CAPACITY = 1024
#: Rows of (task, length, first rank) up to which they are broadcast.
MOST_BROADCAST = 1 << 20


def plan_places(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int]], int]:
    """Places for ``counts[length]`` pieces of each length.

    Returns (length, first sequence, sequences, offset) for each run of like sequences, and how
    many sequences there are.  A run's places go to the next pieces of that length.
    """
    counts = {n: c for n, c in counts.items() if c > 0}
    if any(not 1 <= n <= capacity for n in counts):
        raise ValueError("a piece's length must lie between 1 and the capacity")
    places: list[tuple[int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> (first sequence, sequences)
    made = 0

    large = {n: c for n, c in counts.items() if 3 * n > capacity}
    order = sorted(large, reverse=True)
    for a in order:
        while large[a]:
            b = next((b for b in order if b <= min(a, capacity - a) and large[b] - (a == b) > 0), None)
            n = large[a] if b is None else large[a] // 2 if a == b else min(large[a], large[b])
            places.append((a, made, n, 0))
            large[a] -= n
            if b is not None:
                places.append((b, made, n, a))
                large[b] -= n
            gaps[capacity - a - (b or 0)].append((made, n))
            made += n

    rooms = [r for r in gaps if r]
    heapq.heapify(rooms)

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if not gaps[room] and room not in rooms:
                heapq.heappush(rooms, room)
            gaps[room].append((first, n))

    for small in sorted((n for n in counts if 3 * n <= capacity), reverse=True):
        left = counts[small]
        while left:
            room = min((r for r in rooms if r >= small and gaps[r]), default=capacity)
            each = room // small  # a sequence stays the best fit until the next does not fit it
            if room < capacity or gaps[capacity]:
                first, n = gaps[room].pop()
            else:
                first, n = made, -(-left // each)
                made += n
            full = min(n, left // each)
            for k in range(each):
                if full:
                    places.append((small, first, full, capacity - room + k * small))
            put(room - each * small, first, full)
            left -= full * each
            if full < n:
                for k in range(left):
                    places.append((small, first + full, 1, capacity - room + k * small))
                put(room - left * small, first + full, 1) if left else None
                put(room, first + full + (left > 0), n - full - (left > 0))
                left = 0
    return places, made


def tokenised_pieces(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
    capacity: int = CAPACITY, end_id: int = 2, with_ids: bool = False,
) -> DataFrame:
    """Each document's ids and ``end_id``, cut into pieces only if they are more than ``capacity``.

    Columns: the id column, piece (from 0), start (the document's ids before the piece), length,
    ids_crc32 and, with ``with_ids``, ids (little-endian unsigned 32-bit); and _task and _rank, which
    number the pieces of each length within each task.  The first piece of a cut document holds the
    remainder, all others are full.  A null or empty text has the end id alone; a null document id
    stays null; repeated rows are packed each.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen, enc = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), encoder(vocabulary)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            for part in text_slices(batch, 1, keep=vocabulary):
                ids, where = enc.encode(part.column(1))
                row, piece, start, length, crc, rank, held = [], [], [], [], [], [], []
                for i, (a, b) in enumerate(zip(where[:-1].tolist(), where[1:].tolist(), strict=True)):
                    own = np.concatenate([ids[a:b], end])
                    begin, stop = 0, (len(own) - 1) % capacity + 1
                    for k in range(-(-len(own) // capacity)):
                        raw = own[begin:stop].tobytes()
                        row.append(i), piece.append(k), start.append(begin), length.append(stop - begin)
                        crc.append(zlib.crc32(raw)), rank.append(seen[stop - begin])
                        if with_ids:
                            held.append(raw)
                        seen[stop - begin] += 1
                        begin, stop = stop, stop + capacity
                columns = [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(held, pa.binary())] if with_ids else []), pa.array([task] * len(row), pa.int32()), pa.array(rank, pa.int64())], names=names)

    fields = [(id_col, kind), ("piece", "int"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"), *([("ids", "binary")] if with_ids else []), ("_task", "int"), ("_rank", "bigint")]
    names = [x[0] for x in fields]
    return docs.select(id_col, text_col).mapInArrow(cut, ", ".join(f"`{n}` {t}" for n, t in fields))


def pack(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
    capacity: int = CAPACITY, end_id: int = 2, with_ids: bool = False,
) -> DataFrame:
    """Packs whole documents into as few sequences of at most ``capacity`` ids as best fit finds.

    Returns :func:`tokenised_pieces`' rows (without _task and _rank) with sequence_id and offset, the
    piece's place in its sequence; the pieces of a sequence follow each other without gaps from 0.
    An empty table gives no rows.  Which of several pieces of one length gets which place depends
    on the order of the input's files.  The id column may have any name but those of the others.
    """
    if id_col in ("piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"):
        raise ValueError(f"an id column called {id_col} would hide a column of the result")
    pieces = written(tokenised_pieces(docs, vocabulary, id_col, text_col, capacity, end_id, with_ids), "pieces")
    by_task = written(pieces.groupBy("_task", "length").agg(F.count("*").alias("n")), "lengths")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    first = by_task.select("_task", "length", F.coalesce(before, F.lit(0)).alias("_first"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    places, _ = plan_places(counts, capacity)
    if by_task.count() <= MOST_BROADCAST:  # else the pieces are moved to them
        first = F.broadcast(first)

    runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    of = defaultdict(list)
    for length, at, n, offset in places:
        of[length].append((at, n, offset))
    for length, own in of.items():
        at, n, offset = (np.array(x, np.int64) for x in zip(*own, strict=True))
        runs[length] = (np.cumsum(n) - n, at, offset)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_nth"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                rows = np.flatnonzero(length == n)
                starts, at, off = runs[int(n)]
                run = np.searchsorted(starts, rank[rows], "right") - 1
                sequence[rows], offset[rows] = at[run] + rank[rows] - starts[run], off[run]
            keep = [batch.column(c) for c in names[:-2]]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)], names=names)

    out = pieces.join(first, ["_task", "length"]).withColumn("_nth", F.col("_first") + F.col("_rank"))
    kept = [c for c in pieces.columns if c not in ("_task", "_rank")]
    names = [*kept, "sequence_id", "offset"]
    kinds = dict(pieces.dtypes) | {"sequence_id": "bigint", "offset": "bigint"}
    return out.select(*kept, "_nth").mapInArrow(place, ", ".join(f"`{c}` {kinds[c]}" for c in names))


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (binary) and their number, from
    :func:`pack`'s rows made with ``with_ids``.  A group has at most ``capacity`` ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "length")))
    joined = F.aggregate(F.col("parts"), F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return packed.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").alias("n_ids")).select("sequence_id", joined.alias("ids"), "n_ids")

"""Token ids in binary files: blocks of ids as bit or byte planes, compressed plane by plane.

A file holds the ids of some documents, end to end, in blocks of ``BLOCK`` ids (the last may be
shorter).  A block's ids are transposed: plane k has bit k (or byte k) of each id, one after the
other, and is compressed with zstandard by itself, so the planes of the high bits almost vanish.
Layout, all numbers little-endian:

    magic | planes of block 0 | planes of block 1 | ... | footer | footer's length u64 | magic

The footer (a zstandard frame) has: kind of planes u8, planes per block u8, then u64 counts of
blocks, ids and documents; for each block its place u64, its ids u32 and each plane's length u32;
for each document its id i64, a byte that is 1 if that id is null, and its number of ids u64.
One block, or one document, can thus be read without the others.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from plumbline.llm.shared import bounded_batches, fresh_path, partitions_for, text_slices, written
from plumbline.llm.tokens import encoder

MAGIC = b"PLBIDS01"
BLOCK = 1 << 16
LEVEL = 1


def store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a URI or path, and the path there."""
    if uri.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return pyarrow.fs.LocalFileSystem(), uri
    return pyarrow.fs.FileSystem.from_uri(uri)


def to_planes(ids: np.ndarray, kind: str, planes: int) -> list[bytes]:
    """A block's planes; bit planes are padded with zero bits to whole bytes."""
    if kind == "byte":
        columns = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
        return [columns[:, k].tobytes() for k in range(planes)]
    return [np.packbits(((ids >> np.uint32(k)) & np.uint32(1)).astype(np.uint8), bitorder="little").tobytes() for k in range(planes)]


def from_planes(planes: list[bytes], kind: str, n: int) -> np.ndarray:
    ids = np.zeros(n, np.uint32)
    for k, raw in enumerate(planes):
        part = np.frombuffer(raw, np.uint8)
        part = part if kind == "byte" else np.unpackbits(part, count=n, bitorder="little")
        ids |= part.astype(np.uint32) << np.uint32(k * (8 if kind == "byte" else 1))
    return ids


class Writer:
    """Writes one file; it appears under its name only when it is complete."""

    def __init__(self, uri: str, kind: str = "byte", block: int = BLOCK, level: int = LEVEL):
        self.fs, self.path = store(uri)
        self.draft = f"{self.path}.{uuid.uuid4().hex}.draft"
        self.out = self.fs.open_output_stream(self.draft)
        self.out.write(MAGIC)
        self.kind, self.block, self.packer = kind, block, zstandard.ZstdCompressor(level=level)
        self.planes = 4 if kind == "byte" else 32
        self.at, self.held, self.waiting, self.ids = len(MAGIC), [], 0, 0
        self.where: list[int] = []
        self.sizes: list[int] = []
        self.lengths: list[list[int]] = []
        self.docs: list[int | None] = []
        self.counts: list[int] = []

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc)
        self.counts.append(len(ids))
        self.held.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block:
            self._flush(whole=False)

    def _flush(self, whole: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        most = len(ids) if whole else len(ids) - len(ids) % self.block
        for a in range(0, most, self.block):
            part = ids[a : min(a + self.block, most)]
            packed = [self.packer.compress(p) for p in to_planes(part, self.kind, self.planes)]
            self.where.append(self.at)
            self.sizes.append(len(part))
            self.lengths.append([len(p) for p in packed])
            self.at += self.out.write(b"".join(packed))
        self.ids += most
        self.held, self.waiting = [ids[most:]], len(ids) - most

    def close(self) -> int:
        """Ends the file; returns its size in bytes."""
        self._flush(whole=True)
        head = np.array([self.kind == "byte", self.planes], np.uint8).tobytes() + np.array([len(self.where), self.ids, len(self.docs)], "<u8").tobytes()
        tables = [np.array(self.where, "<u8"), np.array(self.sizes, "<u4"), np.array(self.lengths, "<u4"), np.array([d or 0 for d in self.docs], "<i8"), np.array([d is None for d in self.docs], np.uint8), np.array(self.counts, "<u8")]
        footer = self.packer.compress(head + b"".join(x.tobytes() for x in tables))
        self.at += self.out.write(footer + np.array([len(footer)], "<u8").tobytes() + MAGIC)
        self.out.close()
        self.fs.move(self.draft, self.path)
        return self.at

    def abandon(self) -> None:
        self.out.close()
        self.fs.delete_file(self.draft)


class Reader:
    """Random access to one file."""

    def __init__(self, uri: str):
        fs, path = store(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(8 + len(MAGIC), size - 8 - len(MAGIC))
        if tail[8:] != MAGIC:
            raise ValueError(f"{uri} is not a complete id file")
        n = int(np.frombuffer(tail[:8], "<u8")[0])
        raw = zstandard.ZstdDecompressor().decompress(self.file.read_at(n, size - 8 - len(MAGIC) - n))
        self.kind, planes = ("byte" if raw[0] else "bit"), raw[1]
        blocks, self.n_ids, docs = (int(x) for x in np.frombuffer(raw, "<u8", 3, 2))
        at = 26

        def table(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, count, at)
            at += out.nbytes
            return out

        self.where, self.sizes = table("<u8", blocks), table("<u4", blocks)
        self.lengths = table("<u4", blocks * planes).reshape(blocks, planes)
        docs_id, null = table("<i8", docs), table("u1", docs)
        self.docs = [None if x else int(d) for d, x in zip(docs_id, null, strict=True)]
        self.counts = table("<u8", docs).astype(np.int64)
        self.unpacker = zstandard.ZstdDecompressor()

    def block(self, k: int) -> np.ndarray:
        raw = self.file.read_at(int(self.lengths[k].sum()), int(self.where[k]))
        cut = np.cumsum(self.lengths[k])
        planes = [self.unpacker.decompress(raw[b - n : b]) for b, n in zip(cut.tolist(), self.lengths[k].tolist(), strict=True)]
        return from_planes(planes, self.kind, int(self.sizes[k]))

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """Each document and its ids, in the file's order, with about a block in memory."""
        held, k = np.zeros(0, np.uint32), 0
        for doc, n in zip(self.docs, self.counts.tolist(), strict=True):
            parts, have = [held], len(held)
            while have < n:
                parts.append(self.block(k))
                have, k = have + len(parts[-1]), k + 1
            ids = np.concatenate(parts) if len(parts) > 1 else held
            yield doc, ids[:n]
            held = ids[n:]


def write_ids(
    docs: DataFrame, folder: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
    end_id: int = 2, kind: str = "byte", files: int | None = None,
) -> DataFrame:
    """Writes every document's ids and ``end_id`` to ``files`` files in ascending order of id; without
    a number, to as many as the session has shuffle partitions, or more, of 128 MB of text each.  Ids
    are integers; another type is refused.

    Returns the files' table: file, first_id, first_tie, n_docs, n_ids, n_bytes.  Documents are
    range-partitioned by id, for equal ids by the text's hash, and equal rows by their place in the
    input, so one id or one row that is a third of all is dealt over many files too.  Null ids come first; null texts are empty; a task that
    runs again writes the same file again.  An empty table gives no files.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise ValueError(f"{id_col} must be an integer column: the files hold 64-bit ids")
    if not files:
        files = partitions_for(spark, docs.agg(F.sum(F.octet_length(text_col))).head()[0] or 0)
    where, path = store(folder)
    where.create_dir(path, recursive=True)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumns({"tie": F.xxhash64("text"), "nth": F.monotonically_increasing_id()})
    order = ["id", "tie", "text", "nth"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, out, first = encoder(vocabulary), np.array([end_id], np.uint32), None, None
        name = f"{folder}/ids-{TaskContext.get().partitionId():06d}.plb"
        try:
            for batch in batches:
                for part in text_slices(batch, 1, keep=vocabulary):
                    if out is None:
                        out, first = Writer(name, kind), (part.column(0)[0].as_py(), part.column(2)[0].as_py())
                    ids, at = enc.encode(part.column(1))
                    for i, doc in enumerate(part.column(0).to_pylist()):
                        out.add(doc, np.concatenate([ids[at[i] : at[i + 1]], end]))
        except BaseException:
            if out is not None:
                out.abandon()
            raise
        if out is not None:
            size = out.close()
            yield pa.RecordBatch.from_pylist([{"file": name, "first_id": first[0], "first_tie": first[1], "n_docs": len(out.docs), "n_ids": out.ids, "n_bytes": size}], schema=MANIFEST)

    dealt = rows.repartitionByRange(files, "id", "tie", "nth").sortWithinPartitions(*order)
    return written(dealt.mapInArrow(write, "file string, first_id bigint, first_tie bigint, n_docs bigint, n_ids bigint, n_bytes bigint"), "id-files")


MANIFEST = pa.schema([("file", pa.string()), ("first_id", pa.int64()), ("first_tie", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())])


def read_ids(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """Reads :func:`write_ids`' files back: doc_id, start (ids of all documents before it),
    n_tokens, ids_crc32 and, with ``with_ids``, ids as little-endian unsigned 32-bit integers.
    ``files`` has a row for each file; the running sum over it is the only thing in one task."""
    before = F.sum("n_ids").over(Window.orderBy(F.asc_nulls_first("first_id"), "first_tie", "file").rowsBetween(Window.unboundedPreceding, -1))
    todo = files.select("file", F.coalesce(before, F.lit(0)).alias("start"))
    n = max(1, files.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[list] = [[], [], [], [], []]
                size = 0
                for doc, ids in Reader(name).documents():
                    raw = ids.astype("<u4").tobytes()
                    for to, x in zip(rows, (doc, start, len(ids), zlib.crc32(raw), raw), strict=True):
                        to.append(x)
                    start += len(ids)
                    size += len(raw) if with_ids else 32
                    if size > 1 << 22:
                        yield table(rows)
                        rows, size = [[], [], [], [], []], 0
                if rows[0]:
                    yield table(rows)

    def table(rows: list[list]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 4 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)][: len(names)], names=names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    return todo.repartition(n).mapInArrow(read, schema)


def round_trip(docs: DataFrame, vocabulary: str, with_ids: bool = False, **options) -> DataFrame:
    """Writes the ids to a fresh folder in the shared place and reads the files back."""
    return read_ids(write_ids(docs, fresh_path(docs.sparkSession, "token-ids"), vocabulary, **options), with_ids)

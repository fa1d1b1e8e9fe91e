"""Where intermediate tables go, and how text batches are cut."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the numpy kernels take at once; it bounds a worker's memory.
SLICE_BYTES = 1 << 20
#: Bytes of an Arrow batch that a worker gets; one longer row may be more.
BATCH_BYTES = 4 << 20
_own_folder: str | None = None
try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:  # another C library
    _libc = None


def bounded_batches(spark: SparkSession) -> None:
    """Lets Spark send Python workers a few megabytes of rows at a time, however long texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or, where that is
    unset (one machine, as in tests), a temporary folder of this process."""
    global _own_folder
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _own_folder is None:
        _own_folder = "file://" + tempfile.mkdtemp(prefix="plumbline-")
    return _own_folder


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


_scratch: ContextVar[tuple[str, ...]] = ContextVar("scratch", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that :func:`written` makes inside go when it ends, but for those to keep, which belong to
    the scratch around it or, if there is none, stay."""
    folder = fresh_path(spark, "scratch")
    token = _scratch.set((*_scratch.get(), folder))
    try:
        yield
    finally:
        _scratch.reset(token)
        _delete(spark, folder)


def written(df: DataFrame, what: str, keep: bool = False) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: its lineage ends there, so a
    lost executor costs only the tasks that it ran.  ``keep``: a returned plan reads it."""
    spark, open_ = df.sparkSession, _scratch.get()[: -1 if keep else None]
    path = f"{open_[-1]}/{what}-{uuid.uuid4().hex}" if open_ else fresh_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that :func:`written` made and that no plan reads any more, in whichever store
    they lie.  What a returned plan still reads stays in the shared folder."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _delete(df.sparkSession, folder)


def partitions_for(spark: SparkSession, size: int, each: int = 128 << 20) -> int:
    """Partitions for so many bytes: no fewer than the session's, none of much more than ``each``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


def _give_back() -> None:
    """Returns what Arrow's pool and the C library hold unused to the system, or workers keep their
    largest batch's memory for as long as they live."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


_kept: dict[str, object] = {}


def kept[T](name: str, make: Callable[[], T]) -> T:
    """What ``make`` gives, and again for later tasks of this worker that ask for the same name, until
    a task asks for another or slices texts without naming it: a worker that goes on to another
    operator holds nothing for the last."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


def carried(docs: DataFrame, columns: list[str]) -> Column:
    """Those columns as one struct, which an operator hands through as it is, whatever their names."""
    return F.struct(*(F.col(f"`{c}`") for c in columns)) if columns else F.struct(F.lit(0).alias("_"))


def text_slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES, fill: bool = True, keep: str | None = None) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows with about ``most`` bytes of text each; one long text may be more.
    With ``fill``, nulls in the text column become empty texts.  ``keep`` names what :func:`kept` may
    go on holding."""
    if _kept and keep not in _kept:
        _kept.clear()
    if not batch.num_rows:
        return
    texts = pc.fill_null(batch.column(column), "")
    if fill:
        batch = batch.set_column(column, batch.schema.field(column), texts)
    start, size = 0, 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        if size and size + n > most:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    yield batch.slice(start)
    _give_back()

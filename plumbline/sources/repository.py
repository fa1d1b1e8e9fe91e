"""Source files as tables.

Spark's own file listing hides names that begin with ``_`` or ``.``, so the folders are walked by
the driver (names only) and the files are read and parsed by the executors.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.functions import syntax

# Languages by extension; folders whose files are never read.
LANGUAGES = {".py": "python"}
EXCLUDED = frozenset(
    [".venv", "venv", ".env", "__pycache__", ".git", ".svn", "node_modules", "site-packages", "dist", "build", ".tox", ".mypy_cache", ".pytest_cache"]
)

FUNCTIONS = (
    "file_path string, language string, name string, parameters array<string>, return_type string, body_code string, "
    "start_line int, end_line int, dependencies array<string>, ast_fingerprint array<string>, is_stub boolean"
)
#: What chunks are made of, in one row a function.
LISTED = "s array<struct<index: int, start_line: int, end_line: int, writes: array<string>, reads: array<string>, provider: int>>"
STATEMENTS = "index int, parent int, kind string, start_line int, end_line int, source_text string, writes array<string>, reads array<string>"
FILES_AT_ONCE = 500
#: Texts whose rows a worker holds at once.
TEXTS_AT_ONCE = 256


def paths(spark: SparkSession, root: str) -> DataFrame:
    """(file_path, language) of the supported files under a folder; none if any part of a path,
    those above the root too, is an excluded name."""
    base = Path(root)
    if not base.is_dir():
        raise NotADirectoryError(f"Not a directory: {root}")
    found: list[tuple[str, str]] = []
    if EXCLUDED.isdisjoint(base.parts):
        for folder, inner, names in os.walk(base):
            inner[:] = sorted(set(inner) - EXCLUDED)
            found += [(os.path.join(folder, n), LANGUAGES[ext]) for n in sorted(names) if (ext := os.path.splitext(n)[1]) in LANGUAGES and n not in EXCLUDED]
    return spark.createDataFrame(found, "file_path string, language string")


def _rows(path: str, language: str, text: str) -> list[tuple]:
    return [(path, language, f.name, f.parameters, f.return_type, f.body_code, f.start_line, f.end_line, f.dependencies, f.fingerprint, f.is_stub) for f in syntax.functions(text)]


_NAMES = [c.split()[0] for c in FUNCTIONS.split(", ")]


def _schema(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, TEXTS_AT_ONCE):
            yield batch.slice(a, TEXTS_AT_ONCE)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def functions_in_files(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The functions of the files that can be read, (file_path, ok) of these files, and the table that
    both come from: it is persisted, so that a file is read and parsed once, until the caller ends that."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, language in zip(batch["file_path"], batch["language"], strict=True):
                try:
                    rows = _rows(path, language, Path(path).read_bytes().decode("utf-8", "replace"))
                except (OSError, RecursionError):
                    continue
                yield pd.DataFrame([*rows, (path, language, *[None] * 9)], columns=_NAMES)  # the last says that the file was read

    n = max(1, -(-files.count() // FILES_AT_ONCE))
    parsed = files.repartition(n).mapInPandas(parse, FUNCTIONS).persist()
    return parsed.where("name IS NOT NULL"), parsed.where("name IS NULL").select("file_path", F.lit(True).alias("ok")), parsed


def functions_in_snippet(spark: SparkSession, code: str, language: str = "python") -> DataFrame:
    """The functions of a text, under the path ``<snippet>``."""
    if language not in LANGUAGES.values():
        raise ValueError(f"Unsupported language: {language}")
    return spark.createDataFrame(_rows("<snippet>", language, code), FUNCTIONS)


def functions_in_texts(texts: DataFrame, path_col: str, text_col: str, language: str = "python") -> DataFrame:
    """The functions of each text of a table; a null text has none."""

    schema = to_arrow_schema(_schema(FUNCTIONS))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            with syntax.uncollected():
                rows = [r for path, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) if text for r in _rows(path, language, text)]
            yield _batch(rows, schema)

    return texts.select(F.col(path_col).cast("string").alias("p"), F.col(text_col).alias("t")).mapInArrow(parse, FUNCTIONS)


def statements(functions: DataFrame, id_col: str = "id", code_col: str = "body_code") -> DataFrame:
    """One row a statement of each function: the id column and :data:`STATEMENTS`."""
    kind = functions.schema[id_col].dataType.simpleString()
    ddl = f"`{id_col}` {kind}, {STATEMENTS}"
    schema = to_arrow_schema(_schema(ddl))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            with syntax.uncollected():
                rows = [(i, s.index, s.parent, s.kind, s.start_line, s.end_line, s.source_text, s.writes, s.reads) for i, code in zip(*(c.to_pylist() for c in batch.columns), strict=True) for s in syntax.statements(code or "")]
            yield _batch(rows, schema)

    return functions.select(id_col, code_col).mapInArrow(parse, ddl)


def listed_statements(functions: DataFrame, code_col: str = "body_code", over: int = -1) -> DataFrame:
    """The functions of a table that have statements, and more of them than ``over``, each parsed once:
    their columns and :data:`LISTED`, the statements in order with their providers."""
    out = T.StructType([*functions.schema.fields, *_schema(LISTED).fields])
    kind = to_arrow_schema(out).field("s").type
    at = functions.columns.index(code_col)

    def listed(code: str) -> list[tuple] | None:
        found = syntax.statements(code, over, covered=False)
        return [(s.index, s.start_line, s.end_line, s.writes, s.reads, p) for s, p in zip(found, syntax.providers(found), strict=True)] or None

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            with syntax.uncollected():
                lists = pa.array([listed(code or "") for code in batch.column(at).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "s"]).filter(lists.is_valid())

    return functions.mapInArrow(parse, out)


def statement_count(code):
    """A column: statements at all depths of each text."""

    @F.pandas_udf("int")
    def count(code: pd.Series) -> pd.Series:
        with syntax.uncollected():
            return code.map(lambda c: syntax.count_statements(c or "")).astype("int32")

    return count(code)

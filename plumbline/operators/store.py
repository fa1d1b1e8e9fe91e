"""The index: Parquet tables of methods and chunks that grow by segments.

An append is one write of a new segment; a delete is one write of ids (a tombstone), so neither
rewrites what is there.  A vector of a deleted row is still there, and still takes places in a
search of :meth:`Index.vectors`, until :meth:`Index.compact` makes new tables without it.

Which segments count, and the greatest id ever given, is said by the newest manifest, a small file
that is never changed.  A change becomes visible in one step, by the next manifest's appearing; a
writer that finds it taken by another is refused and has changed nothing.  What no manifest names
any more stays readable until :meth:`Index.vacuum`.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

METHODS = (
    "id bigint, file_path string, language string, name string, parameters array<string>, return_type string, body_code string, "
    "normalized_code string, code_hash string, start_line int, end_line int, dependencies array<string>, ast_fingerprint array<string>, "
    "embedding array<float>"
)
CHUNKS = (
    "id bigint, function_id bigint, chunk_index int, statement_start int, statement_end int, statement_indices array<int>, "
    "function_name string, file_path string, depends_on_chunks array<int>, depended_on_by_chunks array<int>, normalized_code string, "
    "code_hash string, dependency_links array<int>, created_at timestamp, embedding array<float>"
)
KINDS = ("methods", "methods_deleted", "chunks", "chunks_deleted")
#: What a column is where an older segment lacks it.
DEFAULTS = {"ast_fingerprint": F.array, "depends_on_chunks": F.array, "depended_on_by_chunks": F.array, "dependency_links": F.array, "dependencies": F.array, "statement_indices": F.array}


class Index:
    """The tables under one folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.fs = self._hadoop(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._hadoop(f"{self.folder}/manifests"))

    # --- tables

    def _path(self, kind: str) -> str:
        return f"{self.folder}/{kind}"

    def _hadoop(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _listed(self, folder: str) -> list[str]:
        path = self._hadoop(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def _state(self) -> tuple[int, dict]:
        """The newest manifest's number and contents; without one, the segments that are there."""
        numbers = [n for n in self._listed(f"{self.folder}/manifests") if n.endswith(".json")]
        if numbers:
            stream = self.fs.open(self._hadoop(f"{self.folder}/manifests/{numbers[-1]}"))
            try:
                return int(numbers[-1][:-5]), json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
        done = {k: [n for n in self._listed(self._path(k)) if self.fs.exists(self._hadoop(f"{self._path(k)}/{n}/_SUCCESS"))] for k in KINDS}
        return 0, {"segments": done, "top": {}}

    def _commit(self, number: int, state: dict) -> None:
        """Makes a state that was derived from manifest ``number`` the newest one."""
        state["writer"] = uuid.uuid4().hex
        draft, path = (f"{self.folder}/manifests/{name}" for name in (f"draft-{state['writer']}", f"{number + 1:012d}.json"))
        out = self.fs.create(self._hadoop(draft), False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if self.fs.exists(self._hadoop(path)) or not self.fs.rename(self._hadoop(draft), self._hadoop(path)) or self._state()[1].get("writer") != state["writer"]:
            self.fs.delete(self._hadoop(draft), False)
            raise RuntimeError(f"another writer has changed the index {self.folder}; nothing was changed, try again")

    def _segments(self, kind: str) -> list[str]:
        return [f"{self._path(kind)}/{n}" for n in self._state()[1]["segments"].get(kind, [])]

    def _schema(self, kind: str) -> T.StructType:
        return T._parse_datatype_string({"methods": METHODS, "chunks": CHUNKS}.get(kind, "id bigint"))

    def _all(self, kind: str) -> DataFrame:
        """Every row ever written and not compacted away."""
        schema, parts = self._schema(kind), self._segments(kind)
        if not parts:
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.schema(schema).parquet(*parts)
        return df.select(*(F.coalesce(c, DEFAULTS[c]().cast(schema[c].dataType)).alias(c) if c in DEFAULTS else c for c in df.columns))

    def _live(self, kind: str) -> DataFrame:
        rows = self._all(kind)
        return rows.join(self._all(f"{kind}_deleted"), "id", "left_anti") if self._segments(f"{kind}_deleted") else rows

    def methods(self) -> DataFrame:
        return self._live("methods")

    def chunks(self) -> DataFrame:
        return self._live("chunks")

    def vectors(self, kind: str = "methods") -> DataFrame:
        """(id, embedding) of all rows, deleted ones too."""
        return self._all(kind).select("id", "embedding")

    def vector(self, id_: int, kind: str = "methods") -> DataFrame:
        """The vector of a row, a deleted one too."""
        return self.vectors(kind).where(F.col("id") == id_)

    def method(self, id_: int) -> DataFrame:
        return self.methods().where(F.col("id") == id_)

    def chunk(self, id_: int) -> DataFrame:
        return self.chunks().where(F.col("id") == id_)

    def by_file(self, path: str, kind: str = "methods") -> DataFrame:
        return self._live(kind).where(F.col("file_path") == path)

    def by_function(self, id_: int) -> DataFrame:
        return self.chunks().where(F.col("function_id") == id_)

    def stats(self) -> DataFrame:
        """One row: total_methods, total_files and vectors, deleted ones too."""
        live = self.methods().agg(F.count("*").alias("total_methods"), F.countDistinct("file_path").alias("total_files"))
        return live.crossJoin(self._all("methods").agg(F.count("*").alias("vectors")))  # one row each

    # --- changes

    def _write(self, kind: str, rows: DataFrame) -> str:
        name = f"segment-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self._path(kind)}/{name}")
        return name

    def _add(self, kind: str, rows: DataFrame, number: int, state: dict) -> None:
        state["segments"][kind] = [*state["segments"].get(kind, []), self._write(kind, rows)]
        self._commit(number, state)

    def _append(self, kind: str, rows: DataFrame, order: list[str]) -> int:
        """Adds rows with new ids in the given order; an id is never used again.  Returns how many."""
        number, state = self._state()
        top = state["top"].get(kind)
        if top is None:  # tables from before there were manifests
            top = self._all(kind).agg(F.max("id")).head()[0] or 0
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        draft = f"{self.folder}/drafts/{kind}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{draft}/made")  # dealing out by range reads its input twice
        spread = self.spark.read.schema(rows.schema).parquet(f"{draft}/made").repartitionByRange(n, *order).sortWithinPartitions(*order)
        spread.withColumn("_part", F.spark_partition_id()).withColumn("_nth", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).write.parquet(f"{draft}/sorted")
        self.fs.delete(self._hadoop(f"{draft}/made"), True)
        held = self.spark.read.parquet(f"{draft}/sorted")
        counts = held.groupBy("_part").agg(F.count("*").alias("n"))
        first = counts.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_first"))  # a row a task
        named = held.join(F.broadcast(first), "_part").withColumn("id", top + 1 + F.col("_first") + F.col("_nth"))
        total = counts.agg(F.sum("n")).head()[0] or 0
        try:
            if total:
                state["top"][kind] = top + total
                own = named.select(*((F.col(f.name) if f.name in named.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self._schema(kind)))
                self._add(kind, own, number, state)
        finally:
            self.fs.delete(self._hadoop(draft), True)
        return total

    def add_methods(self, rows: DataFrame) -> int:
        return self._append("methods", rows, ["file_path", "start_line", "name"])

    def add_chunks(self, rows: DataFrame) -> int:
        stamped = rows.withColumns({
            "dependency_links": F.col("depends_on_chunks"),
            "code_hash": F.when(F.coalesce("normalized_code", F.lit("")) == "", "").otherwise(F.sha2("normalized_code", 256)),
            "created_at": F.current_timestamp(),
        })
        return self._append("chunks", stamped, ["function_id", "chunk_index"])

    def _delete(self, kind: str, ids: DataFrame) -> int:
        number, state = self._state()
        gone = ids.select("id").distinct()
        n = gone.count()
        if n:
            self._add(f"{kind}_deleted", gone, number, state)
        return n

    def delete_method(self, id_: int) -> bool:
        """Deletes one method, not its chunks; false if it is not there."""
        return self._delete("methods", self.method(id_)) > 0

    def delete_chunk(self, id_: int) -> bool:
        return self._delete("chunks", self.chunk(id_)) > 0

    def delete_chunks_of(self, functions: DataFrame) -> int:
        """Deletes the chunks of the functions of a table with their ids; returns how many."""
        return self._delete("chunks", self.chunks().join(functions.select(F.col("id").alias("function_id")).distinct(), "function_id", "left_semi"))

    def delete_files(self, files: DataFrame) -> int:
        """Deletes the methods of all files of a table (file_path) and their chunks; returns the
        number of methods."""
        gone = self.methods().join(files.select("file_path").distinct(), "file_path", "left_semi").select("id")
        self.delete_chunks_of(gone)
        return self._delete("methods", gone)

    def compact(self) -> None:
        """Writes the tables anew without deleted rows; readers see the old segments or the new ones."""
        number, state = self._state()
        for kind in ("methods", "chunks"):
            if state["segments"].get(f"{kind}_deleted"):
                if state["top"].get(kind) is None:
                    state["top"][kind] = self._all(kind).agg(F.max("id")).head()[0] or 0
                state["segments"] |= {kind: [self._write(kind, self._live(kind))], f"{kind}_deleted": []}
        self._commit(number, state)

    def vacuum(self) -> None:
        """Deletes segments that the newest manifest does not name, and older manifests: for when no
        reader or writer of an earlier state is left."""
        number, state = self._state()
        if not number:
            return
        for kind in KINDS:
            for name in set(self._listed(self._path(kind))) - set(state["segments"].get(kind, [])):
                self.fs.delete(self._hadoop(f"{self._path(kind)}/{name}"), True)
        for name in self._listed(f"{self.folder}/manifests"):
            if name != f"{number:012d}.json":
                self.fs.delete(self._hadoop(f"{self.folder}/manifests/{name}"), True)

"""Incremental indexing of a stream of source files (an extension: the operations are batch ones).

The file source tells which files are new; each micro-batch goes the way of a batch index run.  Its
listing hides names that begin with ``_`` or ``.``: a batch run over the folder finds those.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.plans.operations import Engine
from plumbline.sources import repository


def watch(engine: Engine, root: str, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Indexes files as they appear under ``root``.  A file whose path the index already has is
    replaced, so a batch that runs again after a failure leaves no duplicates."""
    index = engine.index(folder)

    def add(batch: DataFrame, _: int) -> None:
        functions = repository.functions_in_texts(batch, "file_path", "value")
        kept = engine._prepared(functions.where(~F.col("is_stub"))).persist()
        index.delete_files(batch.select("file_path"))
        index.add_methods(kept.drop("is_stub"))
        kept.unpersist()

    files = engine.spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", "*.py").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^file:/+", "/")
    named = files.select(path.alias("file_path"), "value")
    named = named.where(~F.arrays_overlap(F.split("file_path", "/"), F.array(*map(F.lit, sorted(repository.EXCLUDED)))))
    return named.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

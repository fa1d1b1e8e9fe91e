"""A Spark session with the settings that the engine expects."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

#: Adaptive plans split skewed joins and coalesce small partitions; Arrow batches stay small enough
#: for a Python worker when texts are long.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.session.timeZone": "UTC",
}


def session(name: str = "plumbline", **settings: str) -> SparkSession:
    """The running session, or a new one with :data:`SETTINGS` and the given ones."""
    builder = SparkSession.builder.appName(name)
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_own_folder: str | None = None


def shared_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the folder that driver and executors share: ``spark.checkpoint.dir``, or, where
    that is unset and the session is on local cores (as in tests), a folder of this process."""
    global _own_folder
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not named and _own_folder is None:
        _own_folder = "file://" + tempfile.mkdtemp(prefix="plumbline-")
    return f"{(named or _own_folder).rstrip('/')}/{what}-{uuid.uuid4().hex}"

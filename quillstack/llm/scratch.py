"""Shared tables between the steps of a job."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors see; where it is unset (tests), a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        checkpoint = spark.sparkContext._jsc.sc().getCheckpointDir()
        if checkpoint.isDefined():
            return checkpoint.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-quillstack-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return folder


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
Save = Callable[[DataFrame, str], DataFrame]
_lock = threading.Lock()
_writes: dict[int, tuple[int, str]] = {}  # by session: writes that run now, and the setting before the first of them


@contextmanager
def removing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files are removed as soon as the query that made them ends. Writes of several threads share the setting."""
    with _lock:
        count, before = _writes.get(id(spark), (0, spark.conf.get(CLEANUP)))
        _writes[id(spark)] = count + 1, before
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            count, before = _writes.pop(id(spark))
            if count > 1:
                _writes[id(spark)] = count - 1, before
            else:
                spark.conf.set(CLEANUP, before)


def save(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Writes a table to the shared folder and reads it back: it cuts the lineage, and a lost executor loses nothing.

    The shuffle files that made the table are removed as soon as it is written.
    """
    spark = df.sparkSession
    path = f"{(folder or scratch_dir(spark)).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with removing_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def room(spark: SparkSession) -> Iterator[Save]:
    """A `save` for the tables between the steps of one job; they are removed at the end, when the result is saved elsewhere."""
    folder = f"{scratch_dir(spark).rstrip('/')}/room-{uuid.uuid4().hex}"
    try:
        yield lambda df, name: save(df, name, folder)
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

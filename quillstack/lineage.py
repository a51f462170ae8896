"""Tables between the steps of a job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where neither it nor a checkpoint folder is set, and all runs in one process, a new one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    checkpoint = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not checkpoint.isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-quillstack-", dir="/tmp"))
        checkpoint = spark.sparkContext._jsc.sc().getCheckpointDir()
    return checkpoint.get()


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a table in the shared folder: what made them is computed once, and a lost executor loses nothing."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Tables that grow by numbered batches, each of which counts once.

A batch is written to a folder of its own, in place of what an earlier try left there, and then marked by an empty file. Readers
see marked batches only. So a batch that is played again changes nothing, and one that ended between both writes is
written anew. A snapshot is a batch that stands for all batches up to its number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, where: str):  # noqa: ANN202
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def numbers(spark: SparkSession, folder: str) -> list[tuple[int, str]]:
    """(number, kind) of the marked batches that readers need: the last snapshot, and the batches after it."""
    fs, path = _path(spark, f"{folder}/_marks")
    if not fs.exists(path):
        return []
    found = sorted((int(name.partition("-")[2]), name.partition("-")[0]) for name in (x.getPath().getName() for x in fs.listStatus(path)) if not name.startswith((".", "_")))
    last = max((n for n, kind in found if kind == "snapshot"), default=None)
    return [(n, kind) for n, kind in found if last is None or kind == "snapshot" and n == last or kind == "batch" and n > last]


def marked(spark: SparkSession, folder: str, number: int, kind: str = "batch") -> bool:
    fs, path = _path(spark, f"{folder}/_marks/{kind}-{number}")
    return fs.exists(path)


def mark(spark: SparkSession, folder: str, number: int, kind: str = "batch") -> None:
    fs, path = _path(spark, f"{folder}/_marks/{kind}-{number}")
    fs.create(path, True).close()


def part(folder: str, number: int, name: str, kind: str = "batch") -> str:
    return f"{folder}/{kind}-{number}/{name}"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """All rows of a table of the marked batches with the number of their batch; None without a batch."""
    found = numbers(spark, folder)
    if not found:
        return None
    parts = [spark.read.parquet(part(folder, n, name, kind)).withColumn("_batch", F.lit(n).cast("long")) for n, kind in found]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out

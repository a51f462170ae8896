"""Sources and sinks of the catalog."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..lineage import written
from ..operators.gate import passed


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return found is not None and len(found) > 0


def read_manifest_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV of strings with a header; byte-order mark and NULs go; a missing file is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    named = {c.replace("﻿", "").replace("\x00", "").strip(): c for c in rows.columns}
    clean = [F.regexp_replace(F.col(f"`{named[f.name]}`"), "[\\x00﻿]", "").cast(f.dataType).alias(f.name) if f.name in named else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    return rows.select(*clean)


VECTOR_SCHEMA = "media_path string, model string, pretrained string, embedding array<double>, _corrupt_record string"


def read_vectors_jsonl(spark: SparkSession, path: str, broken: bool = False) -> DataFrame:
    """Vectors by media_path; the last good line of a path wins.

    Broken lines and those without a path or a vector are left out; with `broken` each stays, as a row without a vector, so that
    an import counts it as failed. Empty lines are no lines.
    """
    columns = ["media_path", "model", "pretrained", "embedding"]
    if not exists(spark, path):
        return spark.createDataFrame([], "media_path string, model string, pretrained string, embedding array<double>")
    rows = spark.read.schema(VECTOR_SCHEMA).json(path, mode="PERMISSIVE").withColumn("place", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at")))
    good = F.col("_corrupt_record").isNull() & F.coalesce((F.length("media_path") > 0) & (F.size("embedding") > 0), F.lit(False))
    last = Window.partitionBy("media_path").orderBy(F.desc("place"))  # files by name, blocks of a file by their start, lines of a block in order
    kept = rows.where(good).withColumn("rn", F.row_number().over(last)).where("rn = 1").select(columns)
    if not broken:
        return kept
    bad = rows.where(~good).withColumn("embedding", F.lit(None).cast("array<double>"))
    return kept.union(bad.select(columns))


def listed(folders: DataFrame, scheme_in_tasks: bool) -> DataFrame:
    """(path, is_dir, size_bytes, mtime) of what stands directly in each of the folders (path)."""
    schema = "path string, is_dir boolean, size_bytes long, mtime timestamp"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for folder in batch.column(0).to_pylist():
                store, inside = fs.FileSystem.from_uri(quote(folder, safe=":/@"))
                prefix = folder[: len(folder) - len(inside)]
                found = store.get_file_info(fs.FileSelector(inside, allow_not_found=True))
                times = pa.array([x.mtime for x in found], pa.timestamp("us", tz="UTC"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([prefix + x.path for x in found], pa.string()), pa.array([x.type == fs.FileType.Directory for x in found], pa.bool_()), pa.array([x.size or 0 for x in found], pa.int64()), times],
                    ["path", "is_dir", "size_bytes", "mtime"],
                )

    if scheme_in_tasks:
        return folders.repartition(64, "path").mapInArrow(run, schema)
    spark, rows = folders.sparkSession, []
    for folder in folders.collect():  # a store that only Spark's own file system opens: its folders are listed one by one
        where = spark._jvm.org.apache.hadoop.fs.Path(folder["path"])
        for x in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where):
            rows.append((x.getPath().toString(), x.isDirectory(), x.getLen(), x.getModificationTime() / 1000))
    return spark.createDataFrame(rows, "path string, is_dir boolean, size_bytes long, at double").select("path", "is_dir", "size_bytes", F.timestamp_micros((F.col("at") * 1_000_000).cast("long")).alias("mtime"))


IN_TASKS = ("file", "s3", "gs", "gcs", "hdfs")  # schemes that tasks can list themselves


def scan_entries(spark: SparkSession, root: str, skip_dirs: Sequence[str] = ()) -> DataFrame:
    """All files and folders below root, folders to be skipped among them, but nothing that stands in those.

    The folders of a level are the rows of a job, which lists each in a task; what it finds is the next level. A skipped
    folder is never opened. Levels are written tables. Links to folders are followed like folders.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    root = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    scheme, _, rest = root.partition(":")
    in_tasks = scheme in IN_TASKS
    folders = spark.createDataFrame([(f"{scheme}:///{rest.lstrip('/')}" if scheme == "file" else root,)], "path string")
    levels = []
    while True:
        level = written(listed(folders, in_tasks), "listing")
        levels.append(level)
        folders = level.where("is_dir").select("path")
        if skip_dirs:
            folders = folders.where(~F.element_at(F.split("path", "/"), -1).isin(*skip_dirs))
        if folders.isEmpty():
            return reduce(DataFrame.union, levels)


def scan_files(spark: SparkSession, root: str, extensions: Sequence[str], skip_dirs: Sequence[str] = ()) -> DataFrame:
    """(path, ext, size_bytes, mtime) of files below root; contents aren't read, and skipped folders aren't listed."""
    found = scan_entries(spark, root, skip_dirs).where("not is_dir")
    found = found.withColumn("ext", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))).where(F.col("ext").isin(*extensions))
    return found.select("path", "ext", "size_bytes", "mtime")


LARGE = 1 << 30
BOM = b"\xef\xbb\xbf"


def hash_files(spark: SparkSession, folder: str, large: int = LARGE, glob: str = "*") -> DataFrame:
    """(path, size_bytes, sha256) of the files in a folder and below, read by Spark from any store that it can open.

    Files of up to `large` bytes are single values, hashed where they are read. Larger ones are read in ranges, by as many
    tasks as they have ranges, as pieces between line feeds; the pieces of a file meet in order in one task, which feeds them
    to a hash and holds a batch of them at a time. Spark's
    readers pass over empty files, so these have no row (scan_files lists them). A folder that isn't there raises an error.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    small = files.where(F.col("length") <= large).select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))
    if files.where(F.col("length") > large).select("path").isEmpty():
        return small
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("lineSep", "\n").text(folder)
    lines = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size_bytes"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("piece"))
    ordered = lines.where(F.col("size_bytes") > large).repartition("path").sortWithinPartitions("path", "start", "at")
    return small.union(ordered.select("path", "size_bytes", "piece").mapInArrow(hash_pieces, "path string, size_bytes long, sha256 string"))


def hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, size_bytes, sha256) from the pieces of files in order. The reader drops a byte-order mark and the last line feed; the size tells whether a file had them."""
    now, size, seen, states = None, 0, 0, []

    def ended() -> tuple[str, int, str]:
        mark, feed = divmod(size - seen, 3)
        state = states[mark]
        if feed:
            state.update(b"\n")
        return now, size, state.hexdigest()

    def rows(found: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))], ["path", "size_bytes", "sha256"])

    for batch in batches:
        found = []
        for path, total, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if path != now:
                if now is not None:
                    found.append(ended())
                now, size, seen, states = path, total, 0, [hashlib.sha256(), hashlib.sha256(BOM)]
            else:
                piece = b"\n" + piece
            seen += len(piece)
            for state in states:
                state.update(piece)
        yield rows(found)
    if now is not None:
        yield rows([ended()])


def merge_keyed(old: DataFrame, new: DataFrame, key: str, live: DataFrame | None = None) -> DataFrame:
    """New rows replace old ones by key; with `live`, keys that it lacks are dropped."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_new")))
    merged = both.withColumn("_rank", rank).where("_rank = 1").drop("_new", "_rank")
    return merged.join(live.select(key).distinct(), key, "left_semi") if live is not None else merged


def audit_rows(spark: SparkSession, operation: str, rows: int, detail: str = "") -> DataFrame:
    """One row of the audit table."""
    return spark.createDataFrame([(operation, rows, detail)], "operation string, rows long, detail string").withColumn("created_at", F.current_timestamp())


def append_audit(df: DataFrame, operation: str, path: str, detail: str = "", write: Callable[[DataFrame], None] | None = None) -> int:
    """Appends the count of a job's rows to the audit table, and returns it.

    With `write`, which writes a table that it is given, the count comes from that write itself, in one job; without, the rows
    are counted.
    """
    if write is None:
        rows = df.count()
    else:
        seen = Observation()
        write(df.observe(seen, F.count(F.lit(1)).alias("rows")))
        rows = int(seen.get["rows"])
    audit_rows(df.sparkSession, operation, rows, detail).write.mode("append").parquet(path)
    return rows


def rowcount_report(sources: Mapping[str, DataFrame]) -> DataFrame:
    """(source, rows) of each table."""
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("source"), "rows") for n, df in sources.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def missing_hash(items: DataFrame) -> DataFrame:
    """Gated items without a hash."""
    return passed(items).where("coalesce(sha256, '') = ''")


def missing_probe(items: DataFrame) -> DataFrame:
    """Gated videos without a duration or dimensions, photos without dimensions."""
    return passed(items).where("(media_type in ('video', 'photo') and (width is null or height is null)) or (media_type = 'video' and duration is null)")

"""Work tables in the folder that driver and executors share, and bounded slices of Arrow batches.

Lineage is cut by writing a Parquet table below ``spark.checkpoint.dir``; a lost executor then costs a re-read and
nothing else.  Only in local mode, where one machine does everything, an unset folder is replaced by ``/tmp/checkpoints``;
on a cluster the setting is required.  A table that later steps no longer read is deleted with ``discard``.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
LOCAL_FALLBACK = "/tmp/checkpoints"
#: Bytes of a column that a Python worker unpacks at once.
SLICE_BYTES = 2_000_000


def shared_root(spark: SparkSession) -> str:
    """Root of the shared work folder, without a trailing slash."""
    root = spark.sparkContext.getConf().get(CHECKPOINT_KEY) or spark.conf.get(CHECKPOINT_KEY, None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"{CHECKPOINT_KEY} has to name a folder that driver and executors share")
        root = LOCAL_FALLBACK
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder name that no other run uses; it is not created here."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` as a work table and return a reader of it; the plan above starts from the files.

    Shuffle files of the write are removed as it ends: nothing reads them again, and a lost table part is a lost file.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    before = spark.conf.get(CLEANUP_KEY, None)
    spark.conf.set(CLEANUP_KEY, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        spark.conf.unset(CLEANUP_KEY) if before is None else spark.conf.set(CLEANUP_KEY, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.work_folder = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete work tables that nothing reads any more."""
    for table in tables:
        path = getattr(table, "work_folder", None)
        if path:
            spark = table.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def fresh(taken: list[str], name: str) -> str:
    """``name``, lengthened until it clashes with no column of ``taken`` (case-insensitively, as Spark resolves)."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batch`` in runs whose ``column`` holds about ``most_bytes``; a longer value is a run of its own."""
    each = max(1, batch.column(column).nbytes // max(1, batch.num_rows))
    step = max(1, most_bytes // each)
    for begin in range(0, batch.num_rows, step):
        part = batch.slice(begin, step)
        if part.num_rows > 1 and part.column(column).nbytes > 2 * most_bytes:
            half = part.num_rows // 2
            yield from slices(part.slice(0, half), column, most_bytes)
            yield from slices(part.slice(half), column, most_bytes)
        else:
            yield part

"""Shared-folder tables, input sizes and Arrow helpers of the operators."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir, or, where one machine does all and it is unset, a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "lodestrata-shared")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read back: its lineage is cut, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._kept_at = path
    return made


def drop(*frames: DataFrame) -> None:
    """Delete tables that `kept` wrote and that no later plan reads."""
    for df in frames:
        if path := getattr(df, "_kept_at", None):
            spark = df.sparkSession
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int, mb: int = 8):
    """While it lasts, what is executed hands at most `rows` rows, of some `mb` MB, at a time to Python."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": f"{mb << 20}b"}
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def released(run):
    """`run` over a partition's batches; at its end the worker, which Spark uses again, gives freed memory back to the system."""

    @functools.wraps(run)
    def tidy(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
        if trim is not None:
            trim(0)

    return tidy


def input_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the size of `df` (file sizes for a scan)."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return min(size, 1 << 60)


def spread(scan: DataFrame) -> DataFrame:
    """A scan with fewer parts than there are cores (one small file, one row group) dealt to all of them; others as they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan._jdf.queryExecution().toRdd().getNumPartitions() >= cores else scan.repartition(cores)


def parts(df: DataFrame, mb: float, least: int = 1) -> int:
    """Partitions of about `mb` MB of stored input each."""
    return max(least, -(-input_bytes(df) // int(mb * 1e6)))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows in them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8, int(at[-1] - at[0]), int(at[0])), at - at[0]


def chunks(offsets: np.ndarray, most: int):
    """Ranges of whole rows of up to `most` bytes (one row at least)."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1
        end = min(n, max(end, start + 1))
        yield start, end
        start = end

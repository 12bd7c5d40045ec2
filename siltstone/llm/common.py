"""Shared pieces of the training-data operators: scratch tables, Arrow batches as NumPy, hashing.

Scratch tables replace lineage cuts: a step that is read more than once is written as Parquet under the folder
named by ``spark.checkpoint.dir`` (shared by all executors), so a lost executor costs a re-read, not a re-run.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a NumPy step holds at once.
BATCH_BYTES = 4 << 20

_own_dir: str | None = None


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only where none is set (local tests)."""
    global _own_dir
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="siltstone-")
    return _own_dir


def own_folder(spark: SparkSession) -> str:
    """Where this application's scratch tables lie."""
    return f"{scratch_dir(spark)}/siltstone/llm-{spark.sparkContext.applicationId}"


def delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clean(spark: SparkSession) -> None:
    """Delete this application's scratch tables: to be called once the results that came through them are written."""
    delete(spark, own_folder(spark))


class Scratch:
    """Tables of one operator call, in a folder of their own."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.path = f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def table(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """Write df, in a folder for each value of by, and read it back; the plan that made it is forgotten."""
        self.count += 1
        path = f"{self.path}/{self.count:02d}-{name}"
        (df.write.partitionBy(by) if by else df.write).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        release(self.spark)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for df in tables:
            delete(self.spark, df.scratch_path)

    def drop_part(self, df: DataFrame, folder: str) -> None:
        """Delete a folder of a table written by a column."""
        delete(self.spark, f"{df.scratch_path}/{folder}")


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete shuffle files of finished steps."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Let the system have the memory that this Python worker holds and does not use."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def thrifty(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, with its memory given back at the end of the task: workers wait for the next one, and steps without Python need the room."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return task


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """A column name like name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def input_bytes(df: DataFrame, column: str) -> int:
    """Bytes in a string column over all rows: one pass, one number to the driver."""
    from pyspark.sql import functions as F

    return df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("n")).first()["n"]


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if at is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of at most limit bytes, or of one row that is longer."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def blob_column(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary array whose row i is data[offsets[i]:offsets[i + 1]]."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finalizer (multiply and xor-shift); x: uint64."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x

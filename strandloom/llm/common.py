"""Shared pieces of the training-data operators: scratch space, tokenisation, Arrow access."""

from __future__ import annotations

import ctypes
import gc
import threading
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_SCRATCH = "/tmp/checkpoints"
ARROW_ROWS = 2000
_MADE: list[str] = []
_SETTING = threading.RLock()  # writes that change a setting of the session come one after the other


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one where that is unset and all runs in one process (tests)."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return shared or LOCAL_SCRATCH


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def bounded_batches(spark: SparkSession) -> None:
    """From now on this session hands at most ARROW_ROWS rows at a time to Python: for applications whose rows are long texts."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(rows, min(int(spark.conf.get(rows)), ARROW_ROWS))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a compressed table to the shared folder and read it back: cuts lineage, survives executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    with _SETTING:
        before = spark.conf.get(rows)
        spark.conf.set(rows, min(int(before), ARROW_ROWS))  # long texts: what a Python worker holds at a time stays small
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            spark.conf.set(rows, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if path in _MADE:
        _MADE.remove(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialise() that nothing will read again."""
    for df in tables:
        if path := df.__dict__.get("_scratch_path"):
            _delete(df.sparkSession, path)


def forget_shuffles(spark: SparkSession) -> None:
    """Shuffle files go once the driver has collected what refers to them: now, instead of whenever it needs memory."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shrink_heaps(spark: SparkSession) -> int:
    """Every executor collects its garbage, after which its heap gives memory back that earlier work had made it take. Returns
    how many executors were asked: one small task each, and none where all runs in one process."""
    n = len(spark.sparkContext._jsc.sc().statusTracker().getExecutorInfos()) - 1
    if n > 0:
        spark.range(0, n, 1, n).selectExpr("java_method('java.lang.System', 'gc') AS done").collect()
    return n


def release(spark: SparkSession) -> None:
    """Delete all scratch tables and archives of this process. What operators returned and has not been written yet is lost."""
    for path in list(_MADE):
        _delete(spark, path)


def give_back() -> None:
    """What a Python worker has freed goes back to the machine: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words_of(data: bytes) -> list[bytes]:
    """Lower-case A-Z, then words [^\\x20\\x09-\\x0D]+: exactly what bytes.lower and bytes.split do."""
    return data.lower().split()


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def small_batches(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Slices, so that what a task holds beside the Arrow batch stays small when texts are long."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def bucket_of(column: str, modulus: int):
    """crc32(column as text) mod modulus; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))

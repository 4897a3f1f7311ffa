"""Benchmark series and sweep results as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SERIES = "dimension string, backend string, n int, time_s double"
#: The series that a benchmark file may hold, in the order in which they are written.
KNOWN = (("2d", "python"), ("2d", "rust"), ("3d", "python"), ("3d", "rust"))


def _order():
    out = None
    for k, (dimension, backend) in enumerate(KNOWN):
        is_it = (F.col("dimension") == dimension) & (F.col("backend") == backend)
        out = F.when(is_it, k) if out is None else out.when(is_it, k)
    return out


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """Rows of unknown series are left out."""
    return spark.read.schema(SERIES).csv(path, header=True).filter(_order().isNotNull())


def write_series(df: DataFrame, path: str) -> None:
    """One file with a header, series in their order, by n within each."""
    df.select("dimension", "backend", "n", "time_s").withColumn("_o", _order()).orderBy("_o", "n").drop("_o").coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_sweep(df: DataFrame, path: str) -> None:
    """A sweep's rows as CSV with a header; null where an expectation is open."""
    df.write.mode("overwrite").csv(path, header=True)

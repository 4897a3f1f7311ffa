"""Benchmark tables: speedups at common sizes, medians, scaling exponents, memory estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def speedups(series: DataFrame, slow: str = "python", fast: str = "rust") -> DataFrame:
    """dimension, n, slow_s, fast_s, ratio at the sizes that both series have."""
    side = lambda backend, name: series.filter(F.col("backend") == backend).select("dimension", "n", F.col("time_s").alias(name))
    return side(slow, "slow_s").join(side(fast, "fast_s"), ["dimension", "n"]).withColumn("ratio", F.col("slow_s") / F.col("fast_s"))


def speedup_summary(series: DataFrame) -> DataFrame:
    """By dimension: common sizes, median ratio, and the ratio at the largest common size."""
    return speedups(series).groupBy("dimension").agg(F.count("*").alias("points"), F.median("ratio").alias("median_ratio"), F.max("n").alias("tail_n"), F.max_by("ratio", "n").alias("tail_ratio"))


def scaling(series: DataFrame) -> DataFrame:
    """The slope of ln(time) on ln(n) by dimension and backend."""
    return series.groupBy("dimension", "backend").agg(F.regr_slope(F.log("time_s"), F.log("n")).alias("exponent"))


def median_times(samples: DataFrame) -> DataFrame:
    """Repeated measurements of a size as their median."""
    return samples.groupBy("dimension", "backend", "n").agg(F.median("time_s").alias("time_s"))


def dp_bytes(n, sequences: int) -> Column:
    """What a table of all cells would take: 3 kinds of 11 bytes each in two dimensions, 7 of 12 in three."""
    side = F.col(n) + 1 if isinstance(n, str) else n + 1
    side = side.cast("double")
    return side * side * (3 * 11) if sequences == 2 else side * side * side * (7 * 12)


def before_cap(series: DataFrame, cap_bytes: float) -> DataFrame:
    """The sizes of each series before the first whose table is over the cap."""
    need = F.when(F.col("dimension") == "2d", dp_bytes("n", 2)).otherwise(dp_bytes("n", 3))
    marked = series.withColumn("bytes", need)
    stop = marked.filter(F.col("bytes") > cap_bytes).groupBy("dimension", "backend").agg(F.min("n").alias("stop"))
    return marked.join(F.broadcast(stop), ["dimension", "backend"], "left").filter(F.col("stop").isNull() | (F.col("n") < F.col("stop"))).drop("stop")


def common_sizes(series: DataFrame) -> DataFrame:
    """dimension, n that every backend of the dimension has, in order."""
    own = lambda b: series.filter(F.col("backend") == b).select("dimension", "n")
    return own("python").intersect(own("rust")).orderBy("dimension", "n")

"""Streams: the row functions run on them unchanged; windows count what passes.

These are extensions: the engine's operators have no notion of time but for the rate limit, whose audit is here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.config import AlignConfig
from ..operators.align import dimer_score


def stream_pairs(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of pairs (ts, seq1, seq2) from the Parquet files of a folder."""
    return spark.readStream.schema("ts timestamp, seq1 string, seq2 string").option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def scored_stream(pairs: DataFrame, config: AlignConfig | None = None) -> DataFrame:
    """Stateless: every pair with its dimer score."""
    return pairs.withColumn("score", dimer_score("seq1", "seq2", config))


def strong_dimers_by_window(scored: DataFrame, least: float, length: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Tumbling windows over event time: pairs, and those that reach `least`. State older than the watermark goes."""
    counted = scored.withWatermark("ts", late).groupBy(F.window("ts", length))
    return counted.agg(F.count("*").alias("pairs"), F.count_if(F.col("score") >= least).alias("strong")).select(F.col("window.start").alias("start"), "pairs", "strong")


def calls_in_period(calls: DataFrame, ts: str = "ts", seconds: int = 60, by: list[str] | None = None) -> DataFrame:
    """Adds n_calls: the calls of the last `seconds` up to each call, its own included. `by` (an account) parts the window."""
    order = Window.partitionBy(*(by or [])).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return calls.withColumn("n_calls", F.count("*").over(order))

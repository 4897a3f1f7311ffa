"""Sequences from tables, lists and hashes: every source is reproducible and distributed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dna import hashed_primer

#: Small pairs and triples that expose asymmetries.
WITNESS_PAIRS = [("A", "A"), ("A", "C"), ("T", "G"), ("AC", "GT"), ("AGTC", "CTGA")]
WITNESS_TRIPLES = [("A", "A", "A"), ("A", "C", "T"), ("AC", "GT", "TG"), ("AGTC", "CTGA", "TCAA")]


def primer_set(spark: SparkSession, seqs: Sequence[str], names: Sequence[str]) -> DataFrame:
    """(i, name, seq) from two lists of equal length, in their order."""
    if len(seqs) != len(names):
        raise ValueError("seqs and names must have the same length")
    return spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(zip(names, seqs, strict=True))], "i long, name string, seq string")


def table_primers(spark: SparkSession, sf_dir: str, table: str, key: str, tag: str) -> DataFrame:
    """(k, seq): a primer of 16 to 27 bases for every row of a table."""
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.col(key).cast("long").alias("k"))
    return rows.select("k", hashed_primer(tag, "k").alias("seq"))


def random_dna(spark: SparkSession, rows: int, shortest: int, longest: int, seed: int = 0, columns: Sequence[str] = ("seq1", "seq2")) -> DataFrame:
    """(pair_id, columns): uniform sequences, lengths uniform in [shortest, longest], from md5 of seed, column and row.

    A partition's rows depend on nothing but their numbers, so any number of tasks gives the same table."""
    if not 0 <= shortest <= longest:
        raise ValueError("0 <= shortest <= longest is needed")

    def sequence(k: int) -> Column:
        named = lambda what: F.md5(F.concat_ws(":", F.lit(seed), F.lit(k), "pair_id", what))
        size = F.conv(F.substring(named(F.lit("size")), 1, 8), 16, 10).cast("long") % (longest - shortest + 1) + shortest
        blocks = F.transform(F.sequence(F.lit(0), F.lit(longest // 32)), named)
        return F.substring(F.translate(F.array_join(blocks, ""), "0123456789abcdef", "ACGTACGTACGTACGT"), F.lit(1), size.cast("int"))

    return spark.range(rows).withColumnRenamed("id", "pair_id").select("pair_id", *[sequence(k).alias(c) for k, c in enumerate(columns)])


def witnesses(spark: SparkSession, sequences: int = 2) -> DataFrame:
    """(pair_id, seq1, seq2[, seq3]) with negative numbers, so that they come before random rows."""
    rows = WITNESS_PAIRS if sequences == 2 else WITNESS_TRIPLES
    names = ", ".join(f"seq{k + 1} string" for k in range(sequences))
    return spark.createDataFrame([(k - len(rows), *row) for k, row in enumerate(rows)], f"pair_id long, {names}")


def witnesses_and_random(spark: SparkSession, rows: int, shortest: int, longest: int, seed: int = 0, sequences: int = 2) -> DataFrame:
    names = [f"seq{k + 1}" for k in range(sequences)]
    return witnesses(spark, sequences).unionByName(random_dna(spark, rows, shortest, longest, seed, names))


def random_alignment(pairs: DataFrame, seq1: str = "seq1", seq2: str = "seq2", walk: Column | int = 0) -> DataFrame:
    """Adds aligned1 and aligned2: a walk that at each step takes a letter of both, of the first or of the second sequence,
    chosen by a hash among the steps still possible, until both are used up. No column is all gaps."""
    n, m = F.length(seq1), F.length(seq2)
    walk = F.lit(walk) if isinstance(walk, int) else walk
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit("").alias("a"), F.lit("").alias("b"))

    def step(acc: Column, k: Column) -> Column:
        i, j = acc["i"], acc["j"]
        draw = F.pmod(F.xxhash64(seq1, seq2, walk, k), F.lit(3))
        both, first = (i < n) & (j < m), i < n
        kind = F.when(both, draw).when(first, 1).otherwise(2)  # 0: both, 1: the first alone, 2: the second alone
        done = (i >= n) & (j >= m)
        x = F.when(done, "").when(kind != 2, F.substring(F.col(seq1), i + 1, F.lit(1))).otherwise("-")
        y = F.when(done, "").when(kind != 1, F.substring(F.col(seq2), j + 1, F.lit(1))).otherwise("-")
        return F.struct((i + F.when(done | (kind == 2), 0).otherwise(1)).alias("i"), (j + F.when(done | (kind == 1), 0).otherwise(1)).alias("j"), F.concat(acc["a"], x).alias("a"), F.concat(acc["b"], y).alias("b"))

    walked = F.aggregate(F.sequence(F.lit(1), F.greatest(n + m, F.lit(1))), start, step)
    return pairs.withColumn("_walk", walked).withColumn("aligned1", F.col("_walk.a")).withColumn("aligned2", F.col("_walk.b")).drop("_walk")

"""Alignment as column functions: Arrow batches in, one struct or score a row out.

Scores alone are a function of their own: Spark prunes columns between operators, not inside a function, and the score
needs neither pointers nor strings.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import batch
from ..functions.batch import align_columns
from ..functions.config import DIMER3_FREE, DIMER_FREE, AlignConfig
from ..functions.dna import _col, complement, reverse_complement

ALIGNED_2D = "aligned1 string, aligned2 string, score double"
ALIGNED_3D = "aligned1 string, aligned2 string, aligned3 string, score double"


def _checked(config: AlignConfig | None, flags: int) -> AlignConfig:
    config = config or AlignConfig(free=(False,) * flags)
    if len(config.free) != flags:
        raise ValueError(f"this alignment needs {flags} free-end flags")
    return config


def nw_score(seq1, seq2, config: AlignConfig | None = None) -> Column:
    """The optimum alone. Null in, null out."""
    config = _checked(config, 4)

    @F.arrow_udf("double")
    def score(a: pa.Array, b: pa.Array) -> pa.Array:
        return align_columns([a, b], config, traceback=False)

    return score(_col(seq1), _col(seq2))


def nw_align(seq1, seq2, config: AlignConfig | None = None) -> Column:
    """struct<aligned1, aligned2, score>."""
    config = _checked(config, 4)

    @F.arrow_udf(ALIGNED_2D)
    def align(a: pa.Array, b: pa.Array) -> pa.Array:
        return align_columns([a, b], config, traceback=True)

    return align(_col(seq1), _col(seq2))


def nw3_score(seq1, seq2, seq3, config: AlignConfig | None = None) -> Column:
    config = _checked(config, 6)

    @F.arrow_udf("double")
    def score(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        return align_columns([a, b, c], config, traceback=False)

    return score(_col(seq1), _col(seq2), _col(seq3))


def nw3_align(seq1, seq2, seq3, config: AlignConfig | None = None) -> Column:
    """struct<aligned1, aligned2, aligned3, score>."""
    config = _checked(config, 6)

    @F.arrow_udf(ALIGNED_3D)
    def align(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        return align_columns([a, b, c], config, traceback=True)

    return align(_col(seq1), _col(seq2), _col(seq3))


def align_by(configs: list[AlignConfig], which, *seqs) -> Column:
    """The alignment of each row under configs[which]: a grid of settings in one function, rows of one setting together."""
    two = len(seqs) == 2

    def align(number: pa.Array, *columns: pa.Array) -> pa.Array:
        number = number.to_numpy(zero_copy_only=False)
        order = np.argsort(number, kind="stable")
        parts = []
        for rows in np.split(order, np.flatnonzero(np.diff(number[order])) + 1):
            if len(rows):
                parts.append(align_columns([c.take(pa.array(rows)) for c in columns], configs[number[rows[0]]], traceback=True))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return pa.concat_arrays(parts).take(pa.array(back)) if parts else pa.array([], batch.ALIGNED_2D if two else batch.ALIGNED_3D)

    if two:

        @F.arrow_udf(ALIGNED_2D)
        def run(number: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
            return align(number, a, b)

    else:

        @F.arrow_udf(ALIGNED_3D)
        def run(number: pa.Array, a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
            return align(number, a, b, c)

    return run(_col(which), *map(_col, seqs))


def dimer_score(primer1, primer2, config: AlignConfig | None = None) -> Column:
    """The score of predict_dimer."""
    return nw_score(primer1, reverse_complement(primer2), (config or AlignConfig()).but(free=DIMER_FREE, gap_close=True))


def predict_dimer(df: DataFrame, primer1: str, primer2: str, config: AlignConfig | None = None, into: str = "dimer") -> DataFrame:
    """Adds struct `into`: the second primer is aligned reverse-complemented, its row then complemented back, so that the
    bottom strand reads 3' to 5'. The gap-close penalty is always on."""
    config = (config or AlignConfig()).but(free=DIMER_FREE, gap_close=True)
    found = df.withColumn(into, nw_align(primer1, reverse_complement(primer2), config))
    return found.withColumn(into, F.col(into).withField("aligned2", complement(F.col(into)["aligned2"])))


def align_dimer(df: DataFrame, dimer: str, primer1: str, primer2: str, config: AlignConfig | None = None, into: str = "dimer3") -> DataFrame:
    """Adds struct `into`: dimer against the first primer and the reverse complement of the second, whose row is complemented back."""
    config = (config or AlignConfig(free=DIMER3_FREE)).but(free=DIMER3_FREE, gap_close=True)
    found = df.withColumn(into, nw3_align(dimer, primer1, reverse_complement(primer2), config))
    return found.withColumn(into, F.col(into).withField("aligned3", complement(F.col(into)["aligned3"])))


def register(spark, config: AlignConfig | None = None) -> None:
    """SQL names nw_align, nw_score, nw_align3, nw_score3, revcomp for one configuration of two sequences (its costs and matrix serve three)."""
    two = _checked(config, 4)
    three = two.but(free=(False,) * 6, scaler=None)

    def udf(kind, sequences, own, traceback):
        if sequences == 2:

            @F.arrow_udf(kind)
            def run(a: pa.Array, b: pa.Array) -> pa.Array:
                return align_columns([a, b], own, traceback)

        else:

            @F.arrow_udf(kind)
            def run(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
                return align_columns([a, b, c], own, traceback)

        return run

    for name, kind, sequences, own, traceback in (
        ("nw_score", "double", 2, two, False),
        ("nw_align", ALIGNED_2D, 2, two, True),
        ("nw_score3", "double", 3, three, False),
        ("nw_align3", ALIGNED_3D, 3, three, True),
    ):
        spark.udf.register(name, udf(kind, sequences, own, traceback))
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION revcomp(s STRING) RETURNS STRING RETURN reverse(translate(s, 'ACGTacgt', 'TGCAtgca'))")

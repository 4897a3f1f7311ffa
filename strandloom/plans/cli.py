"""Sweeps from the command line: python -m strandloom.plans.cli COMMAND ...; exit code 1 if something that must hold fails.

symmetry     swap, reversal and complement invariance over the whole grid (two or three sequences)
rescoring    the optimum against its rescored alignment, all free-end flags
dimer-swap   dimer scores in both orders, by alignment or, with --walks, by rescoring random alignments
series       speedups, tail speedups and scaling exponents of a benchmark CSV
"""

from __future__ import annotations

import argparse
import sys
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.config import INVERSE_DISTANCE, AlignConfig, flags_of
from ..sources.generated import random_alignment, random_dna, witnesses_and_random
from ..sources.series import read_series, write_sweep
from . import speedup, sweep


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = top.add_subparsers(dest="command", required=True)

    def cases(name: str, rows: int, shortest: int, longest: int) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        p.add_argument("--rows", type=int, default=rows, help="random pairs or triples")
        p.add_argument("--min-len", type=int, default=shortest)
        p.add_argument("--max-len", type=int, default=longest)
        p.add_argument("--seed", type=int, default=0)
        p.add_argument("--flags", help="one flag string such as 0110; default all")
        p.add_argument("--failures", type=int, default=5, help="failures printed a group")
        return p

    p = cases("symmetry", 40, 8, 32)
    p.add_argument("--sequences", type=int, choices=(2, 3), default=2)
    p.add_argument("--csv-out", help="folder for the rows as CSV")
    p = cases("rescoring", 200, 8, 32)
    p.add_argument("--sequences", type=int, choices=(2, 3), default=2)
    p.add_argument("--unscaled", action="store_true")
    p = cases("dimer-swap", 100, 8, 32)
    p.add_argument("--walks", type=int, default=0, help="random alignments a pair, rescored instead of aligned")
    p = commands.add_parser("series")
    p.add_argument("csv")
    return top


def _flags(own: argparse.Namespace, sequences: int) -> list[tuple[bool, ...]]:
    return [flags_of(own.flags)] if own.flags else list(product((False, True), repeat=2 * sequences))


def _passes(rows: DataFrame, own: argparse.Namespace) -> bool:
    """Prints passes by flags and the first failures; whether all passed."""
    rows = rows.cache()
    passes = sweep.passes_by_flags(rows)
    passes.orderBy("flags").show(64, truncate=False)
    sweep.fully_passing(passes).show()
    sweep.printed_failures(rows, "ok", ["flags"], own.failures).show(truncate=False)
    return rows.filter("not ok").limit(1).count() == 0


def run(spark: SparkSession, arguments: list[str]) -> bool:
    own = parser().parse_args(arguments)
    if own.command == "series":
        series = read_series(spark, own.csv)
        speedup.speedup_summary(series).show(truncate=False)
        speedup.scaling(series).orderBy("dimension", "backend").show(truncate=False)
        return True
    if own.command == "symmetry":
        cases = witnesses_and_random(spark, own.rows, own.min_len, own.max_len, own.seed, own.sequences)
        grid = sweep.grid(own.sequences, flags=_flags(own, own.sequences))
        rows = sweep.condition_rows(sweep.symmetry_cases(cases, grid), "pairs_total" if own.sequences == 2 else "triples_total").cache()
        sweep.by_symmetry(rows).orderBy("symmetry").show(truncate=False)
        rows.filter("expected_score_invariant and score_pass = 0").orderBy("symmetry", "flags").show(own.failures, truncate=False)
        if own.csv_out:
            write_sweep(rows.drop("first_failure"), own.csv_out)
        return sweep.sweep_passes(rows)
    names = ["seq1", "seq2", "seq3"][: getattr(own, "sequences", 2)]
    cases = random_dna(spark, own.rows, own.min_len, own.max_len, own.seed, names)
    if own.command == "rescoring":
        scaler = None if own.unscaled or own.sequences == 3 else INVERSE_DISTANCE
        return _passes(sweep.rescoring_cases(cases, [AlignConfig(free=f, scaler=scaler) for f in _flags(own, own.sequences)]), own)
    if own.walks:
        walks = random_alignment(cases.withColumn("walk", F.explode(F.sequence(F.lit(1), F.lit(own.walks)))), walk=F.col("walk"))
        parts = [sweep.alignment_swap_cases(walks, AlignConfig(free=f, scaler=None)).withColumn("flags", F.lit("".join("01"[x] for x in f))) for f in _flags(own, 2)]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        return _passes(rows, own)
    return _passes(sweep.dimer_swap_cases(cases, [AlignConfig(free=f, scaler=None) for f in _flags(own, 2)]), own)


def main() -> int:
    spark = SparkSession.builder.appName("strandloom").getOrCreate()
    return 0 if run(spark, sys.argv[1:]) else 1


if __name__ == "__main__":
    sys.exit(main())

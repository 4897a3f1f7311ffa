"""Parameter sweeps that test symmetry and consistency over grids of configurations, reduced by group."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.config import COMP_SYMMETRIC, INVERSE_DISTANCE, NON_COMP_SYMMETRIC, AlignConfig, ScoreMatrix, flag_string
from ..functions.dna import SYMMETRIES_2D, SYMMETRIES_3D, complement, dimer_swapped, expected_invariance, restored, transformed
from ..operators.align import align_by
from ..operators.rescore import score_alignment, score_alignment_3d

TOLERANCE = 1e-9
MATRICES = {"comp_symmetric": COMP_SYMMETRIC, "non_comp_symmetric": NON_COMP_SYMMETRIC}


def matrix_predicates(scores: DataFrame) -> DataFrame:
    """matrix, transpose_symmetric, complement_symmetric of the relation (matrix, x, y, s): two self-joins and bool_and."""
    other = lambda name: scores.select("matrix", F.col("x").alias("x_" + name), F.col("y").alias("y_" + name), F.col("s").alias("s_" + name))
    swapped = other("t").withColumnsRenamed({"x_t": "y", "y_t": "x"})
    paired = other("c").withColumns({"x": complement("x_c"), "y": complement("y_c")}).drop("x_c", "y_c")
    both = scores.join(swapped, ["matrix", "x", "y"]).join(paired, ["matrix", "x", "y"])
    return both.groupBy("matrix").agg(F.bool_and(F.col("s") == F.col("s_t")).alias("transpose_symmetric"), F.bool_and(F.col("s") == F.col("s_c")).alias("complement_symmetric"))


@dataclass(frozen=True)
class Condition:
    """One row of a grid but for the symmetry."""

    matrix: str
    scaled: bool
    affine: bool
    close: bool
    free: tuple[bool, ...]

    def config(self, matrices: dict[str, ScoreMatrix], gap_open: float = -5.0, gap_extend: float = -1.0) -> AlignConfig:
        return AlignConfig(matrices[self.matrix], gap_open if self.affine else gap_extend, gap_extend, self.close, self.free, INVERSE_DISTANCE if self.scaled else None)


def grid(sequences: int = 2, matrices: Iterable[str] = tuple(MATRICES), flags: Iterable[tuple[bool, ...]] | None = None) -> list[Condition]:
    """All conditions: 2 matrices x scaled or not (two sequences only) x gap kinds x close or not x all free-end flags."""
    flags = list(product((False, True), repeat=2 * sequences)) if flags is None else list(flags)
    scaled = (False, True) if sequences == 2 else (False,)
    return [Condition(*c) for c in product(matrices, scaled, (False, True), (False, True), flags)]


def close_to(x: Column, y: Column) -> Column:
    return F.abs(x - y) <= TOLERANCE


def symmetry_cases(cases: DataFrame, conditions: Sequence[Condition], matrices: dict[str, ScoreMatrix] | None = None, symmetries: Sequence[str] | None = None) -> DataFrame:
    """A row for each condition, symmetry and case (pair_id, seq1, seq2[, seq3]): score_ok, alignment_ok, and both scores.

    The grid is a small table that goes to the cases; the base problem is aligned once a condition, whatever the number
    of symmetries, and each batch aligns its rows of one setting together."""
    matrices = matrices or MATRICES
    sequences = len(conditions[0].free) // 2
    symmetries = symmetries or (SYMMETRIES_2D if sequences == 2 else SYMMETRIES_3D)
    names = [f"seq{k + 1}" for k in range(sequences)]
    configs: list[AlignConfig] = []
    rows = []
    for condition in conditions:
        base = condition.config(matrices)
        first = len(configs)
        configs.append(base)
        moved = []
        for symmetry in symmetries:
            configs.append(transformed(symmetry, names, base)[1])
            moved.append((symmetry, len(configs) - 1))
        rows.append((condition.matrix, int(condition.scaled), int(condition.affine), int(condition.close), flag_string(condition.free), first, moved, matrices[condition.matrix].transpose_symmetric(), matrices[condition.matrix].complement_symmetric()))
    spark = cases.sparkSession
    table = spark.createDataFrame(rows, "matrix string, scaled int, affine_gap int, gap_close_penalty int, flags string, base_no int, moved array<struct<symmetry:string,no:int>>, by_transpose boolean, by_complement boolean")
    spread = cases.repartition(spark.sparkContext.defaultParallelism, "pair_id")
    base = spread.crossJoin(F.broadcast(table)).withColumn("base", align_by(configs, "base_no", *names))
    each = base.withColumn("m", F.explode("moved")).withColumns({"symmetry": F.col("m.symmetry"), "no": F.col("m.no")})
    for k in range(sequences):
        choice = None
        for symmetry in symmetries:
            value = transformed(symmetry, names, configs[0])[0][k]
            choice = F.when(F.col("symmetry") == symmetry, value) if choice is None else choice.when(F.col("symmetry") == symmetry, value)
        each = each.withColumn(f"moved{k + 1}", choice)
    found = each.withColumn("found", align_by(configs, "no", *[f"moved{k + 1}" for k in range(sequences)]))
    back = None
    for symmetry in symmetries:
        same = F.lit(True)
        for k, s in enumerate(restored(symmetry, [F.col("found")[f"aligned{k + 1}"] for k in range(sequences)])):
            same = same & (s == F.col("base")[f"aligned{k + 1}"])
        back = F.when(F.col("symmetry") == symmetry, same) if back is None else back.when(F.col("symmetry") == symmetry, same)
    keys = ["matrix", "scaled", "affine_gap", "gap_close_penalty", "flags"] if sequences == 2 else ["matrix", "affine_gap", "gap_close_penalty", "flags"]
    expected = expected_invariance("symmetry", F.col("by_transpose"), F.col("by_complement"), sequences)
    one, two = F.col("base")["score"], F.col("found")["score"]
    return found.select(*keys, "symmetry", "pair_id", one.alias("base_score"), two.alias("moved_score"), close_to(one, two).alias("score_ok"), back.alias("alignment_ok"), expected.alias("expected_score_invariant"))


def condition_rows(cases: DataFrame, total: str = "pairs_total") -> DataFrame:
    """One row for each condition and symmetry: totals, failures, pass flags, and the first failing case."""
    keys = [c for c in cases.columns if c in ("matrix", "scaled", "affine_gap", "gap_close_penalty", "flags", "symmetry")]
    failing = lambda ok: F.count_if(~F.col(ok)).alias(ok.replace("_ok", "_failures"))
    first = F.min(F.when(~F.col("score_ok"), F.struct("pair_id", "base_score", "moved_score"))).alias("first_failure")
    rows = cases.groupBy(*keys).agg(F.count("*").alias(total), failing("score_ok"), F.bool_and("score_ok").cast("int").alias("score_pass"), failing("alignment_ok"), F.bool_and("alignment_ok").cast("int").alias("alignment_pass"), F.first("expected_score_invariant").alias("expected_score_invariant"), first)
    return rows


def by_symmetry(rows: DataFrame) -> DataFrame:
    """Counters for each symmetry and, with symmetry null, for all: rows, full passes, and rows by what was expected."""
    expected = F.col("expected_score_invariant")
    passed = F.col("score_pass") == 1
    return rows.rollup("symmetry").agg(
        F.count("*").alias("n_rows"),
        F.count_if(passed).alias("full_pass_rows"),
        F.count_if(expected.isNotNull()).alias("expected_known"),
        F.count_if(expected).alias("expected_true"),
        F.count_if(expected & ~passed).alias("expected_true_failures"),
        F.count_if(expected.isNull()).alias("expected_unknown"),
        F.count_if(expected.isNull() & ~passed).alias("expected_unknown_failures"),
    )


def sweep_passes(rows: DataFrame) -> bool:
    """Whether no row that must pass fails."""
    return rows.filter(F.col("expected_score_invariant") & (F.col("score_pass") == 0)).limit(1).count() == 0


def printed_failures(cases: DataFrame, ok: str, keys: Sequence[str], most: int = 5) -> DataFrame:
    """At most `most` failing cases of each group, smallest pair_id first."""
    order = Window.partitionBy(*keys).orderBy("pair_id")
    return cases.filter(~F.col(ok)).withColumn("failure_no", F.row_number().over(order)).filter(F.col("failure_no") <= most)


def _by_costs(configs: Sequence[AlignConfig]) -> list[list[AlignConfig]]:
    """Configurations that differ in nothing but their free ends, together."""
    groups: dict[tuple, list[AlignConfig]] = {}
    for c in configs:
        groups.setdefault((id(c.matrix), c.gap_open, c.gap_extend, c.gap_close, id(c.scaler), len(c.free)), []).append(c)
    return list(groups.values())


def _spread(cases: DataFrame, configs: Sequence[AlignConfig]) -> DataFrame:
    """Every case with every configuration's number (no) and flags (flags, and free0.. one by one): a small table that goes to the cases."""
    ends = [f"free{k}" for k in range(len(configs[0].free))]
    rows = [(k, flag_string(c.free), *c.free) for k, c in enumerate(configs)]
    spark = cases.sparkSession
    table = spark.createDataFrame(rows, "no int, flags string, " + ", ".join(f"{e} boolean" for e in ends))
    return cases.repartition(spark.sparkContext.defaultParallelism, "pair_id").crossJoin(F.broadcast(table))


def _together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def rescoring_cases(cases: DataFrame, configs: Sequence[AlignConfig]) -> DataFrame:
    """The optimum against the rescored alignment, for each configuration: flags, pair_id, score, rescored, ok. One pass for
    all configurations that differ in their free ends alone."""
    parts = []
    for own in _by_costs(configs):
        three = len(own[0].free) == 6
        names = [f"seq{k + 1}" for k in range(3 if three else 2)]
        found = _spread(cases, own).withColumn("r", align_by(own, "no", *names))
        strings = [F.col("r")[f"aligned{k + 1}"] for k in range(len(names))]
        again = (score_alignment_3d if three else score_alignment)(*strings, own[0], [F.col(f"free{k}") for k in range(len(own[0].free))])
        parts.append(found.select("flags", "pair_id", F.col("r")["score"].alias("score"), again.alias("rescored")))
    return _together(parts).withColumn("ok", close_to(F.col("score"), F.col("rescored")))


def dimer_swap_cases(cases: DataFrame, configs: Sequence[AlignConfig]) -> DataFrame:
    """score(p1, rc p2) against score(p2, rc p1) with flags read backwards; seq2 is the second sequence as aligned."""
    one, two, _ = dimer_swapped("seq1", "seq2", configs[0])
    parts = []
    for own in _by_costs(configs):
        changed = [dimer_swapped("seq1", "seq2", c)[2] for c in own]
        found = _spread(cases, own).withColumn("first", align_by(own, "no", "seq1", "seq2")).withColumn("second", align_by(changed, "no", one, two))
        parts.append(found.select("flags", "pair_id", F.col("first")["score"].alias("score"), F.col("second")["score"].alias("swapped")))
    return _together(parts).withColumn("ok", close_to(F.col("score"), F.col("swapped")))


def alignment_swap_cases(aligned: DataFrame, config: AlignConfig) -> DataFrame:
    """The same without any alignment search: given alignments (pair_id, aligned1, aligned2) are rescored in both orders."""
    one, two, changed = dimer_swapped("aligned1", "aligned2", config)
    rows = aligned.select("pair_id", score_alignment("aligned1", "aligned2", config).alias("score"), score_alignment(one, two, changed).alias("swapped"))
    return rows.withColumn("ok", close_to(F.col("score"), F.col("swapped")))


def passes_by_flags(cases: DataFrame) -> DataFrame:
    return cases.groupBy("flags").agg(F.count_if("ok").alias("passed"), F.count("*").alias("total"))


def fully_passing(passes: DataFrame) -> DataFrame:
    return passes.agg(F.count_if(F.col("passed") == F.col("total")).alias("passing_flags"), F.count("*").alias("all_flags"))

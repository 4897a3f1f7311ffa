"""All-against-all primer screens: pairs, best partners, and rewrites that save alignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.config import AlignConfig
from .align import dimer_score, nw_score

BROADCAST_BYTES = 64 << 20
PAIRS_A_TASK = 1_000_000


def _size(primers: DataFrame, columns: list[str]) -> tuple[int, int]:
    """Rows, and about how many bytes they take."""
    each = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in columns), F.lit(64))
    found = primers.agg(F.count("*").alias("n"), F.sum(each.cast("long")).alias("bytes")).first()
    return found["n"], found["bytes"] or 0


def all_pairs(first: DataFrame, second: DataFrame, *, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(i1, name1, seq1, i2, name2, seq2) of two primer sets (i, name, seq). The order is that of (i1, i2), by orderBy where it matters.

    A second set of at most broadcast_bytes goes to the first one's partitions; a larger one is paired partition by
    partition. The result has all pairs either way: that is what a screen computes."""
    one = first.select(*[F.col(c).alias(c + "1") for c in ("i", "name", "seq")])
    two = second.select(*[F.col(c).alias(c + "2") for c in ("i", "name", "seq")])
    if _size(second, ["name", "seq"])[1] <= broadcast_bytes:
        two = F.broadcast(two)
    return one.crossJoin(two)


def key_pairs(first: DataFrame, second: DataFrame, *, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(k1, seq1, k2, seq2) of two sets (k, seq), spread for the alignment that follows: few rows cost much time, so every
    core gets some, and no task more than about PAIRS_A_TASK pairs."""
    one = first.select(F.col("k").alias("k1"), F.col("seq").alias("seq1"))
    two = second.select(F.col("k").alias("k2"), F.col("seq").alias("seq2"))
    rows, size = _size(second, ["seq"])
    if size <= broadcast_bytes:
        two = F.broadcast(two)
    tasks = max(first.sparkSession.sparkContext.defaultParallelism, -(-first.count() * rows // PAIRS_A_TASK))
    return one.repartition(tasks, "k1").crossJoin(two)


def best_partner(scored: DataFrame, by: str, partner: str, score: str, *carry: str) -> DataFrame:
    """Each `by` with its highest score (ties to the smaller partner): one partial aggregate, no sort."""
    best = F.max_by(F.struct(partner, score, *carry), F.struct(F.col(score), -F.col(partner)))
    return scored.groupBy(by).agg(best.alias("b")).select(by, "b.*")


def ranked_partners(scored: DataFrame, by: str, partner: str, score: str, k: int | None = None) -> DataFrame:
    """rank within each `by`, best first; k of them if given (Spark then keeps k a group before the shuffle)."""
    order = Window.partitionBy(by).orderBy(F.col(score).desc(), partner)
    ranked = scored.withColumn("rank", F.row_number().over(order))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def top_pairs(scored: DataFrame, score: str, ties: list[str], k: int) -> DataFrame:
    return scored.orderBy(F.col(score).desc(), *ties).limit(k)


def distinct_scores(pairs: DataFrame, config: AlignConfig, seq1: str = "seq1", seq2: str = "seq2", into: str = "score") -> DataFrame:
    """Scores each different pair of sequences once and joins back."""
    once = pairs.select(seq1, seq2).distinct().withColumn(into, nw_score(seq1, seq2, config))
    return pairs.join(once, [seq1, seq2])


def self_screen(primers: DataFrame, config: AlignConfig | None = None) -> DataFrame:
    """Dimer scores (k1, k2, score) of a set (k, seq) with itself. With a transpose- and complement-symmetric matrix
    the two orders of a pair score alike, so one is aligned and both are returned (scores only: strings may differ on ties)."""
    config = config or AlignConfig()
    pairs = key_pairs(primers, primers)
    if not (config.matrix.transpose_symmetric() and config.matrix.complement_symmetric()):
        return pairs.select("k1", "k2", dimer_score("seq1", "seq2", config).alias("score"))
    half = pairs.filter("k1 <= k2").select("k1", "k2", dimer_score("seq1", "seq2", config).alias("score"))
    both = F.when(F.col("k1") == F.col("k2"), F.array(F.struct("k1", "k2"))).otherwise(F.array(F.struct("k1", "k2"), F.struct(F.col("k2").alias("k1"), F.col("k1").alias("k2"))))
    return half.select(F.explode(both).alias("p"), "score").select("p.*", "score")


def score_bound(seq1, seq2, config: AlignConfig) -> Column:
    """No unscaled alignment scores more: the best substitution for each letter of the shorter sequence, if costs are costs."""
    if config.scaler is not None and any(config.free[:4]):
        raise ValueError("the bound holds for unscaled scores")
    if config.gap_open > 0 or config.gap_extend > 0:
        raise ValueError("the bound holds if gaps cost")
    most = max(0.0, *(s for *_, s in config.matrix.rows()))
    return F.least(F.length(seq1), F.length(seq2)) * F.lit(most)


def pairs_reaching(pairs: DataFrame, config: AlignConfig, least: float, seq1: str = "seq1", seq2: str = "seq2") -> DataFrame:
    """The pairs that score `least` or more: those whose bound is lower are never aligned."""
    possible = pairs.filter(score_bound(seq1, seq2, config) >= least)
    return possible.withColumn("score", nw_score(seq1, seq2, config)).filter(F.col("score") >= least)

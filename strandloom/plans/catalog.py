"""Registered queries over the test tables, and their SQL.

The tables hold no DNA, so primers come from keys by a rule that both engines share; primer sets are whole tables, and
screens pair whole tables (supplier x nation). Engines behind the connectors are stand-ins: no service or program is at hand.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import diagrams, dna, render, thermo
from ..functions.config import COMP_SYMMETRIC, DIMER3_FREE, DIMER_FREE, DIRECTIONAL, NON_COMP_SYMMETRIC, AlignConfig, Scaler, flag_string, flags_of
from ..functions.text import format_event
from ..operators import align, rescore, screen
from ..sources import connectors
from ..sources.generated import WITNESS_PAIRS, random_alignment, random_dna, table_primers, witnesses
from ..streaming.dimers import calls_in_period
from . import oracles as sql
from . import speedup, sweep

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if oracle:
            ORACLES[name or f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(c: str | Column, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


# Relations ----------------------------------------------------------------------------------------------------------

FWD_SQL, REV_SQL = sql.primers("supplier", "s_suppkey", "s"), sql.primers("nation", "n_nationkey", "n")
PAIRS_SQL = f"SELECT a.k AS k1, b.k AS k2, a.seq AS seq1, b.seq AS seq2 FROM ({FWD_SQL}) a CROSS JOIN ({REV_SQL}) b"
DIMER_SQL = PAIRS_SQL.replace("b.seq AS seq2", f"{sql.reverse_complement('b.seq')} AS seq2")


def forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_primers(spark, sf_dir, "supplier", "s_suppkey", "s")


def reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_primers(spark, sf_dir, "nation", "n_nationkey", "n")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screen.key_pairs(forward(spark, sf_dir), reverse(spark, sf_dir))


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Witness pairs, and all pairs of the region table's primers."""
    some = table_primers(spark, sf_dir, "region", "r_regionkey", "r")
    both = screen.key_pairs(some, some).select((F.col("k1") * 1000 + F.col("k2")).alias("pair_id"), "seq1", "seq2")
    return witnesses(spark).unionByName(both)


def gapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k1, k2, aligned1, aligned2: a gap of two within the first sequence, the second moved right, both filled up with gaps."""
    p = pairs(spark, sf_dir)
    one = F.concat(F.substring("seq1", 1, 8), F.lit("--"), F.expr("substr(seq1, 9)"))
    two = F.concat(F.repeat(F.lit("-"), (F.col("k2") % 5).cast("int")), F.col("seq2"))
    size = F.greatest(F.length("one"), F.length("two"))
    return p.withColumns({"one": one, "two": two}).select("k1", "k2", F.rpad("one", size, F.lit("-")).alias("aligned1"), F.rpad("two", size, F.lit("-")).alias("aligned2"))


GAPPED_SQL = f"""SELECT k1, k2, rpad(one, greatest(length(one), length(two))::INT, '-') AS aligned1, rpad(two, greatest(length(one), length(two))::INT, '-') AS aligned2
FROM (SELECT *, substr(seq1, 1, 8) || '--' || substr(seq1, 9) AS one, repeat('-', (k2 % 5)::INT) || seq2 AS two FROM ({PAIRS_SQL}))"""

# Sequences ----------------------------------------------------------------------------------------------------------


@query(f"SELECT k, seq, {sql.complement('seq')} AS complement, {sql.reverse_complement('seq')} AS reverse_complement, length(seq)::INT AS length FROM ({sql.primers('part', 'p_partkey', 'p')})")
def primer_set(spark, sf_dir):
    p = table_primers(spark, sf_dir, "part", "p_partkey", "p")
    return p.select("k", "seq", dna.complement("seq").alias("complement"), dna.reverse_complement("seq").alias("reverse_complement"), F.length("seq").cast("int").alias("length"))


@query("SELECT c_custkey AS k, upper(replace(c_name, ' ', '')) || upper(replace(c_mktsegment, ' ', '')) AS seq FROM customer")
def primers_normalised(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    messy = F.concat(F.lit(" \t "), F.lower("c_name"), F.lit("  "), F.lower("c_mktsegment"), F.lit(" \n"))
    return c.select(F.col("c_custkey").alias("k"), dna.normalise(messy).alias("seq"))


@query("SELECT doc_id, length(s)::INT AS length, md5(s) AS digest FROM (SELECT doc_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS s FROM documents)")
def document_sequences(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("s"))
    return d.select("doc_id", F.length("s").alias("length"), F.md5(F.col("s").cast("binary")).alias("digest"))


_TWICE = " AND ".join(f"reverse(reverse({x})) = {x} AND {sql.complement(sql.complement(x))} = {x}" for x in ("seq1", "seq2"))


@query(f"SELECT k1, k2, seq2 AS swapped1, seq1 AS swapped2, reverse(seq1) AS reversed1, {sql.complement('seq1')} AS complemented1, {_TWICE} AS restored FROM ({PAIRS_SQL})")
def input_transforms(spark, sf_dir):
    p, c = pairs(spark, sf_dir), AlignConfig(free=DIMER_FREE)
    moved = {s: dna.transformed(s, ["seq1", "seq2"], c)[0] for s in dna.SYMMETRIES_2D}
    same = F.lit(True)
    for s, seqs in moved.items():
        back = dna.restored(s, seqs)
        same = same & (back[0] == F.col("seq1")) & (back[1] == F.col("seq2"))
    return p.select("k1", "k2", moved["swap"][0].alias("swapped1"), moved["swap"][1].alias("swapped2"), moved["reverse"][0].alias("reversed1"), moved["complement"][0].alias("complemented1"), same.alias("restored"))


@query("SELECT k, name, seq FROM (SELECT 'w' AS name, unnest(range(5)) AS k, unnest(['A', 'A', 'T', 'AC', 'AGTC']) AS seq) UNION ALL SELECT k, 'p' AS name, seq FROM (" + sql.primers("part", "p_partkey", "p") + ")")
def witness_union(spark, sf_dir):
    w = witnesses(spark).select((F.col("pair_id") + 5).alias("k"), F.lit("w").alias("name"), F.col("seq1").alias("seq"))
    return w.unionByName(table_primers(spark, sf_dir, "part", "p_partkey", "p").select("k", F.lit("p").alias("name"), "seq"))


@query(f"SELECT k1, k2, seq1, seq2 FROM ({PAIRS_SQL}) ORDER BY k1, k2")
def all_pairs(spark, sf_dir):
    return pairs(spark, sf_dir).orderBy("k1", "k2")


# Alignment ----------------------------------------------------------------------------------------------------------

PLAIN = AlignConfig(scaler=None)
SCORES = {
    "nw_score_global": PLAIN,
    "nw_score_dimer_flags": PLAIN.but(free=DIMER_FREE),
    "nw_score_all_free": PLAIN.but(free=(True,) * 4),
    "nw_score_no_close": PLAIN.but(free=(True, False, False, True), gap_close=False),
    "nw_score_scaled": AlignConfig(free=DIMER_FREE),
    "nw_score_custom_scaler": AlignConfig(COMP_SYMMETRIC, -5.25, -1.1, True, (True, True, False, True), Scaler(1.25, 0.9)),
    "nw_score_directional": PLAIN.but(matrix=DIRECTIONAL, free=(False, True, False, False)),
    "nw_score_linear_gap": PLAIN.but(matrix=NON_COMP_SYMMETRIC, gap_open=-1.0),
}
for _name, _config in SCORES.items():
    query(f"SELECT k1, k2, round(score, 6) + 0.0 AS score FROM ({sql.aligned(PAIRS_SQL, _config)})", _name)(
        lambda spark, sf_dir, c=_config: pairs(spark, sf_dir).select("k1", "k2", rounded(align.nw_score("seq1", "seq2", c)).alias("score"))
    )

for _name, _config in {"nw_align_dimer_flags": PLAIN.but(free=DIMER_FREE), "nw_align_global": PLAIN, "nw_align_no_close": PLAIN.but(gap_close=False, free=(True, True, False, False))}.items():
    query(f"SELECT k1, k2, aligned1, aligned2, score FROM ({sql.aligned(PAIRS_SQL, _config, True)})", _name)(
        lambda spark, sf_dir, c=_config: pairs(spark, sf_dir).select("k1", "k2", align.nw_align("seq1", "seq2", c).alias("r")).select("k1", "k2", "r.*")
    )

for _name, _config in {"nw_align_scaled": AlignConfig(free=DIMER_FREE), "nw_align_custom_scaler": SCORES["nw_score_custom_scaler"]}.items():
    query(f"SELECT k1, k2, aligned1, aligned2, round(score, 6) + 0.0 AS score FROM ({sql.aligned(PAIRS_SQL, _config, True)})", _name)(
        lambda spark, sf_dir, c=_config: pairs(spark, sf_dir).select("k1", "k2", align.nw_align("seq1", "seq2", c).alias("r")).select("k1", "k2", "r.aligned1", "r.aligned2", rounded("r.score").alias("score"))
    )

PLAIN_DIMER = PLAIN.but(free=DIMER_FREE)


@query(f"SELECT k1, k2, aligned1, {sql.complement('aligned2')} AS aligned2, round(score, 6) + 0.0 AS score FROM ({sql.aligned(DIMER_SQL, AlignConfig(free=DIMER_FREE), True)})")
def predict_dimer_scaled(spark, sf_dir):
    found = align.predict_dimer(pairs(spark, sf_dir), "seq1", "seq2")
    return found.select("k1", "k2", "dimer.aligned1", "dimer.aligned2", rounded("dimer.score").alias("score"))


@query(f"SELECT k1, k2, aligned1, {sql.complement('aligned2')} AS aligned2, score FROM ({sql.aligned(DIMER_SQL, PLAIN_DIMER, True)})")
def predict_dimer(spark, sf_dir):
    return align.predict_dimer(pairs(spark, sf_dir), "seq1", "seq2", PLAIN).select("k1", "k2", "dimer.*")


DIMER_SCORES = f"SELECT k1, k2, round(score, 6) + 0.0 AS score FROM ({sql.aligned(DIMER_SQL, AlignConfig(free=DIMER_FREE))})"


def dimer_scores(spark, sf_dir):
    return pairs(spark, sf_dir).select("k1", "k2", rounded(align.dimer_score("seq1", "seq2")).alias("score"))


@query(f"SELECT k1, k2, score FROM (SELECT *, row_number() OVER (PARTITION BY k1 ORDER BY score DESC, k2) AS r FROM ({DIMER_SCORES})) WHERE r = 1")
def best_partner(spark, sf_dir):
    return screen.best_partner(dimer_scores(spark, sf_dir), "k1", "k2", "score")


@query(f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k1 ORDER BY score DESC, k2)::INT AS rank FROM ({DIMER_SCORES})) WHERE rank <= 3")
def rank_per_primer(spark, sf_dir):
    return screen.ranked_partners(dimer_scores(spark, sf_dir), "k1", "k2", "score", 3)


@query(f"SELECT * FROM ({DIMER_SCORES}) ORDER BY score DESC, k1, k2 LIMIT 20")
def top_k_dimers(spark, sf_dir):
    return screen.top_pairs(dimer_scores(spark, sf_dir), "score", ["k1", "k2"], 20)


_SELF = DIMER_SQL.replace(FWD_SQL, REV_SQL)


@query(f"SELECT k1, k2, round(score, 6) + 0.0 AS score FROM ({sql.aligned(_SELF, AlignConfig(free=DIMER_FREE))})")
def self_screen(spark, sf_dir):
    return screen.self_screen(reverse(spark, sf_dir)).select("k1", "k2", rounded("score").alias("score"))


@query(f"SELECT k1, k2, score FROM ({sql.aligned(PAIRS_SQL, PLAIN_DIMER)}) WHERE score >= 8")
def pairs_reaching(spark, sf_dir):
    return screen.pairs_reaching(pairs(spark, sf_dir), PLAIN_DIMER, 8).select("k1", "k2", "score")




@query(f"SELECT k1, count(*) AS pairs, sum(score) AS total FROM ({sql.aligned(PAIRS_SQL, PLAIN_DIMER)}) GROUP BY k1")
def distinct_scores(spark, sf_dir):
    scored = screen.distinct_scores(pairs(spark, sf_dir), PLAIN_DIMER)
    return scored.groupBy("k1").agg(F.count("*").alias("pairs"), F.sum("score").alias("total"))


def triples(spark, sf_dir):
    """All triples of short primers from the region table."""
    some = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("k")).select("k", dna.hashed_primer("t", "k", 5, 6).alias("seq"))
    parts = [some.select(F.col("k").alias(f"k{s}"), F.col("seq").alias(f"seq{s}")) for s in (1, 2, 3)]
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2]).repartition(spark.sparkContext.defaultParallelism, "k1", "k2", "k3")


THREE = AlignConfig(free=(False, True, True, False, False, False), scaler=None)


_SHORT_SQL = "SELECT r_regionkey::BIGINT AS k, substr(translate(md5(concat('t', r_regionkey)), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, (5 + r_regionkey % 6)::INT) AS seq FROM region"
TRIPLES_SQL = f"SELECT a.k AS k1, b.k AS k2, c.k AS k3, a.seq AS seq1, b.seq AS seq2, c.seq AS seq3 FROM ({_SHORT_SQL}) a CROSS JOIN ({_SHORT_SQL}) b CROSS JOIN ({_SHORT_SQL}) c"


@query(f"SELECT k1, k2, k3, score FROM ({sql.aligned3(TRIPLES_SQL, THREE)})")
def nw3_score(spark, sf_dir):
    return triples(spark, sf_dir).select("k1", "k2", "k3", align.nw3_score("seq1", "seq2", "seq3", THREE).alias("score"))


def long_triples(spark, sf_dir):
    """A triple of whole primers for every supplier: its own, that of a nation, and the two joined as a dimer would."""
    s, n = forward(spark, sf_dir), reverse(spark, sf_dir)
    other = n.select(F.col("k").alias("k2"), F.col("seq").alias("seq2"))
    both = s.select(F.col("k").alias("k1"), F.col("seq").alias("seq1")).join(F.broadcast(other), F.col("k1") % 25 == F.col("k2"))  # nations are 25
    third = F.concat(F.substring("seq1", 9, 8), F.substring("seq2", 1, 10))
    return both.select("k1", "k2", F.lit(0).cast("long").alias("k3"), "seq1", "seq2", third.alias("seq3")).repartition(spark.sparkContext.defaultParallelism, "k1")


_LONG_SQL = f"SELECT a.k AS k1, b.k AS k2, 0::BIGINT AS k3, a.seq AS seq1, b.seq AS seq2, substr(a.seq, 9, 8) || substr(b.seq, 1, 10) AS seq3 FROM ({FWD_SQL}) a JOIN ({REV_SQL}) b ON a.k % 25 = b.k"


@query(f"SELECT k1, k2, k3, score FROM ({sql.aligned3(_LONG_SQL, THREE)})")
def nw3_score_primers(spark, sf_dir):
    return long_triples(spark, sf_dir).select("k1", "k2", "k3", align.nw3_score("seq1", "seq2", "seq3", THREE).alias("score"))


@query()
def nw3_align_primers(spark, sf_dir):
    """Without SQL: strings of this length take the engine minutes; scores have it (above), strings of short ones too."""
    found = long_triples(spark, sf_dir).select("k1", "k2", "k3", align.nw3_align("seq1", "seq2", "seq3", THREE).alias("r"))
    return found.select("k1", "k2", "k3", "r.*")


THREE_ASYMMETRIC = AlignConfig(NON_COMP_SYMMETRIC, -4.75, -0.9, False, (True, False, False, True, True, True), None)


@query(f"SELECT k1, k2, k3, round(score, 6) + 0.0 AS score FROM ({sql.aligned3(TRIPLES_SQL, THREE_ASYMMETRIC)})")
def nw3_score_no_close(spark, sf_dir):
    return triples(spark, sf_dir).select("k1", "k2", "k3", rounded(align.nw3_score("seq1", "seq2", "seq3", THREE_ASYMMETRIC)).alias("score"))


@query(f"SELECT k1, k2, k3, score, score AS rescored, seq1, seq2, seq3 FROM ({sql.aligned3(TRIPLES_SQL, THREE)})")
def nw3_align_degapped(spark, sf_dir):
    """The alignment's score, its rescored value, and its rows without gaps: score and inputs again."""
    found = triples(spark, sf_dir).select("k1", "k2", "k3", align.nw3_align("seq1", "seq2", "seq3", THREE).alias("r"))
    rows = [F.col(f"r.aligned{s}") for s in (1, 2, 3)]
    return found.select("k1", "k2", "k3", "r.score", rescore.score_alignment_3d(*rows, THREE).alias("rescored"), *[dna.degap(r).alias(f"seq{s + 1}") for s, r in enumerate(rows)])


@query(f"SELECT k1, k2, k3, aligned1, aligned2, aligned3, score FROM ({sql.aligned3(TRIPLES_SQL, THREE, True)})")
def nw3_align(spark, sf_dir):
    return triples(spark, sf_dir).select("k1", "k2", "k3", align.nw3_align("seq1", "seq2", "seq3", THREE).alias("r")).select("k1", "k2", "k3", "r.*")


DIMER3 = AlignConfig(free=DIMER3_FREE)


@query(f"SELECT k1, k2, k3, score FROM ({sql.aligned3(TRIPLES_SQL.replace('c.seq AS seq3', sql.reverse_complement('c.seq') + ' AS seq3'), DIMER3)})")
def align_dimer_score(spark, sf_dir):
    return align_dimer(spark, sf_dir).select("k1", "k2", "k3", "score")


_TURNED_SQL = TRIPLES_SQL.replace("c.seq AS seq3", sql.reverse_complement("c.seq") + " AS seq3")


@query(f"SELECT k1, k2, k3, aligned1, aligned2, {sql.complement('aligned3')} AS aligned3, score FROM ({sql.aligned3(_TURNED_SQL, DIMER3, True)})")
def align_dimer(spark, sf_dir):
    return align.align_dimer(triples(spark, sf_dir), "seq1", "seq2", "seq3").select("k1", "k2", "k3", "dimer3.*")


# Rescoring and events -----------------------------------------------------------------------------------------------

EVENTS = AlignConfig(free=(False, True, True, False))
ROUNDED = ("raw_penalty", "factor", "scaled_penalty")


def _explained(spark, sf_dir, types=None):
    rows = rescore.explain(gapped(spark, sf_dir), rescore.score_events("aligned1", "aligned2", EVENTS), ["k1", "k2"], types)
    return rows.withColumns({c: rounded(c, 9) for c in ROUNDED})


@query(sql.events(GAPPED_SQL, EVENTS))
def score_events(spark, sf_dir):
    return _explained(spark, sf_dir)


@query(f"SELECT event, count(*) AS n, round(sum(scaled_penalty), 6) AS total FROM ({sql.events(GAPPED_SQL, EVENTS)}) GROUP BY event")
def events_by_type(spark, sf_dir):
    return _explained(spark, sf_dir).groupBy("event").agg(F.count("*").alias("n"), F.round(F.sum("scaled_penalty"), 6).alias("total"))


@query(f"SELECT * FROM ({sql.events(GAPPED_SQL, EVENTS)}) WHERE event IN ('gap_open_seq1', 'gap_close_seq1', 'gap_close_seq2')")
def events_filtered(spark, sf_dir):
    return _explained(spark, sf_dir, ["gap_open_seq1", "gap_close_seq1", "gap_close_seq2"])


for _name, _config in {"rescore_2d": EVENTS, "rescore_2d_unscaled": PLAIN.but(gap_close=False), "rescore_2d_custom_scaler": AlignConfig(NON_COMP_SYMMETRIC, -6.0, -1.5, True, (True, False, False, True), Scaler(0.8, 1.4))}.items():
    query(f"SELECT k1, k2, round(sum(scaled_penalty), 6) + 0.0 AS score FROM ({sql.events(GAPPED_SQL, _config, 15)}) GROUP BY k1, k2", _name)(
        lambda spark, sf_dir, c=_config: gapped(spark, sf_dir).select("k1", "k2", rounded(rescore.score_alignment("aligned1", "aligned2", c)).alias("score"))
    )


_SHOWN_EVENT = " || ".join(
    ["'[score_alignment] event=' || event", *(f"' {c}=' || {c}" for c in ("col_idx", "seq1_pos", "seq2_pos", "mask")), "' prev_mask=' || prev_mask"]
    + [f"' {c}=' || printf('%.6g', {c})" for c in ("raw_penalty", "factor", "scaled_penalty")]
    + [f"coalesce(' {c}=' || {c}, '')" for c in ("seq1_char", "seq2_char")]
)


@query(f"SELECT k1, k2, event_no, {_SHOWN_EVENT} AS line FROM ({sql.events(GAPPED_SQL, EVENTS)})")
def events_formatted(spark, sf_dir):
    e = _explained(spark, sf_dir)
    return e.select("k1", "k2", "event_no", format_event(F.struct(*[c for c in e.columns if c not in ("k1", "k2", "event_no")])).alias("line"))


_THREE_GAPPED_SQL = f"SELECT k1, k2, aligned1, aligned2, translate(aligned1, 'AC-', 'GT-') AS aligned3 FROM ({GAPPED_SQL})"


def _three_gapped(spark, sf_dir):
    return gapped(spark, sf_dir).withColumn("aligned3", F.translate("aligned1", "AC-", "GT-"))


@query(sql.events3(_THREE_GAPPED_SQL, THREE))
def events_by_type_3d(spark, sf_dir):
    e = rescore.explain(_three_gapped(spark, sf_dir), rescore.score_events_3d("aligned1", "aligned2", "aligned3", THREE), ["k1", "k2"])
    return e.groupBy("k1", "k2", "event").agg(F.count("*").alias("n"), F.sum("scaled_penalty").alias("total"))


@query(f"SELECT k1, k2, sum(total) AS score FROM ({sql.events3(_THREE_GAPPED_SQL, THREE)}) GROUP BY k1, k2")
def rescore_3d(spark, sf_dir):
    return _three_gapped(spark, sf_dir).select("k1", "k2", rescore.score_alignment_3d("aligned1", "aligned2", "aligned3", THREE).alias("score"))


@query(sql.rows3(sql.aligned3(TRIPLES_SQL, THREE, True), THREE))
def score_events_3d(spark, sf_dir):
    found = triples(spark, sf_dir).select("k1", "k2", "k3", align.nw3_align("seq1", "seq2", "seq3", THREE).alias("r"))
    return rescore.explain(found, rescore.score_events_3d("r.aligned1", "r.aligned2", "r.aligned3", THREE), ["k1", "k2", "k3"])


# Consistency and symmetry -------------------------------------------------------------------------------------------

_ALL_FLAGS = list(product((False, True), repeat=4))
_REGION_SQL = sql.primers("region", "r_regionkey", "r")
_CASES_SQL = (
    "SELECT k1, 0::BIGINT AS k2, seq1, seq2 FROM (VALUES " + ", ".join(f"(({k - len(WITNESS_PAIRS)})::BIGINT, '{a}', '{b}')" for k, (a, b) in enumerate(WITNESS_PAIRS)) + ") AS t(k1, seq1, seq2) "
    f"UNION ALL SELECT a.k * 1000 + b.k, 0, a.seq, b.seq FROM ({_REGION_SQL}) a CROSS JOIN ({_REGION_SQL}) b"
)


def _passes_sql(flags: str, one: str, two: str, keys: str = "k1, k2") -> str:
    """one and two: SQL of scores with the keys. How many agree."""
    return f"SELECT '{flags}' AS flags, count(*) FILTER (abs(a.score - b.score) <= 1e-9) AS passed, count(*) AS total FROM ({one}) a JOIN ({two}) b USING ({keys})"


def _rescored_sql(alignments: str, config: AlignConfig) -> str:
    return f"SELECT k1, k2, coalesce(sum(scaled_penalty), 0) AS score FROM ({alignments}) LEFT JOIN ({sql.events(alignments, config, 15)}) USING (k1, k2) GROUP BY k1, k2"


def _rescoring_sql(config: AlignConfig) -> str:
    found = sql.aligned(_CASES_SQL, config, True)
    return _passes_sql(flag_string(config.free), found, _rescored_sql(found, config))


@query(" UNION ALL ".join(_rescoring_sql(AlignConfig(free=f)) for f in _ALL_FLAGS))
def dp_eq_rescore(spark, sf_dir):
    return sweep.passes_by_flags(sweep.rescoring_cases(cases(spark, sf_dir), [AlignConfig(free=f) for f in _ALL_FLAGS]))


_THREE_FLAGS = [flags_of(x) for x in ("000000", "011000", "111111", "000110")]


def _rescoring3_sql(config: AlignConfig) -> str:
    found = sql.aligned3(TRIPLES_SQL, config, True)
    again = f"SELECT k1, k2, k3, sum(scaled_penalty) AS score FROM ({sql.rows3(found, config)}) GROUP BY ALL"
    return _passes_sql(flag_string(config.free), found, f"SELECT k1, k2, k3, coalesce(e.score, 0) AS score FROM ({TRIPLES_SQL}) LEFT JOIN ({again}) e USING (k1, k2, k3)", "k1, k2, k3")


@query(" UNION ALL ".join(_rescoring3_sql(AlignConfig(free=f)) for f in _THREE_FLAGS))
def dp_eq_rescore_3d(spark, sf_dir):
    t = triples(spark, sf_dir).withColumn("pair_id", F.col("k1") * 10000 + F.col("k2") * 100 + F.col("k3"))
    return sweep.passes_by_flags(sweep.rescoring_cases(t, [AlignConfig(free=f) for f in _THREE_FLAGS]))


def _swapped_sql(pairs_sql: str) -> str:
    return f"SELECT k1, k2, {sql.reverse_complement('seq2')} AS seq1, {sql.reverse_complement('seq1')} AS seq2 FROM ({pairs_sql})"


_SWAPS_SQL = " UNION ALL ".join(_passes_sql(flag_string(f), sql.aligned(_CASES_SQL, PLAIN.but(free=f)), sql.aligned(_swapped_sql(_CASES_SQL), PLAIN.but(free=f[::-1]))) for f in _ALL_FLAGS)


@query(_SWAPS_SQL)
def swap_symmetry(spark, sf_dir):
    return sweep.passes_by_flags(sweep.dimer_swap_cases(cases(spark, sf_dir), [PLAIN.but(free=f) for f in _ALL_FLAGS]))


@query(f"SELECT count(*) FILTER (passed = total) AS passing_flags, count(*) AS all_flags FROM ({_SWAPS_SQL})")
def swap_symmetry_summary(spark, sf_dir):
    return sweep.fully_passing(swap_symmetry(spark, sf_dir))


_TURNED_GAPPED = f"SELECT k1, k2, {sql.reverse_complement('aligned2')} AS aligned1, {sql.reverse_complement('aligned1')} AS aligned2 FROM ({GAPPED_SQL})"


@query("SELECT passed, total FROM (" + _passes_sql("", _rescored_sql(GAPPED_SQL, EVENTS), _rescored_sql(_TURNED_GAPPED, EVENTS.but(free=EVENTS.free[::-1]))) + ")")
def rescore_swap_symmetry(spark, sf_dir):
    g = gapped(spark, sf_dir).withColumn("pair_id", F.col("k1") * 1000 + F.col("k2"))
    return sweep.alignment_swap_cases(g, EVENTS).agg(F.count_if("ok").alias("passed"), F.count("*").alias("total"))


@query()
def random_walk_swap_symmetry(spark, sf_dir):
    """Random alignments of all pairs, rescored in both orders."""
    walks = random_alignment(pairs(spark, sf_dir)).withColumn("pair_id", F.col("k1") * 1000 + F.col("k2"))
    return sweep.alignment_swap_cases(walks, EVENTS).agg(F.count_if("ok").alias("passed"), F.count("*").alias("total"))


@query()
def symmetry_rows(spark, sf_dir):
    """The whole grid of 768 conditions and symmetries."""
    return sweep.condition_rows(sweep.symmetry_cases(cases(spark, sf_dir), sweep.grid())).drop("first_failure")


_EXPECTED_SQL = """SELECT coalesce(symmetry, 'all') AS symmetry, count(*) AS n_rows, count(*) FILTER (symmetry <> 'reverse' AND (symmetry = 'swap' OR matrix = 'c')) AS expected_true
FROM (SELECT unnest(['swap', 'reverse', 'complement']) AS symmetry) CROSS JOIN (SELECT unnest(['c', 'n']) AS matrix) CROSS JOIN range(128) GROUP BY symmetry
UNION ALL SELECT 'all', 768, 384"""


@query(_EXPECTED_SQL)
def symmetry_rollup(spark, sf_dir):
    rows = sweep.by_symmetry(sweep.condition_rows(sweep.symmetry_cases(cases(spark, sf_dir), sweep.grid())))
    return rows.select(F.coalesce("symmetry", F.lit("all")).alias("symmetry"), "n_rows", (F.col("expected_true") - F.col("expected_true_failures")).alias("expected_true"))


def _complement_cases(spark, sf_dir):
    """Scores of a matrix that is not complement-symmetric, against those of the complements."""
    c = AlignConfig(NON_COMP_SYMMETRIC, free=DIMER_FREE, scaler=None)
    seqs, changed = dna.transformed("complement", ["seq1", "seq2"], c)
    p = pairs(spark, sf_dir).select("k1", F.col("k2").alias("pair_id"), align.nw_score("seq1", "seq2", c).alias("score"), align.nw_score(*seqs, changed).alias("moved"))
    return p.withColumn("ok", sweep.close_to(F.col("score"), F.col("moved")))


_NCS = AlignConfig(NON_COMP_SYMMETRIC, free=DIMER_FREE, scaler=None)
_COMPLEMENTED = f"SELECT k1, k2, {sql.complement('seq1')} AS seq1, {sql.complement('seq2')} AS seq2 FROM ({PAIRS_SQL})"
_BOTH_SQL = f"SELECT a.k1, a.k2 AS pair_id, a.score, b.score AS moved FROM ({sql.aligned(PAIRS_SQL, _NCS)}) a JOIN ({sql.aligned(_COMPLEMENTED, _NCS)}) b USING (k1, k2)"


@query(f"SELECT k1, count(*) AS total, count(*) FILTER (score <> moved) AS failures, min(pair_id) FILTER (score <> moved) AS first_failure FROM ({_BOTH_SQL}) GROUP BY k1")
def first_failure(spark, sf_dir):
    bad = ~F.col("ok")
    return _complement_cases(spark, sf_dir).groupBy("k1").agg(F.count("*").alias("total"), F.count_if(bad).alias("failures"), F.min(F.when(bad, F.col("pair_id"))).alias("first_failure"))


@query(f"SELECT * FROM (SELECT k1, pair_id, score, moved, row_number() OVER (PARTITION BY k1 ORDER BY pair_id)::INT AS failure_no FROM ({_BOTH_SQL}) WHERE score <> moved) WHERE failure_no <= 5")
def failures_top_n(spark, sf_dir):
    return sweep.printed_failures(_complement_cases(spark, sf_dir), "ok", ["k1"]).drop("ok")


_MATRICES = {"basic": PLAIN.matrix, "comp_symmetric": COMP_SYMMETRIC, "non_comp_symmetric": NON_COMP_SYMMETRIC, "directional": DIRECTIONAL}
_MATRIX_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{x}', '{y}', {s})" for n, m in _MATRICES.items() for x, y, s in m.rows()) + ") AS t(matrix, x, y, s)"


@query(
    f"""WITH t AS ({_MATRIX_SQL}) SELECT a.matrix, bool_and(a.s = b.s) AS transpose_symmetric, bool_and(a.s = c.s) AS complement_symmetric FROM t a
JOIN t b ON a.matrix = b.matrix AND a.x = b.y AND a.y = b.x JOIN t c ON a.matrix = c.matrix AND c.x = {sql.complement('a.x')} AND c.y = {sql.complement('a.y')} GROUP BY a.matrix"""
)
def matrix_symmetry(spark, sf_dir):
    rows = [(n, x, y, s) for n, m in _MATRICES.items() for x, y, s in m.rows()]
    return sweep.matrix_predicates(spark.createDataFrame(rows, "matrix string, x string, y string, s double"))


def _random_sql(k: int, shortest: int, longest: int, seed: int) -> str:
    named = lambda what: f"md5('{seed}:{k}:' || pair_id || ':{what}')"
    letters = " || ".join(named(b) for b in range(longest // 32 + 1))
    size = f"('0x' || substr({named('size')}, 1, 8))::BIGINT % {longest - shortest + 1} + {shortest}"
    return f"substr(translate({letters}, '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, ({size})::INT) AS seq{k + 1}"


@query(f"SELECT pair_id, {_random_sql(0, 8, 40, 3)}, {_random_sql(1, 8, 40, 3)} FROM (SELECT unnest(range(count(*))) AS pair_id FROM customer)")
def random_sequences(spark, sf_dir):
    """A reproducible random pair for every customer."""
    n = table(spark, sf_dir, "customer").count()
    return random_dna(spark, n, 8, 40, seed=3)


# Text ---------------------------------------------------------------------------------------------------------------


def _masked(x: str, left: bool, right: bool) -> str:
    if left:
        x = f"(repeat(' ', length({x}) - length(ltrim({x}, '-'))) || ltrim({x}, '-'))"
    return f"(rtrim({x}, '-') || repeat(' ', length({x}) - length(rtrim({x}, '-'))))" if right else x


def _match_sql(a: str, b: str, b_shown: str | None = None) -> str:
    other = b_shown or b
    return f"array_to_string(list_transform(range(1, length({a}) + 1), lambda i: CASE WHEN substr({a}, i, 1) = substr({other}, i, 1) AND substr({a}, i, 1) NOT IN ('-', ' ') THEN '|' ELSE ' ' END), '')"


def _wrapped_sql(rows: list[str], width: int) -> str:
    block = " || chr(10) || ".join(f"substr({r}, blk * {width} + 1, {width})" for r in rows)
    return f"rtrim(array_to_string(list_transform(range(0, ((length({rows[0]}) + {width - 1}) // {width})), lambda blk: {block} || chr(10)), chr(10)), ' ' || chr(10)) || chr(10)"


_SHOWN = f"SELECT k1, k2, {_masked('aligned1', *DIMER_FREE[:2])} AS a, {_masked('aligned2', *DIMER_FREE[2:])} AS b FROM ({GAPPED_SQL})"


@query(f"SELECT k1, k2, {_wrapped_sql(['a', 'm', 'b'], 20)} AS block FROM (SELECT *, {_match_sql('a', 'b')} AS m FROM ({_SHOWN}))")
def ascii_2d(spark, sf_dir):
    return gapped(spark, sf_dir).select("k1", "k2", render.to_ascii("aligned1", "aligned2", DIMER_FREE, 20).alias("block"))


@query(f"SELECT k1, k2, a || chr(10) || m || chr(10) || b || chr(10) AS block FROM (SELECT *, {_match_sql('a', 'b', sql.complement('b'))} AS m FROM ({_SHOWN}))")
def dimer_ascii(spark, sf_dir):
    return gapped(spark, sf_dir).select("k1", "k2", render.dimer_to_ascii("aligned1", "aligned2", None).alias("block"))


_THREE_ROWS = f"SELECT k1, k2, aligned1 AS a, {_masked('aligned2', True, True)} AS b, {_masked('aligned1', False, True)} AS c FROM ({GAPPED_SQL})"


@query(f"SELECT k1, k2, {_wrapped_sql(['a', 'b', 'c'], 16)} AS block FROM ({_THREE_ROWS})")
def ascii_3d(spark, sf_dir):
    return gapped(spark, sf_dir).select("k1", "k2", render.to_ascii_3d("aligned1", "aligned2", "aligned1", (False, False, True, True, False, True), 16).alias("block"))


@query(f"SELECT k1, k2, unnest(string_split(rtrim({_wrapped_sql(['a', 'm', 'b'], 20)}, chr(10)), chr(10))) AS line FROM (SELECT *, {_match_sql('a', 'b')} AS m FROM ({_SHOWN}))")
def rendered_lines(spark, sf_dir):
    return ascii_2d(spark, sf_dir).select("k1", "k2", F.explode(render.lines_of("block")).alias("line"))


_SPACED = f"SELECT k1, k2, translate(aligned1, '-', ' ') AS a, '-' || aligned2 AS b FROM ({GAPPED_SQL})"
_TOP = "CASE WHEN regexp_matches(a, '[A-Za-z]') THEN translate(substr(a, 1, length(rtrim(a, ' -'))), ' ', '-') || translate(substr(a, length(rtrim(a, ' -')) + 1), '-', ' ') ELSE translate(a, ' ', '-') END"
_BOTTOM = "CASE WHEN regexp_matches(b, '[A-Za-z]') THEN translate(substr(b, 1, length(b) - length(ltrim(b, ' -'))), '-', ' ') || translate(ltrim(b, ' -'), ' ', '-') ELSE translate(b, ' ', '-') END"


@query(f"SELECT k1, k2, {_TOP} AS top, {_BOTTOM} AS bottom FROM ({_SPACED})")
def normalised_rows(spark, sf_dir):
    g = gapped(spark, sf_dir).select("k1", "k2", F.translate("aligned1", "-", " ").alias("a"), F.concat(F.lit("-"), "aligned2").alias("b"))
    return g.select("k1", "k2", diagrams.normalise_top("a").alias("top"), diagrams.normalise_bottom("b").alias("bottom"))


@query(f"SELECT k1, k2, {_match_sql('aligned1', 'aligned2', sql.complement('aligned2'))} AS bonds FROM ({GAPPED_SQL})")
def bond_lines(spark, sf_dir):
    return gapped(spark, sf_dir).select("k1", "k2", diagrams.bond_line("aligned1", "aligned2").alias("bonds"))


def _idt_answers(spark, sf_dir):
    bonds = F.transform(F.sequence(F.lit(1), F.least(F.length("seq1"), F.length("seq2"))), lambda i: ((i + F.col("k1")) % 3).cast("int"))
    pads = [(F.col("k2") % 4).cast("int").alias("TopLinePadding"), F.lit(2).alias("BondLinePadding"), (F.col("k1") % 5).cast("int").alias("BottomLinePadding")]
    return pairs(spark, sf_dir).select("k1", "k2", "seq1", "seq2", F.struct(*pads, bonds.alias("Bonds")).alias("response"))


_IDT_RAW = f"""SELECT k1, k2, repeat(' ', (k2 % 4)::INT) || seq1 AS a0, repeat(' ', (k1 % 5)::INT) || reverse(seq2) AS b0,
'  ' || array_to_string(list_transform(range(1, least(length(seq1), length(seq2)) + 1), lambda i: CASE WHEN (i + k1) % 3 = 0 THEN ' ' ELSE '|' END), '') AS m0 FROM ({PAIRS_SQL})"""
_IDT_PADDED = f"SELECT k1, k2, rpad(a0, w, ' ') AS a, rpad(b0, w, ' ') AS b, rpad(m0, w, ' ') AS m FROM (SELECT *, greatest(length(a0), length(b0), length(m0))::INT AS w FROM ({_IDT_RAW}))"
_IDT_ROWS = f"SELECT k1, k2, {_TOP} AS a, m, {_BOTTOM} AS b FROM ({_IDT_PADDED})"
_LEAD = "least(" + ", ".join(f"length({x}) - length(ltrim({x}, ' '))" for x in "amb") + ")"
_TRAIL = "least(" + ", ".join(f"length({x}) - length(rtrim({x}, ' '))" for x in "amb") + ")"


@query(f"SELECT k1, k2, substr(a, lo + 1, n) || chr(10) || substr(m, lo + 1, n) || chr(10) || substr(b, lo + 1, n) || chr(10) AS block FROM (SELECT *, {_LEAD} AS lo, length(a) - {_LEAD} - {_TRAIL} AS n FROM ({_IDT_ROWS}))")
def parse_idt(spark, sf_dir):
    return _idt_answers(spark, sf_dir).select("k1", "k2", diagrams.parse_idt("seq1", "seq2", "response", None).alias("block"))


def _diagrams(spark, sf_dir):
    """SEQ and STR lines of every pair, wrapped at 20 columns, the second label followed by a tab."""
    body = lambda x: F.translate(x, "-", " ")
    g = gapped(spark, sf_dir)
    lines = F.concat(F.lit("SEQ "), F.substring(body("aligned1"), 1, 20), F.lit("\nSTR "), F.substring(body("aligned2"), 1, 20), F.lit("\nSEQ "), F.repeat(F.lit(" "), F.lit(20)), F.expr("substr(translate(aligned1, '-', ' '), 21)"), F.lit("\nSTR "), F.repeat(F.lit(" "), F.lit(20)), F.expr("substr(translate(aligned2, '-', ' '), 21)"))
    return g.select("k1", "k2", lines.alias("diagram"))


_DRAWN = f"SELECT k1, k2, translate(aligned1, '-', ' ') AS a, translate(aligned2, '-', ' ') AS b FROM ({GAPPED_SQL})"
_KEPT = "list_filter(range(1, length(a) + 1), lambda i: substr(a, i, 1) <> ' ' OR substr(b, i, 1) <> ' ')"
_PACKED = ", ".join(f"array_to_string(list_transform({_KEPT}, lambda i: substr({x}, i, 1)), '') AS {x}" for x in "ab")
_STRANDS = f"SELECT k1, k2, {_TOP} AS a, {_BOTTOM} AS b FROM (SELECT k1, k2, {_PACKED} FROM ({_DRAWN}))"


@query(f"SELECT k1, k2, {_wrapped_sql(['a', 'm', 'b'], render.LINE_WIDTH)} AS block FROM (SELECT *, {_match_sql('a', 'b', sql.complement('b'))} AS m FROM ({_STRANDS}))")
def parse_primer3(spark, sf_dir):
    return _diagrams(spark, sf_dir).select("k1", "k2", diagrams.parse_primer3("diagram").alias("block"))


_GAP_INSIDE = " OR ".join(f"regexp_matches({x}, '[A-Za-z].*-.*[A-Za-z]')" for x in "ab")


@query(f"SELECT k1, k2, 'gapped' AS kind, {_GAP_INSIDE} AS internal_gap FROM ({_STRANDS}) UNION ALL SELECT k1, k2, 'plain' AS kind, {_GAP_INSIDE} AS internal_gap FROM (SELECT k1, k2, seq1 AS a, seq2 AS b FROM ({PAIRS_SQL}))")
def has_internal_gap(spark, sf_dir):
    """Of gapped diagrams, and of plain ones."""
    plain = pairs(spark, sf_dir).select("k1", "k2", F.lit("plain").alias("kind"), F.concat(F.lit("SEQ "), "seq1", F.lit("\nSTR "), "seq2").alias("diagram"))
    both = _diagrams(spark, sf_dir).withColumn("kind", F.lit("gapped")).unionByName(plain)
    return both.select("k1", "k2", "kind", diagrams.has_internal_gap("diagram").alias("internal_gap"))


@query("SELECT s_suppkey AS k, s_acctbal AS ds, round(s_acctbal / 7, 2) AS dh, (0 - s_suppkey)::DOUBLE AS dg, 37.5::DOUBLE AS t, 'SEQ ' || s_name AS ascii_structure FROM supplier")
def ntthal_parse(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    number = lambda c: c.cast("decimal(20,2)").cast("string")
    text = F.concat(F.lit("Calculated\tdS = "), number(F.col("s_acctbal")), F.lit("\tdH = "), number(F.round(F.col("s_acctbal") / 7, 2)), F.lit("\tdG = -"), F.col("s_suppkey").cast("string"), F.lit("\tt = 37.5\nSEQ "), F.col("s_name"), F.lit("  \n"))
    return s.select(F.col("s_suppkey").alias("k"), connectors.parse_ntthal(text).alias("r")).select("k", "r.ds", "r.dh", (F.col("r.dg") + F.lit(0.0)).alias("dg"), "r.t", "r.ascii_structure")


# Thermodynamics -----------------------------------------------------------------------------------------------------

_RT = thermo.GAS_CONSTANT * (37.0 + thermo.ZERO_CELSIUS)
_DG_SQL = "SELECT c_nationkey, -abs(c_acctbal) / 1000 AS dg FROM customer"
_DG_GROUPED = f"""SELECT c_nationkey, round(-{_RT} * (most + ln(total)), 6) AS delta_g FROM (SELECT c_nationkey, any_value(most) AS most, sum(exp(x - most)) AS total
FROM (SELECT c_nationkey, -dg / {_RT} AS x, max(-dg / {_RT}) OVER (PARTITION BY c_nationkey) AS most FROM ({_DG_SQL})) GROUP BY c_nationkey)"""


def _energies(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_nationkey", (-F.abs("c_acctbal") / 1000).alias("dg"))


@query(_DG_GROUPED)
def delta_g_by_group(spark, sf_dir):
    return thermo.delta_g_by_group(_energies(spark, sf_dir), ["c_nationkey"], "dg").withColumn("delta_g", F.round("delta_g", 6))


@query(_DG_GROUPED)
def delta_g_array(spark, sf_dir):
    arrays = _energies(spark, sf_dir).groupBy("c_nationkey").agg(F.collect_list("dg").alias("all"))
    return arrays.select("c_nationkey", F.round(thermo.combined_delta_g("all"), 6).alias("delta_g"))


# Benchmarks, rates and connectors -----------------------------------------------------------------------------------

_SERIES_SQL = """SELECT CASE l_linestatus WHEN 'O' THEN '2d' ELSE '3d' END AS dimension, CASE WHEN l_returnflag = 'R' THEN 'python' ELSE 'rust' END AS backend,
l_quantity::INT AS n, sum(l_extendedprice) / 1000 AS time_s FROM lineitem GROUP BY ALL"""


def _series(spark, sf_dir):
    """A series of sizes and times out of lineitem: sums of prices by quantity."""
    l = table(spark, sf_dir, "lineitem")
    dimension = F.when(F.col("l_linestatus") == "O", "2d").otherwise("3d")
    backend = F.when(F.col("l_returnflag") == "R", "python").otherwise("rust")
    return l.groupBy(dimension.alias("dimension"), backend.alias("backend"), F.col("l_quantity").cast("int").alias("n")).agg((F.sum("l_extendedprice") / 1000).alias("time_s"))


_RATIO_SQL = f"WITH s AS ({_SERIES_SQL}) SELECT dimension, n, p.time_s AS slow_s, r.time_s AS fast_s, p.time_s / r.time_s AS ratio FROM (SELECT * FROM s WHERE backend = 'python') p JOIN (SELECT * FROM s WHERE backend = 'rust') r USING (dimension, n)"


@query(f"SELECT dimension, n, round(slow_s, 6) AS slow_s, round(fast_s, 6) AS fast_s, round(ratio, 6) AS ratio FROM ({_RATIO_SQL})")
def speedups(spark, sf_dir):
    return speedup.speedups(_series(spark, sf_dir)).select("dimension", "n", F.round("slow_s", 6).alias("slow_s"), F.round("fast_s", 6).alias("fast_s"), F.round("ratio", 6).alias("ratio"))


@query(f"SELECT dimension, count(*) AS points, round(median(ratio), 6) AS median_ratio, max(n) AS tail_n, round(arg_max(ratio, n), 6) AS tail_ratio FROM ({_RATIO_SQL}) GROUP BY dimension")
def median_speedup(spark, sf_dir):
    s = speedup.speedup_summary(_series(spark, sf_dir))
    return s.withColumns({c: F.round(c, 6) for c in ("median_ratio", "tail_ratio")})


@query(f"SELECT dimension, backend, round(regr_slope(ln(time_s), ln(n)), 6) AS exponent FROM ({_SERIES_SQL}) GROUP BY ALL")
def loglog_slope(spark, sf_dir):
    return speedup.scaling(_series(spark, sf_dir)).withColumn("exponent", F.round("exponent", 6))


@query(f"SELECT dimension, n FROM ({_SERIES_SQL}) WHERE backend = 'python' INTERSECT SELECT dimension, n FROM ({_SERIES_SQL}) WHERE backend = 'rust'")
def common_n(spark, sf_dir):
    return speedup.common_sizes(_series(spark, sf_dir))


_BYTES = "CASE dimension WHEN '2d' THEN pow(n + 1, 2) * 33 ELSE pow(n + 1, 3) * 84 END"


@query(f"SELECT dimension, backend, n, {_BYTES} AS bytes FROM ({_SERIES_SQL}) WHERE {_BYTES} <= 1e6")
def dp_bytes(spark, sf_dir):
    return speedup.before_cap(_series(spark, sf_dir), 1e6).select("dimension", "backend", "n", "bytes")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3599999999 MICROSECONDS PRECEDING AND CURRENT ROW) AS n_calls FROM events")
def rate_limit_audit(spark, sf_dir):
    return calls_in_period(table(spark, sf_dir, "events"), seconds=3600, by=["user_id"]).select("event_id", "n_calls")


def _named(df: DataFrame) -> DataFrame:
    return df.select(F.col("k").alias("i"), F.col("k").cast("string").alias("name"), "seq")


def stand_in_primer3(seq1: str, seq2: str) -> dict:
    return {"tm": len(seq1) + len(seq2), "dg": -float(len(seq1)), "ds": 0.5, "dh": -1.0, "structure_found": seq1[0] == seq2[0], "ascii_structure": f"SEQ {seq1}"}


def stand_in_ntthal(seq1: str, seq2: str) -> dict:
    return connectors.parse_ntthal_text(f"dS = 1.5 dH = -2 dG = -{len(seq2)} t = 37\nSEQ {seq1}\nSTR {seq2}")


def stand_in_post(url: str, **what) -> object:
    if url == connectors.TOKEN_URL:
        return {"access_token": "t", "expires_in": 3600}
    if what["params"]["primary"].startswith("A"):
        raise connectors.HttpError(404, "no such sequence")
    return [{"StartPosition": 0, "DeltaG": -float(len(what["params"]["secondary"]))}]


@query(
    f"""SELECT k1::VARCHAR AS primer1_name, k2::VARCHAR AS primer2_name, (length(seq1) + length(seq2))::DOUBLE AS primer3_tm, -length(seq1)::DOUBLE AS primer3_dg, 0.5::DOUBLE AS primer3_ds, -1.0::DOUBLE AS primer3_dh,
substr(seq1, 1, 1) = substr(seq2, 1, 1) AS primer3_structure_found, 'SEQ ' || seq1 AS primer3_ascii_structure, 1.5::DOUBLE AS ntthal_ds, -2.0::DOUBLE AS ntthal_dh, -length(seq2)::DOUBLE AS ntthal_dg, 37.0::DOUBLE AS ntthal_t,
'SEQ ' || seq1 || chr(10) || 'STR ' || seq2 AS ntthal_ascii_structure FROM ({PAIRS_SQL})"""
)
def primer3_batch(spark, sf_dir):
    return connectors.heterodimer_batch_primer3(_named(forward(spark, sf_dir)), _named(reverse(spark, sf_dir)), n_jobs=4, primer3=stand_in_primer3, ntthal=stand_in_ntthal)


@query(
    f"""SELECT k1::VARCHAR AS primer1_name, k2::VARCHAR AS primer2_name, seq1 AS primer1, seq2 AS primer2, seq1 NOT LIKE 'A%' AS ok, CASE WHEN seq1 LIKE 'A%' THEN 404 ELSE 200 END::INT AS status_code,
CASE WHEN seq1 LIKE 'A%' THEN 'no such sequence' END AS error, CASE WHEN seq1 NOT LIKE 'A%' THEN -length(seq2)::DOUBLE END AS delta_g FROM ({PAIRS_SQL})"""
)
def idt_batch(spark, sf_dir):
    account = connectors.IdtAccount("id", "secret", "user", "password")
    found = connectors.heterodimer_batch_idt(_named(forward(spark, sf_dir)), _named(reverse(spark, sf_dir)), account, max_calls_per_minute=10_000_000, post=stand_in_post)
    response = F.from_json("response", connectors.IDT_RESPONSE)
    return found.withColumn("delta_g", F.try_element_at(response, F.lit(1))["DeltaG"]).drop("response")

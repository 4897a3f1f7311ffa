import math
import random

import pytest
import slow
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strandloom.functions import diagrams, dna, render, thermo
from strandloom.functions.config import DIMER3_FREE, DIMER_FREE, AlignConfig
from strandloom.functions.text import format_event
from strandloom.operators import align, rescore, screen


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def first(df, *columns):
    return df.select(*columns).first()[0]


def test_normalise(spark):
    df = rows(spark, [(" \tac g t\n",), (None,)], "s string")
    assert [r[0] for r in df.select(dna.normalise("s")).collect()] == ["ACGT", None]
    assert first(rows(spark, [("AcGt-N",)], "s string"), dna.reverse_complement("s")) == "N-aCgT"


def test_rescoring_agrees_with_alignment(spark):
    df = rows(spark, [(1, "ACGTTG", "AGTG"), (2, "", "ACG"), (3, "A", ""), (4, "", ""), (5, None, "A")], "id int, a string, b string")
    for config in (AlignConfig(free=DIMER_FREE), AlignConfig(scaler=None, gap_close=False), AlignConfig(free=(True, False, False, True))):
        got = df.select("id", align.nw_align("a", "b", config).alias("r")).select("id", "r.score", rescore.score_alignment("r.aligned1", "r.aligned2", config).alias("s")).collect()
        for r in got:
            assert (r.score is None and r.s is None) if r.id == 5 else r.score == pytest.approx(r.s, abs=1e-9)


def test_events_of_a_small_alignment(spark):
    df = rows(spark, [("A--CG", "ATTC-")], "a string, b string")
    e = rescore.explain(df, rescore.score_events("a", "b", AlignConfig(scaler=None)), []).collect()
    assert [(r.event, r.col_idx, r.seq1_pos, r.seq2_pos, r.mask, r.prev_mask, r.scaled_penalty) for r in e] == [
        ("substitution_match", 0, 0, 0, 0, 0, 2.0),
        ("gap_open_seq1", 1, 1, 1, 1, 0, -3.0),
        ("gap_extend_seq1", 2, 1, 2, 1, 1, -1.0),
        ("substitution_match", 3, 1, 3, 0, 1, 2.0),
        ("gap_close_seq1", 3, 1, 3, 0, 1, -2.0),
        ("gap_open_seq2", 4, 2, 4, 2, 0, -3.0),
        ("gap_close_seq2", 4, 2, 4, 2, 0, -2.0),
    ]
    none = rescore.explain(df, rescore.score_events("a", "b"), [], [])
    assert none.count() == 0
    assert rescore.explain(df, rescore.score_events("a", "b"), [], ["gap_open_seq2"]).count() == 1


def test_disabled_close_still_reports_a_trailing_event(spark):
    df = rows(spark, [("AC", "A-", "A-")], "a string, b string, c string")
    off = AlignConfig(scaler=None, gap_close=False)
    e = rescore.explain(df, rescore.score_events("a", "b", off), []).collect()
    assert [(r.event, r.scaled_penalty) for r in e] == [("substitution_match", 2.0), ("gap_open_seq2", -5.0), ("gap_close_seq2", 0.0)]
    three = AlignConfig(free=(False,) * 6, gap_close=False)
    assert "gap_close" not in str([r.event for r in rescore.explain(df, rescore.score_events_3d("a", "b", "c", three), []).collect()])


def test_three_dimensional_trailing_positions(spark):
    df = rows(spark, [("AC", "A-", "AC")], "a string, b string, c string")
    e = rescore.explain(df, rescore.score_events_3d("a", "b", "c"), []).collect()
    assert [(r.event, r.col_idx, r.seq2_pos) for r in e if "gap" in r.event] == [("gap_open_seq2", 1, 1), ("gap_close_seq2", 1, 1)]


@pytest.mark.parametrize("a,b,match", [("A-", "C-", "gaps"), ("AC", "A", "length"), ("AN", "AA", "no entry")])
def test_bad_alignments(spark, a, b, match):
    with pytest.raises(PySparkException, match=match):
        rows(spark, [(a, b)], "a string, b string").select(rescore.score_alignment("a", "b")).collect()


def test_formatted_event(spark):
    df = rows(spark, [("AC", "A-")], "a string, b string")
    lines = [r[0] for r in df.select(F.explode(rescore.score_events("a", "b", AlignConfig(scaler=None))).alias("event")).select(format_event("event")).collect()]
    assert lines[0] == "[score_alignment] event=substitution_match col_idx=0 seq1_pos=0 seq2_pos=0 mask=0 prev_mask=0 raw_penalty=2 factor=1 scaled_penalty=2 seq1_char=A seq2_char=A"
    assert lines[1].startswith("[score_alignment] event=gap_open_seq2 col_idx=1") and "char" not in lines[1]


def test_rendering(spark):
    df = rows(spark, [("AAACGT", "---GCA"), ("ACGT--", "TGCAGG")], "a string, b string")
    assert [r[0] for r in df.select(render.dimer_to_ascii("a", "b", None)).collect()] == ["AAACGT\n   |||\n   GCA\n", "ACGT  \n||||  \nTGCAGG\n"]
    wide = rows(spark, [("A" * 130, "A" * 130)], "a string, b string")
    text = first(wide, render.to_ascii("a", "b"))
    assert text == "\n".join(["A" * 120, "|" * 120, "A" * 120, "", "A" * 10, "|" * 10, "A" * 10]) + "\n"
    assert first(wide, render.to_ascii("a", "b", line_width=0)).count("\n") == 3
    empty = rows(spark, [("", "")], "a string, b string")
    assert first(empty, render.to_ascii("a", "b")) == "\n"
    assert first(empty, render.to_ascii("a", "b", line_width=None)) == "\n\n\n"
    with pytest.raises(PySparkException, match="column"):
        empty.select(render.dimer_to_ascii("a", "b")).collect()
    three = rows(spark, [("--AC", "GGAC", "GG--")], "a string, b string, c string")
    assert first(three, render.to_ascii_3d("a", "b", "c", (True, False, False, False, False, True), None)) == "  AC\nGGAC\nGG  \n"
    assert first(three, render.to_ascii_3d("a", "b", "c", line_width=3)) == "--A\nGGA\nGG-\n\nC\nC\n-\n"
    assert first(rows(spark, [("---", "ACG")], "a string, b string"), render.to_ascii("a", "b", (True, True, False, False), None)) == "   \n   \nACG\n"


PRIMER3 = [
    ("SEQ ACGT\nSTR TGCA", "ACGT\n||||\nTGCA\n", False),
    ("SEQ\tACGTACGT\nSTR\tTGCATGCA", "ACGTACGT\n||||||||\nTGCATGCA\n", False),
    ("SEQ  AAACGT\nSTR     GCAAA", "AAACGT  \n   |||  \n   GCAAA\n", False),
    ("SEQ ACGT      \nSEQ       ACGT\nSTR TGCA\nSTR       TGCA", "ACGTACGT\n||||||||\nTGCATGCA\n", False),
    ("SEQ ACGT\nSTR TG T", "ACGT\n||  \nTG-T\n", True),
    ("no strands here", "\n\n\n", False),
    ("SEQ    \nSTR  ", "\n\n\n", False),
    ("", "\n\n\n", False),
    ("SEQ " + "ACGT" * 40 + "\nSTR " + "TGCA" * 20 + " " + "CA" * 39, None, True),
]


def test_primer3_diagrams(spark):
    df = rows(spark, [(k, d) for k, (d, *_) in enumerate(PRIMER3)] + [(99, None)], "k int, d string")
    got = {r.k: (r.t, r.g) for r in df.select("k", diagrams.parse_primer3("d").alias("t"), diagrams.has_internal_gap("d").alias("g")).collect()}
    for k, (_, text, gap) in enumerate(PRIMER3):
        assert got[k][1] == gap
        if text is not None:
            assert got[k][0] == text
    assert got[99][0] is None


IDT = [
    ("ACGT", "ACGT", (0, 0, 0, [2, 2, 2, 2]), "ACGT\n||||\nTGCA\n"),
    ("AAACGT", "AAACG", (0, 3, 3, [2, 2, 2]), "AAACGT  \n   |||  \n   GCAAA\n"),
    ("GT", "GT", (0, 0, 0, [1, 1]), "GT\n||\nTG\n"),
    ("ACGT", "ATTT", (0, 0, 0, [2, 0, 0, 2]), "ACGT\n|  |\nTTTA\n"),
    ("ACGT", "GGACGT", (0, 0, 0, [2, 2, 2, 2]), "ACGT  \n||||  \nTGCAGG\n"),
    ("", "", (0, 0, 0, []), "\n\n\n"),
]
RESPONSE = "p string, q string, r struct<TopLinePadding:int,BondLinePadding:int,BottomLinePadding:int,Bonds:array<int>>"


def test_idt_diagrams(spark):
    df = rows(spark, [x[:3] for x in IDT], RESPONSE)
    got = [r[0] for r in df.select(diagrams.parse_idt("p", "q", "r")).collect()]
    assert got == [x[3] for x in IDT]
    with pytest.raises(PySparkException, match="bonds"):
        rows(spark, [("A", "T", (0, 0, 0, [3]))], RESPONSE).select(diagrams.parse_idt("p", "q", "r")).collect()


def test_bond_line_is_case_sensitive(spark):
    df = rows(spark, [("ACgt- ", "TgcTA")], "a string, b string")
    assert first(df, diagrams.bond_line("a", "b")) == "| |  "


def test_row_ends(spark):
    df = rows(spark, [("  AC GT- -", "--AC GT  "), ("- -", "- -")], "a string, b string")
    got = df.select(diagrams.normalise_top("a").alias("t"), diagrams.normalise_bottom("b").alias("b")).collect()
    assert (got[0].t, got[0].b) == ("--AC-GT   ", "  AC-GT--")
    assert (got[1].t, got[1].b) == ("---", "---")


def test_free_energies(spark):
    df = rows(spark, [("a", -5.0), ("a", -6.0), ("b", -1.0), (None, -2.0)], "k string, v double")
    got = {r.k: r.delta_g for r in thermo.delta_g_by_group(df, ["k"], "v").collect()}
    assert got["a"] == pytest.approx(-6.111035639918299) and got["b"] == pytest.approx(-1.0) and got[None] == pytest.approx(-2.0)
    arrays = df.groupBy("k").agg(F.collect_list("v").alias("v")).select("k", thermo.combined_delta_g("v").alias("g"))
    assert {r.k: r.g for r in arrays.collect()} == pytest.approx(got)
    udaf = thermo.delta_g_aggregate()
    assert {r.k: r[1] for r in df.groupBy("k").agg(udaf("v")).collect()} == pytest.approx(got)
    with pytest.raises(ValueError, match="temperature"):
        thermo.combined_delta_g("v", -300)
    for bad in ([], [float("nan")], [float("inf")], [None]):
        with pytest.raises(PySparkException):
            rows(spark, [(bad,)], "v array<double>").select(thermo.combined_delta_g("v")).collect()


def test_dimers(spark):
    df = rows(spark, [("GAGATATGAGGAGAGAGAGACAGAGG", "CAAGGTTAGTCTCTCCCTCTGTTC")], "x string, y string")
    got = align.predict_dimer(df, "x", "y").select("dimer.*").first()
    assert got.score == pytest.approx(8.97420634920635) and got.aligned2.endswith("CT-TGTCTCCCTCTCTGATTGGAAC")
    three = align.align_dimer(df.withColumn("d", F.lit("GAGATATGAGG")), "d", "x", "y").select("dimer3.*").first()
    plain = df.select(align.nw3_align(F.lit("GAGATATGAGG"), "x", dna.reverse_complement("y"), AlignConfig(free=DIMER3_FREE)).alias("r")).select("r.*").first()
    assert three.score == plain.score and three.aligned1 == plain.aligned1


def test_sql_names(spark):
    align.register(spark, AlignConfig(scaler=None))
    r = spark.sql("SELECT nw_score('ACGT', 'ACGT') AS s, nw_align('ACG', 'AG').aligned2 AS a, nw_score3('A', 'A', 'A') AS t, nw_align3('A', 'A', 'A').score AS u, revcomp('AACG') AS r").first()
    assert (r.s, r.a, r.t, r.u, r.r) == (8.0, "A-G", 6.0, 6.0, "CGTT")


def test_screens(spark):
    p = rows(spark, [(k, s) for k, s in enumerate(["ACGTAC", "GGTTAA", "ACGTAC", "TTTT"])], "k long, seq string")
    every = screen.key_pairs(p, p).select("k1", "k2", align.dimer_score("seq1", "seq2").alias("score"))
    full = {(r.k1, r.k2): r.score for r in every.collect()}
    half = {(r.k1, r.k2): r.score for r in screen.self_screen(p).collect()}
    assert full.keys() == half.keys() and all(full[k] == pytest.approx(half[k]) for k in full)
    best = {r.k1: r.k2 for r in screen.best_partner(every, "k1", "k2", "score").collect()}
    assert best == {a: min((b for b in range(4)), key=lambda b: (-full[a, b], b)) for a in range(4)}
    plain = AlignConfig(scaler=None)
    pairs = screen.key_pairs(p, p)
    once = {(r.k1, r.k2): r.score for r in screen.distinct_scores(pairs, plain).collect()}
    many = {(r.k1, r.k2): r.score for r in pairs.withColumn("score", align.nw_score("seq1", "seq2", plain)).collect()}
    assert once == many
    assert {(r.k1, r.k2) for r in screen.pairs_reaching(pairs, plain, 8).collect()} == {k for k, v in many.items() if v >= 8}
    with pytest.raises(ValueError):
        screen.score_bound("a", "b", AlignConfig(free=DIMER_FREE))
    small = screen.key_pairs(p, p, broadcast_bytes=1)
    assert small.count() == 16


@pytest.mark.parametrize("free", [(False,) * 4, (True, False, False, True), (False, True, True, False)])
def test_rescoring_takes_any_callable(spark, free):
    def weight(left1, right1, left2, right2, **ends):
        return 0.5 + (left1 * 3 + right1 * 5 + left2 * 7 + right2 * 11) % 13 / 10 + ends["seq1_left_free"] - 0.25 * ends["seq2_right_free"]

    config = AlignConfig(free=free, scaler=weight)
    rng = random.Random(4)
    pairs = [tuple("".join(rng.choice("ACGT") for _ in range(rng.randint(0, 9))) for _ in range(2)) for _ in range(25)]
    df = spark.createDataFrame(pairs, "a string, b string").select(align.nw_align("a", "b", config).alias("r"))
    events = rescore.score_events("r.aligned1", "r.aligned2", config)
    rows = df.select("r.score", rescore.score_alignment("r.aligned1", "r.aligned2", config).alias("again"), rescore.total(events).alias("explained")).collect()
    for r in rows:
        assert r.again == pytest.approx(r.score) and r.explained == pytest.approx(r.score)


def test_long_alignments_are_scored_in_pieces(spark):
    """Gaps and letters on both sides of piece borders, against plain scoring of the path."""
    rng = random.Random(9)
    rows = []
    for size in (63, 64, 65, 128, 129, 1000):
        kinds = [rng.choice([0, 0, 0, 1, 1, 2]) for _ in range(size)]
        kinds[60:68] = [1] * len(kinds[60:68])
        a = "".join("-" if k == 1 else rng.choice("ACGT") for k in kinds)
        b = "".join("-" if k == 2 else rng.choice("ACGT") for k in kinds)
        rows.append((a, b, kinds))
    config = AlignConfig(free=(False, True, True, False))
    df = spark.createDataFrame([r[:2] for r in rows], "a string, b string")
    got = {r.a: (r.s, r.t) for r in df.select("a", rescore.score_alignment("a", "b", config).alias("s"), rescore.total(rescore.score_events("a", "b", config)).alias("t")).collect()}
    for a, b, kinds in rows:
        want = slow.path_score(config, a.replace("-", ""), b.replace("-", ""), kinds)
        assert got[a] == (pytest.approx(want), pytest.approx(want))


def test_free_energies_far_apart(spark):
    """Terms from -1e5 to 1e5: nothing overflows, the smallest energy decides."""
    rows = [("a", -1e5), ("a", 1e5), ("a", 0.0), ("b", 5.0), ("b", 5.0), (None, -3.0), ("c", 1e300)]
    got = {r.k: r.delta_g for r in thermo.delta_g_by_group(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    rt = thermo.GAS_CONSTANT * (37 + thermo.ZERO_CELSIUS)
    assert got == {"a": pytest.approx(-1e5), "b": pytest.approx(5 - rt * math.log(2)), None: pytest.approx(-3.0), "c": pytest.approx(1e300)}
    plan = thermo.delta_g_by_group(spark.createDataFrame(rows, "k string, v double"), ["k"], "v")._jdf.queryExecution().toString()
    assert "Join" not in plan

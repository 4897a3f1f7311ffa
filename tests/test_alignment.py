import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import slow
from strandloom.functions.batch import align_columns
from strandloom.functions.config import DIMER3_FREE, DIMER_FREE, DIRECTIONAL, INVERSE_DISTANCE, NON_COMP_SYMMETRIC, AlignConfig, ScoreMatrix, Scaler, flag_string, flags_of

BASES = st.text("ACGT", max_size=4)


def one(config, *seqs, traceback=True):
    return align_columns([pa.array([s]) for s in seqs], config, traceback).to_pylist()[0]


def test_documented_pair():
    got = one(AlignConfig(free=DIMER_FREE), "GAGATATGAGGAGAGAGAGACAGAGG", "GAACAGAGGGAGAGACTAACCTTG")
    assert got["aligned1"] == "GAGATATGAGGAGAGAGAGACAGAGG" + "-" * 15
    assert got["aligned2"] == "-" * 16 + "GA-ACAGAGGGAGAGACTAACCTTG"
    assert got["score"] == pytest.approx(8.97420634920635, abs=1e-12)


def test_documented_triple():
    got = one(AlignConfig(free=DIMER3_FREE), "CCTGCTACTCTGTTCCCTCAATCTGATAGGTTCC", "CCTGCTACTCTGTTCCTTCACATC", "CTGTTCCCTCAATCTGATAGGTTCC")
    assert got["aligned1"] == "CCTGCTACTCTGTTCCCTCA-ATCTGATAGGTTCC"
    assert got["aligned2"] == "CCTGCTACTCTGTTCCTTCACATC-----------"
    assert got["aligned3"] == "---------CTGTTCCCTCA-ATCTGATAGGTTCC"
    assert got["score"] == 108.0


@settings(max_examples=150, deadline=None)
@given(BASES, BASES, st.sampled_from(slow.FLAGS), st.sampled_from([None, INVERSE_DISTANCE, Scaler(1.25, 0.9), Scaler(0.0, 1.0)]), st.booleans(), st.sampled_from([(-5, -1), (-1, -1), (-6, -1.5), (-2.5, -3.0)]), st.sampled_from([AlignConfig().matrix, NON_COMP_SYMMETRIC, DIRECTIONAL]))
def test_all_paths(a, b, free, scaler, close, costs, matrix):
    config = AlignConfig(matrix, *costs, close, free, scaler)
    got = one(config, a, b)
    assert got["score"] == pytest.approx(slow.best(config, a, b), abs=1e-9)
    assert one(config, a, b, traceback=False) == got["score"]
    kinds = [1 if x == "-" else 2 if y == "-" else 0 for x, y in zip(got["aligned1"], got["aligned2"], strict=True)]
    assert (got["aligned1"].replace("-", ""), got["aligned2"].replace("-", "")) == (a, b)
    assert slow.path_score(config, a, b, kinds) == pytest.approx(got["score"], abs=1e-9)


@settings(max_examples=60, deadline=None)
@given(st.text("ACGT", max_size=3), st.text("ACGT", max_size=3), st.text("ACGT", max_size=2), st.lists(st.booleans(), min_size=6, max_size=6), st.booleans())
def test_all_paths_of_three(a, b, c, free, close):
    config = AlignConfig(NON_COMP_SYMMETRIC, free=tuple(free), gap_close=close)
    got = one(config, a, b, c)
    assert got["score"] == pytest.approx(slow.best3(config, (a, b, c)), abs=1e-9)
    assert one(config, a, b, c, traceback=False) == got["score"]
    rows = [got[f"aligned{k}"] for k in (1, 2, 3)]
    assert [r.replace("-", "") for r in rows] == [a, b, c]
    kinds = [sum(1 << s for s in range(3) if rows[s][k] == "-") for k in range(len(rows[0]))]
    assert slow.path_score3(config, (a, b, c), kinds) == pytest.approx(got["score"], abs=1e-9)


def test_swap_and_reversal():
    rng = random.Random(20260313)
    text = lambda: "".join(rng.choice("ACGT") for _ in range(rng.randint(8, 32)))
    for free in slow.FLAGS:
        a, b = text(), text()
        for scaler in (None, INVERSE_DISTANCE):
            c = AlignConfig(free=free, scaler=scaler)
            score = one(c, a, b)["score"]
            assert one(c.but(free=free[2:] + free[:2]), b, a)["score"] == pytest.approx(score, abs=1e-9)
            assert one(c.but(free=(free[1], free[0], free[3], free[2])), a[::-1], b[::-1])["score"] == pytest.approx(score, abs=1e-9)


def test_close_penalty_only_moves_costs_when_unscaled():
    rng = random.Random(1)
    for free in slow.FLAGS:
        a, b = ("".join(rng.choice("ACGT") for _ in range(12)) for _ in range(2))
        on = one(AlignConfig(free=free, scaler=None), a, b)["score"]
        assert one(AlignConfig(free=free, scaler=None, gap_close=False), a, b)["score"] == pytest.approx(on)
    empty = AlignConfig(free=(True, False, False, False), scaler=None)
    assert one(empty, "", "AC")["score"] == -2.0
    assert one(empty.but(gap_close=False), "", "AC")["score"] == 0.0


def test_ties_follow_the_order_of_kinds():
    assert one(AlignConfig(scaler=None, gap_open=-1), "A", "C") == {"aligned1": "A", "aligned2": "C", "score": -1.0}
    assert one(AlignConfig(scaler=None, free=(True,) * 4), "A", "C") == {"aligned1": "A-", "aligned2": "-C", "score": 0.0}


def test_batches_keep_order_and_nulls():
    a, b = ["ACGT", None, "", "ac", "ACGTT"], ["ACG", "A", "", "AC", None]
    got = align_columns([pa.array(a), pa.array(b)], AlignConfig(scaler=None), True).to_pylist()
    assert got[1] is None and got[4] is None
    assert got[2] == {"aligned1": "", "aligned2": "", "score": 0.0}
    assert got[3]["score"] == 4.0 and got[3]["aligned1"] == "AC"
    assert got[0]["aligned1"] == "ACGT"
    sliced = align_columns([pa.array(["X", *a]).slice(1), pa.array(["X", *b]).slice(1)], AlignConfig(scaler=None), False)
    assert sliced.to_pylist()[3] == 4.0


def test_guards():
    with pytest.raises(ValueError, match="no entry"):
        one(AlignConfig(), "AN", "AC")
    assert one(AlignConfig(ScoreMatrix.simple(on_missing="zero"), scaler=None), "N", "A")["score"] == 0.0
    with pytest.raises(ValueError, match="ASCII"):
        one(AlignConfig(), "É", "A")
    with pytest.raises(ValueError, match="temperature"):
        Scaler(1.0, 0.0)
    with pytest.raises(ValueError, match="flags"):
        AlignConfig(free=(True,))
    with pytest.raises(ValueError, match="six|6"):
        align_columns([pa.array(["A"])] * 3, AlignConfig(), False)


def test_decay_zero_counts_flags():
    assert Scaler(0.0)(3, 4, 5, 6, seq1_left_free=True, seq1_right_free=False, seq2_left_free=True, seq2_right_free=True) == 3
    assert INVERSE_DISTANCE(0, 0, 0, 0, seq1_left_free=False, seq1_right_free=False, seq2_left_free=False, seq2_right_free=False) == 1.0


def test_any_callable_scales():
    halves = lambda a, b, c, d, **flags: 0.5
    assert one(AlignConfig(scaler=halves), "ACGT", "ACGT")["score"] == 4.0


def test_flag_strings():
    assert flag_string(flags_of("0110")) == "0110"


def test_matrix_predicates():
    assert AlignConfig().matrix.transpose_symmetric() and AlignConfig().matrix.complement_symmetric()
    assert NON_COMP_SYMMETRIC.transpose_symmetric() and not NON_COMP_SYMMETRIC.complement_symmetric()
    assert not DIRECTIONAL.transpose_symmetric()


def test_long_sequences_fit():
    rng = random.Random(2)
    a, b = ("".join(rng.choice("ACGT") for _ in range(700)) for _ in range(2))
    got = one(AlignConfig(scaler=None), a, b)
    assert got["aligned1"].replace("-", "") == a and got["aligned2"].replace("-", "") == b

import hashlib
import random

import llm_cases as cases
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.llm import grouping_sort, suffix_dedup


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array(symbols):
    order = grouping_sort.suffix_array(symbols)
    assert order == sorted(range(len(symbols)), key=lambda k: symbols[k:])
    shares = grouping_sort.common_prefixes(symbols, order)
    for k in range(1, len(order)):
        a, b = symbols[order[k - 1] :], symbols[order[k] :]
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert shares[k] == n


@pytest.mark.parametrize("symbols", [[1] * 3000, [1, 2] * 1500, list(range(3000)), list(range(3000, 0, -1)), [k % 7 for k in range(3000)]])
def test_regular_texts(symbols):
    assert grouping_sort.suffix_array(symbols) == sorted(range(len(symbols)), key=lambda k: symbols[k:])


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=300), st.sampled_from([(20, 8), (40, 20), (20, 13)]))
def test_anchors_cover_all_starts(data, shape):
    length, reach = shape
    data = data.replace(b"\x00", b"ab")
    found = suffix_dedup.anchors(data, length, reach)
    at = 0
    for anchor, first, last in found:
        assert first == at and first <= last <= anchor < first + reach
        at = last + 1
    assert at == max(0, len(data) - length + 1)


def test_anchors_in_parts(monkeypatch):
    data = bytes(random.Random(1).choices(b"abcd", k=2000)) + b"a" * 500
    want = suffix_dedup.anchors(data, 40, 20)
    monkeypatch.setattr(suffix_dedup, "_PART", 300)
    assert suffix_dedup.anchors(data, 40, 20) == want


def texts(seed):
    rng = random.Random(seed)
    line = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    shared, rare = line(90), line(45)
    out = []
    for k in range(60):
        parts = [line(rng.randint(0, 120))]
        if k % 3 == 0:
            parts.append(shared)
        if k % 7 == 0:
            parts.append(shared[rng.randint(0, 40) : rng.randint(50, 90)])
        if k % 5 == 0:
            parts += [rare] * 2
        rng.shuffle(parts)
        out.append("".join([*parts, line(rng.randint(0, 50))]))
    edited = out[0][:20] + "X" + out[0][20:]
    return [*out, out[1], out[1], edited, "z" * 300, "z" * 290, "ab" * 100, None, "", "short"]


def rows(seed):
    own = texts(seed)
    out = [(k, t, "en", "s") for k, t in enumerate(own)]
    return [*out, (5, own[5], "en", "s"), (None, own[6], "en", "s")]


def check(spark, data, **how):
    got = suffix_dedup.remove_repeats(cases.table(spark, data), **how).collect()
    want = [(d, len((t or "").encode()), len((t or "").encode()) - len(kept), spans, hashlib.sha256(kept).hexdigest()) for (d, t, *_), (kept, spans) in zip(data, cases.stripped([r[1] for r in data], how.get("length", 400)), strict=True)]
    assert cases.same([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got], want)
    return got


@pytest.mark.parametrize("length,reach", [(40, 20), (64, 40)])
def test_against_all_strings(spark, length, reach):
    check(spark, rows(length), length=length, reach=reach)


def test_crowded_anchors(spark):
    check(spark, rows(3), length=40, reach=20, crowd=1)


def test_production_parameters(spark):
    data = cases.awkward()
    got = check(spark, data)
    assert any(r.n_removed for r in got)
    assert all(bytes(r.kept) == b"" or hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got if r.kept is not None)


def test_empty(spark):
    assert suffix_dedup.remove_repeats(cases.empty(spark)).count() == 0
    check(spark, [(1, None, "en", "s"), (2, "", "en", "s"), (3, "short", "en", "s")])


def test_fingerprints():
    data = bytes(random.Random(0).choices(range(256), k=500))
    prints = suffix_dedup.Fingerprints(data + data)
    at = np.arange(400)
    assert (prints.of(at, 100) == prints.of(at + 500, 100)).all() and len(set(prints.of(at, 100).tolist())) == 400

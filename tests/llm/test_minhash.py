import random

import llm_cases as cases
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.llm import graph, minhash


def groups(rows, seed):
    """rows with families of near copies at all similarities."""
    rng = random.Random(seed)
    pool = cases.pool(rng, "abcdefghinorst", 2000)
    out = list(rows)
    n = 1000
    for family in range(12):
        base = cases.words(rng, rng.randint(5, 150), pool)
        for copy in range(8):
            own = base[:]
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                own[rng.randrange(len(own))] = rng.choice(pool)
            out.append((n, " ".join(own), "en", "s"))
            n += 1
    return out


@pytest.mark.parametrize("size,percent", [(4, 80), (5, 80), (2, 60)])
def test_against_all_pairs(spark, size, percent):
    rows = groups(cases.awkward(), 7)
    got = minhash.near_duplicates(cases.table(spark, rows), shingle=size, percent=percent).collect()
    assert cases.same(got, cases.components(rows, size, percent))


def test_hot_families_without_a_hub(spark):
    """A chain of copies, each a few edits from the last: every bucket holds several components at first."""
    rng = random.Random(2)
    pool = cases.pool(rng, "abcdefghinorst", 5000)
    own, rows = cases.words(rng, 60, pool), []
    for k in range(120):
        own = own[:]
        own[rng.randrange(60)] = rng.choice(pool)
        rows.append((k, " ".join(own), "en", "s"))
    got = minhash.near_duplicates(cases.table(spark, rows)).collect()
    assert cases.same(got, cases.components(rows))


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(0)
    for n, share in ((3, 1), (40, 30), (2000, 1500)):
        agree = []
        for _ in range(40):
            x = rng.integers(0, 1 << 62, 2 * n - share).astype(np.uint64)
            a, b = minhash.sketch(np.unique(x[:n])), minhash.sketch(np.unique(x[n - share :]))
            agree.append((a == b).mean())
        assert np.mean(agree) == pytest.approx(share / (2 * n - share), abs=0.06)


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 400), st.integers(0, 1 << 30))
def test_every_coordinate_is_filled_alike(n, seed):
    x = np.unique(np.random.default_rng(seed).integers(0, 1 << 62, n).astype(np.uint64))
    a = minhash.sketch(x)
    assert len(a) == 128 and (a != 0).all() and (a == minhash.sketch(x[::-1].copy())).all()


def test_rare_items_of_similar_sets_meet(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(30):
        x = rng.integers(0, 1 << 62, 50).astype(np.uint64)
        y = x.copy()
        y[: rng.integers(0, 6)] = rng.integers(0, 1 << 62)
        rows += [(2 * k, np.unique(x).tobytes()), (2 * k + 1, np.unique(y).tobytes())]
    sets = spark.createDataFrame([(c, c, bytearray(b)) for c, b in rows], "cid long, root long, items binary")
    rare = {}
    for r in minhash.rare_items(sets, 80).collect():
        rare.setdefault(r.cid, {})[r.item] = (r.pos, r.n)
    for k in range(30):
        x, y = ({*np.frombuffer(b, np.uint64)} for _, b in rows[2 * k : 2 * k + 2])
        if len(x & y) >= 0.8 * len(x | y):
            shared = rare[2 * k].keys() & rare[2 * k + 1].keys()
            assert shared
            i, j = min((rare[2 * k][s][0], rare[2 * k + 1][s][0]) for s in shared)
            assert 1.8 * min(len(x) - i, len(y) - j) >= 0.8 * (len(x) + len(y))


def test_classes_of_one_component_never_meet(spark):
    """An item that 3,000 classes of one component and two of another share gives 6,000 pairs, not millions."""
    rows = [(k, 0, 50, 0, 7) for k in range(3000)] + [(5000 + k, 5000, 50, 0, 7) for k in range(2)] + [(9000, 9000, 500, 0, 7), (9001, 9001, 50, 49, 7), (1, 0, 50, 1, 8)]
    rare = spark.createDataFrame(rows, "cid long, root long, n long, pos long, item long")
    between = minhash.between_roots(rare, 80)
    got = {(r.a, r.b) for r in between.collect()}
    assert got == {(k, 5000 + j) for k in range(3000) for j in range(2)}
    joined = between._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in joined and "NestedLoop" not in joined


def test_item_counts(spark):
    rng = np.random.default_rng(5)
    sets = [rng.integers(0, 1 << 62, 40).astype(np.uint64) for _ in range(50)]
    df = spark.createDataFrame([(bytearray(x.tobytes()),) for x in sets], "items binary").repartition(7)
    want = np.bincount((np.concatenate(sets) % np.uint64(1 << 12)).astype(np.int64), minlength=1 << 12)
    assert (minhash.item_counts(df, 1 << 12) == want).all()


def test_one_of_each_group_stays_however_rows_are_joined(spark, monkeypatch):
    docs = cases.table(spark)
    want = [(r.doc_id, r.text) for r in minhash.keep_one(docs, shingle=5).collect()]
    monkeypatch.setattr(minhash, "SENT_ROWS", 0)
    assert cases.same(want, [(r.doc_id, r.text) for r in minhash.keep_one(docs, shingle=5).collect()])


def test_components(spark):
    rng = random.Random(4)
    for edges in ([], [(1, 1)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 30)], [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]):
        parent = list(range(100))

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
        got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_one_of_each_group_stays(spark):
    rows = cases.awkward()
    docs = cases.table(spark, rows)
    kept = minhash.keep_one(docs, shingle=5)
    assert kept.columns == docs.columns
    want = {(d, t) for (d, t, *_), (_, _, c, k) in zip(rows, cases.components(rows, 5), strict=True) if k or (d is None and c is None)}
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_empty(spark):
    assert minhash.near_duplicates(cases.empty(spark)).count() == 0 and minhash.keep_one(cases.empty(spark)).count() == 0
    blank = [(1, "", "en", "s"), (2, None, "en", "s"), (3, "  ", "en", "s")]
    assert cases.same(minhash.near_duplicates(cases.table(spark, blank)).collect(), [(k, 0, k, True) for k in (1, 2, 3)])

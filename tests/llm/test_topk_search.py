import numpy as np
import pytest
from pyspark.sql import functions as F

import llm_cases as cases
from strandloom.llm import topk_search

SCHEMA = "vec_id long, embedding array<float>, label int, " + ", ".join(f"`{c}` string" for c in [*cases.CLASHING, "row_", "v", "id_", "region", "block", "query_block", "query_row", "bound", "group", "floors", "vec", "is_query"] if c not in ("label",))


def vectors(spark, rows):
    width = SCHEMA.count(",") - 2
    return spark.createDataFrame([(i, v, 0, *["x"] * width) for i, v in rows], SCHEMA).repartition(3)


def brute(rows, modulus, k=5):
    good = [(i, np.floor(256 * np.array(np.array(v, np.float32), np.float64)).astype(np.int64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for row, (q, a) in enumerate(good):
        if q % modulus == 0:
            found = sorted((-int(a @ b), i) for other, (i, b) in enumerate(good) if other != row and len(b) == len(a))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found[:k])]
    return out


def clustered(n, d, seed, spread=0.1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, d))
    return [(k, (centres[k % 8] + spread * rng.normal(size=d)).astype(np.float32).tolist()) for k in range(n)]


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_against_brute_force(spark, spread):
    rows = clustered(700, 12, 1, spread)
    rows += [(1000 + k, rows[3][1]) for k in range(200)]  # copies: ties go to the smaller id
    got = topk_search.top_k(vectors(spark, rows), F.col("vec_id") % 25 == 0, query_rows=20, data_rows=150)
    assert cases.same(got.collect(), brute(rows, 25))


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [2.0, 2.0]), (10, [2.0, 2.0]), (10, [0.0, 0.5]), (None, [9.0, 9.0]), (20, [1.0]), (21, [3.0]), (22, []), (30, [0.0, 0.0]), (30, [0.0, 0.0]), (7, [-0.001, 0.001])]
    got = topk_search.top_k(vectors(spark, rows), F.col("vec_id") % 10 == 0)
    assert cases.same(got.collect(), brute(rows, 10))


def test_rows_that_repeat_a_query_id(spark):
    """Every query row has a list of its own, whose candidates include the other rows of its id."""
    rows = [(50, [1.0, 0.0]), (50, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [2.0, 0.5]), (2, [1.5, 2.0]), (3, [0.5, 0.5]), (4, [3.0, -1.0])]
    got = topk_search.top_k(vectors(spark, rows), F.col("vec_id") % 50 == 0).collect()
    assert len(got) == 15 and cases.same(got, brute(rows, 50))


def test_small_blocks_and_few_centres(spark, monkeypatch):
    """Many blocks, a region that holds a third of all rows, bounds that leave most pairs of blocks out."""
    monkeypatch.setattr(topk_search, "TOGETHER", 2)
    monkeypatch.setattr(topk_search, "ROOTS", 3)
    rows = clustered(400, 6, 9, 0.02) + [(1000 + k, [0.1] * 6) for k in range(200)]
    got = topk_search.top_k(vectors(spark, rows), F.col("vec_id") % 20 == 0, query_rows=5, data_rows=30)
    assert cases.same(got.collect(), brute(rows, 20))


def test_fewer_rows_than_asked(spark):
    assert topk_search.top_k(vectors(spark, [(0, [1.0]), (1, [2.0])]), F.col("vec_id") % 50 == 0).collect() == [(0, 1, 1, 131072)]
    assert topk_search.top_k(vectors(spark, []), F.col("vec_id") % 50 == 0).count() == 0


def tree_of(points, ids=None, **how):
    ids = np.arange(len(points)) if ids is None else ids
    return topk_search.Tree(ids, ids, points, **how)


def test_large_scores_are_exact():
    rng = np.random.default_rng(0)
    points = rng.integers(-(2**29), 2**29, (90, 6))
    tree, asked = tree_of(points), tree_of(points[:5])
    ids, scores = topk_search.search(asked, tree, 3)
    for row, q in enumerate(asked.ids):
        want = sorted((-sum(int(x) * int(y) for x, y in zip(points[q], p, strict=True)), i) for i, p in enumerate(points) if i != q)[:3]
        assert list(zip(-scores[row], ids[row], strict=True)) == want


def test_terms_that_cancel():
    """Scores are small, their terms large: bounds leave room for the rounding of products."""
    rng = np.random.default_rng(6)
    for _ in range(20):
        half = rng.integers(-(10**8), 10**8, (300, 3))
        points = np.concatenate([half, -half + rng.integers(-2, 3, half.shape)], axis=1)
        asked = np.concatenate([points[:20, :3], points[:20, :3]], axis=1)
        queries = tree_of(asked, np.arange(1000, 1020))
        ids, scores = topk_search.search(queries, tree_of(points), 4)
        for row, q in enumerate(queries.ids):
            want = sorted((-sum(int(x) * int(y) for x, y in zip(asked[q - 1000], p, strict=True)), i) for i, p in enumerate(points))[:4]
            assert list(zip(-scores[row], ids[row], strict=True)) == want


@pytest.mark.parametrize("seed", range(6))
def test_searches_equal_plain_products(seed):
    rng = np.random.default_rng(seed)
    d, n = int(rng.integers(1, 9)), int(rng.integers(2, 900))
    centres = rng.normal(size=(5, d)) * 300
    points = (centres[rng.integers(0, 5, n)] + rng.normal(size=(n, d)) * rng.choice([0, 1, 30, 300])).astype(np.int64)
    m = min(n, 70)
    queries = tree_of(points[:m], leaf=8)
    ids, scores = topk_search.search(queries, tree_of(points, leaf=8), 5)
    for row, q in enumerate(queries.ids):
        want = sorted((-int(points[q] @ p), i) for i, p in enumerate(points) if i != q)[:5]
        assert list(zip(-scores[row], ids[row], strict=True))[: len(want)] == want and (ids[row][len(want) :] == -1).all()


@pytest.mark.parametrize("spread", [3, 200])
def test_tree_covers_and_separates(spread):
    rng = np.random.default_rng(2)
    points = rng.integers(-500, 500, (12, 5))[rng.integers(0, 12, 1500)] + rng.integers(-spread, spread, (1500, 5))
    tree = tree_of(points, leaf=16)
    assert tree.kids.max() > 0
    for v in range(len(tree.low)):
        own = tree.points[tree.low[v] : tree.high[v]].astype(float)
        centre = tree.points[tree.centre[v]].astype(float)
        assert tree.low[v] <= tree.centre[v] < tree.high[v]
        assert np.sqrt(((own - centre) ** 2).sum(axis=1)).max() <= tree.radius[v] + 1e-6
        if n := tree.kids[v]:
            kids = range(tree.first[v], tree.first[v] + n)
            assert [tree.low[k] for k in kids] == [tree.low[v], *[tree.high[k] for k in kids][:-1]] and tree.high[kids[-1]] == tree.high[v]
            heads = tree.points[tree.centre[list(kids)]].astype(float)
            apart = np.sqrt(((heads[:, None] - heads[None]) ** 2).sum(axis=2))
            assert (apart[~np.eye(n, dtype=bool)] > tree.radius[v] / 2 - 1e-3).all()  # separation
            assert all(tree.radius[k] <= tree.radius[v] / 2 + 1e-3 for k in kids)  # covering: however many children that takes
            assert tree.centre[v] in tree.centre[list(kids)]  # nesting
    assert sorted(tree.ids) == list(range(1500))


def test_pruning_saves_work(monkeypatch):
    rows = clustered(3000, 8, 4, 0.02)
    points = np.floor(256 * np.array([v for _, v in rows])).astype(np.int64)
    seen = []
    real = topk_search._products
    monkeypatch.setattr(topk_search, "_products", lambda q, c, e: seen.append(len(q) * len(c)) or real(q, c, e))
    topk_search.search(tree_of(points[:60]), tree_of(points), 5)
    assert sum(seen) < 0.5 * 60 * 3000


def test_blocks_out_of_reach_are_not_searched(spark, monkeypatch):
    """Root bounds leave out the clusters that lie the other way."""
    rows = [(k, [float(x) for x in (np.array([8.0, 0, 0]) if k % 4 == 0 else np.array([-8.0, k % 3, 0])) + 0.01 * np.random.default_rng(k).normal(size=3)]) for k in range(600)]
    seen, every = [], []
    searched, paired = topk_search._searched, topk_search.root_pairs
    monkeypatch.setattr(topk_search, "_searched", lambda pairs, *a: seen.append(pairs.count()) or searched(pairs, *a))
    monkeypatch.setattr(topk_search, "root_pairs", lambda *a: every.append(paired(*a).count()) or paired(*a))
    got = topk_search.top_k(vectors(spark, rows), F.col("vec_id") % 60 == 0, query_rows=10, data_rows=40)
    assert cases.same(got.collect(), brute(rows, 60)) and sum(seen) < 0.6 * sum(every)


def test_plan_moves_no_pairs_of_trees(spark, monkeypatch):
    """Trees meet by cogroup, one data tree a group; no join is without a key that tells blocks apart."""
    plans = []
    for name in ("_searched", "root_pairs"):
        real = getattr(topk_search, name)

        def keep(*a, real=real):
            plans.append((out := real(*a))._jdf.queryExecution().executedPlan().toString())
            return out

        monkeypatch.setattr(topk_search, name, keep)
    topk_search.top_k(vectors(spark, clustered(300, 4, 3)), F.col("vec_id") % 20 == 0, query_rows=5, data_rows=50)
    assert len(plans) == 3 and not any("Cartesian" in p or "NestedLoop" in p for p in plans)
    assert sum("FlatMapCoGroupsInArrow" in p for p in plans) == 2

import math
from collections import Counter

import llm_cases as cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import hpy_lm


def base(rows):
    count = Counter()
    for doc_id, text, *_ in rows:
        if not cases.held(doc_id, 7, 2):
            count.update([*cases.tokens(text), b""])
    n, v = sum(count.values()), len(count)
    out = []
    for doc_id, text, *_ in rows:
        own = [*cases.tokens(text), b""]
        out.append((doc_id, cases.held(doc_id, 7, 2), len(own), sum(count[w] > 0 for w in own), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own)))
    return out


def check(got, rows):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[3], r[5])
    left = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=key)
    right = sorted(base(rows), key=key)
    assert len(left) == len(right)
    for a, b in zip(left, right, strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)


def small(monkeypatch, **values):
    for name, value in values.items():
        monkeypatch.setattr(hpy_lm, name, value)


def test_counts_and_base_score(spark):
    rows = cases.awkward()
    got = hpy_lm.score_held_out(cases.table(spark, rows)).collect()
    check(got, rows)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_many_chunks_buckets_and_parts(spark, monkeypatch):
    """Frequent endings and words are split, words meet in many buckets: counts stay exact, scores nearly the same."""
    rows = cases.awkward()
    whole = sum(r.score for r in hpy_lm.score_held_out(cases.table(spark, rows)).collect())
    small(monkeypatch, CHUNK_TOKENS=500, WORD_BYTES=20_000, BUCKET_TOKENS=6000, PART=2000)
    got = hpy_lm.score_held_out(cases.table(spark, rows)).collect()
    check(got, rows)
    assert sum(r.score for r in got) == pytest.approx(whole, rel=0.1)


def seatings(customers):
    """All ways to seat customers, as lists of table sizes."""
    out = [[]]
    for _ in range(customers):
        out = [s for o in out for s in [*([*o[:k], o[k] + 1, *o[k + 1 :]] for k in range(len(o))), [*o, 1]]]
    return out


def exact_tables(customers, parent, others, discount, strength):
    """Distribution of a dish's tables given all others of its restaurant, by all seatings."""
    weight = Counter()
    for s in seatings(customers):
        w = math.prod(math.prod(k - discount for k in range(1, n)) for n in s) * parent ** len(s)
        weight[len(s)] += w * math.prod(strength + discount * (others + k) for k in range(len(s)))
    return np.array([weight[t] for t in range(1, customers + 1)]) / sum(weight.values())


def test_stirling_numbers():
    for d in (0.05, 0.5, 0.8):
        for c in range(1, 8):
            by = Counter()
            for s in seatings(c):
                by[len(s)] += math.prod(math.prod(k - d for k in range(1, n)) for n in s)
            assert hpy_lm.stirling(d)[c, 1 : c + 1] == pytest.approx(np.log([by[t] for t in range(1, c + 1)]))


@pytest.mark.parametrize("customers,parent,others,discount,strength", [(2, 0.3, 4, 0.5, 1.0), (5, 0.2, 10, 0.7, 3.0), (7, 0.9, 0, 0.1, 20.0)])
def test_tables_are_drawn_from_their_conditional(customers, parent, others, discount, strength):
    n = 60_000
    got = hpy_lm.draw_tables(np.full(n, customers), np.full(n, parent), np.full(n, others), discount, strength, np.random.default_rng(1))
    want = exact_tables(customers, parent, others, discount, strength)
    assert np.bincount(got, minlength=customers + 1)[1:] / n == pytest.approx(want, abs=0.01)


def test_single_customers_reach_the_same_distribution():
    """Dishes of eight customers in a crowd, moved one by one, whatever the first seating; the openings follow the dish's own tables."""
    n, customers, parent, others, discount, strength = 4000, 8, 0.25, 6, 0.6, 2.0
    rng = np.random.default_rng(2)
    crowd = hpy_lm.Crowd(np.full(n, customers), np.full(n, 0.5), discount, rng)
    assert (crowd.tables >= 1).all() and crowd.sizes().sum() == n * customers
    for _ in range(60):
        gone = crowd.tables.copy()
        crowd.move((strength + discount * (others + gone)) * parent, discount)
    assert crowd.sizes().sum() == n * customers and (np.add.reduceat((crowd.size > 0).astype(int), crowd.start[:-1]) == crowd.tables).all()
    want = exact_tables(customers, parent, others, discount, strength)
    got = np.bincount(crowd.tables, minlength=customers + 1)[1:] / n
    assert got @ np.arange(1, 9) == pytest.approx(want @ np.arange(1, 9), rel=0.06)


def bucket_of_pairs(seed, words=25, contexts=12, groups=3, most=90):
    """Every word asked for in every context, some of them seen."""
    rng = np.random.default_rng(seed)
    of_context = np.sort(rng.integers(0, groups, contexts))
    context, word = (x.ravel() for x in np.meshgrid(np.arange(contexts), np.arange(words), indexing="ij"))
    count = np.where(rng.random(len(word)) < 0.4, rng.integers(1, most, len(word)), 0)
    dishes, dish = np.unique(of_context[context] * words + word, return_inverse=True)
    return of_context, context, word, count, dishes // words, dish, dishes % words


def test_probabilities_sum_to_one():
    of_context, context, word, count, group, dish, dish_word = bucket_of_pairs(0)
    served = np.bincount(word, weights=count, minlength=25) > 0
    k = np.bincount(dish_word, weights=np.bincount(dish, weights=count, minlength=len(group)) > 0, minlength=25)
    root = hpy_lm.Root(0.4, 2.0, int(served.sum()), int(k.sum()))
    p0 = root.probability(k)
    unknown = float(root.probability(np.zeros(1))[0])
    assert p0[served].sum() + unknown == pytest.approx(1)
    share, weight, tables, _ = hpy_lm.sample(group, of_context, context, dish, count, p0[dish_word], np.ones(3, np.int64), np.zeros(12, np.int64), np.random.default_rng(1))
    p = share + weight[context] * p0[word]
    for u in range(12):
        own = context == u
        assert p[own][served[word[own]]].sum() + weight[u] * unknown == pytest.approx(1)
    assert (tables <= np.bincount(dish, weights=count, minlength=len(group))).all()


def test_predictions_follow_the_seating():
    """Share and weight against the formula with loops, one sweep kept."""
    of_context, context, word, count, group, dish, dish_word = bucket_of_pairs(3)
    p0 = np.full(len(group), 0.02)
    kept = []
    real = hpy_lm.Level.parts

    class Watched(hpy_lm.Level):
        def parts(self):
            kept.append((self.customers.copy(), self.tables.copy(), self.owner, self.discount, self.strength))
            return real(self)

    import unittest.mock

    with unittest.mock.patch.object(hpy_lm, "Level", Watched):
        share, weight, _, _ = hpy_lm.sample(group, of_context, context, dish, count, p0, np.ones(3, np.int64), np.zeros(12, np.int64), np.random.default_rng(1), sweeps=1, burn_in=0)
    (k, s, g, d2, s2), (c, t, u, d, strength) = kept[-2:]
    for i in range(len(count)):
        own = u == u[i]
        above = g == g[dish[i]]
        parent = (max(k[dish[i]] - d2 * s[dish[i]], 0) + (s2 + d2 * s[above].sum()) * 0.02) / (s2 + k[above].sum())
        want = (max(c[i] - d * t[i], 0) + (strength + d * t[own].sum()) * parent) / (strength + c[own].sum())
        assert share[i] + weight[context[i]] * 0.02 == pytest.approx(want)
    assert (k == np.bincount(dish, weights=t, minlength=len(group))).all() and (t[c > 0] >= 1).all() and (t <= c).all()


def test_parameters_are_learned():
    """Counts drawn from a restaurant with known parameters give them back."""
    rng = np.random.default_rng(5)
    owner, customers, tables = [], [], []
    for restaurant in range(300):
        sizes = []
        for n in range(200):
            draw = rng.random() * (n + 5.0)
            if draw < 5.0 + 0.6 * len(sizes):
                sizes.append(1)
            else:
                draw -= 5.0 + 0.6 * len(sizes)
                sizes[int(np.searchsorted(np.cumsum(np.array(sizes) - 0.6), draw))] += 1
        owner += [restaurant] * len(sizes)
        customers += sizes
        tables += [1] * len(sizes)
    level = hpy_lm.Level(np.array(customers), np.array(owner), np.ones(300, np.int64), None, 0.5, 1.0, rng)
    level.tables = np.array(tables)
    level.crowd = hpy_lm.Crowd(level.customers[level.customers > hpy_lm.LARGE], np.full((level.customers > hpy_lm.LARGE).sum(), 1e-12), 0.5, rng)
    for _ in range(5):
        level.learn()
    assert level.discount == pytest.approx(0.6, abs=0.06) and 3 < level.strength < 8
    k, n = np.unique(customers, return_counts=True)
    assert 0.4 < hpy_lm.fit_root(k.astype(float), n.astype(float))[0] <= 0.95
    assert hpy_lm.log_gamma(np.array([0.3, 1.0, 4.5, 1e6])) == pytest.approx([math.lgamma(x) for x in (0.3, 1.0, 4.5, 1e6)], abs=1e-8)


def test_pairs_that_were_seen_score_more(spark):
    """A held-out text that training texts hold, against one of the same words in another order."""
    import random

    rng = random.Random(6)
    pool = cases.pool(rng, "abcdefgh", 300)
    texts = {k: " ".join(cases.words(rng, 60, pool)) for k in range(200) if not cases.held(k, 7, 2)}
    asked = [k for k in range(200, 240) if cases.held(k, 7, 2)]
    first = next(iter(texts.values()))
    shuffled = first.split()
    rng.shuffle(shuffled)
    copies = [k for k in range(300, 320) if not cases.held(k, 7, 2)]
    rows = [(k, t, "en", "s") for k, t in texts.items()] + [(k, first, "en", "s") for k in copies] + [(asked[0], first, "en", "s"), (asked[1], " ".join(shuffled), "en", "s")]
    got = {r.doc_id: r for r in hpy_lm.score_held_out(cases.table(spark, rows)).collect()}
    assert got[asked[0]].score > got[asked[1]].score + 20 and got[asked[0]].base_score == pytest.approx(got[asked[1]].base_score)


def test_better_than_the_base_on_held_out_texts(spark, sf_dir):
    scores = hpy_lm.score_held_out(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    got = {r.held_out: r for r in hpy_lm.perplexity(scores).collect()}
    assert got[True].perplexity < 0.5 * got[True].base_perplexity and got[False].perplexity < got[False].base_perplexity


def test_edges(spark):
    assert hpy_lm.score_held_out(cases.empty(spark)).count() == 0
    nothing = hpy_lm.score_documents(cases.table(spark, [(1, "all held out", "en", "s"), (2, None, "en", "s")]), F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.base_score == 0 and r.n_known == 0 and r.score <= 0 for r in nothing)
    assert sorted(r.n_tokens for r in nothing) == [1, 4]

import llm_cases as cases
import numpy as np

from strandloom.llm import quality


def corpus(seed=3):
    import random

    rng = random.Random(seed)
    good, bad = cases.pool(rng, "abcdefghilmnorstu"), [w.upper() + "!!" for w in cases.pool(rng, "abcdefghilmnorstu")]
    rows = [(k, " ".join(cases.words(rng, 60, bad if k % 5 == 0 else good)), "en", "s") for k in range(200)]
    labels = [(k, 0 if k % 5 == 0 else 1, 0) for k in range(0, 200, 2)]
    return rows, labels


def label_table(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_rejects_junk_and_keeps_the_rest(spark):
    rows, labels = corpus()
    got = {r.id: r for r in quality.resample(cases.table(spark, rows), label_table(spark, labels)).collect()}
    assert len(got) == 200
    assert sum(got[k].kept for k in range(200) if k % 5) >= 158  # of 160 good ones
    assert sum(got[k].kept for k in range(0, 200, 5)) <= 2  # of 40 junk ones


def test_weights_against_plain_sums(spark):
    rows, labels = corpus()
    good = {d for d, q, _ in labels if q}
    raw, target = np.zeros(quality.BUCKETS + 1), np.zeros(quality.BUCKETS + 1)
    grams = {d: quality.gram_buckets(t.encode()) for d, t, *_ in rows}
    for d, g in grams.items():
        np.add.at(raw, g, 1)
        if d in good:
            np.add.at(target, g, 1)
    ratio = np.log((target + quality.PRIOR) / (target.sum() * raw / raw.sum() + quality.PRIOR))
    for r in quality.resample(cases.table(spark, rows), label_table(spark, labels)).collect():
        assert abs(r.log_weight - ratio[grams[r.id]].sum()) < 1e-6 and r.n_grams == len(grams[r.id])


def test_sample_is_the_k_largest(spark):
    rows, labels = corpus()
    docs = cases.table(spark, rows)
    _, scored, cut = quality.draw(docs, label_table(spark, labels))
    keys = sorted((r.key for r in scored.collect()), reverse=True)
    k = sum(x >= cut for x in keys)
    for n in (1, 7, k, 200):
        assert quality.kth_largest(scored, "key", n) == keys[n - 1]
    kept = quality.keep_good(docs, label_table(spark, labels))
    assert kept.columns == docs.columns and kept.count() == k
    assert {r.doc_id for r in kept.collect()} == {r.id for r in scored.collect() if r.key >= cut}


def test_trigrams():
    assert len(quality.gram_buckets(b"")) == len(quality.gram_buckets(b"ab")) == 0
    assert len(quality.gram_buckets(b"abcd")) == 2
    assert (quality.gram_buckets(b"aa aa aa") == quality.BUCKETS).sum() == 6


def test_edges(spark):
    labels = label_table(spark, [(0, 1, 0), (1, 1, None), (2, 0, 0), (3, None, 0), (None, 1, 0), (0, 1, 0)])
    docs = cases.table(spark)
    got = quality.resample(docs, labels).collect()
    assert len(got) == len(cases.awkward())
    assert {r.id for r in got if r.n_grams == 0} == {32, 33} and not any(r.kept for r in got if r.n_grams == 0)
    assert len({r.kept for r in got if r.id == 30}) == 1
    unlabelled = quality.keep_good(docs, label_table(spark, []))
    assert unlabelled.count() == len(cases.awkward()) - 2
    assert quality.resample(cases.empty(spark), labels).count() == 0 and quality.keep_good(cases.empty(spark), labels).count() == 0

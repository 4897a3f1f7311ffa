import llm_cases as cases
import numpy as np
import pytest

from strandloom.llm import language_id as li


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(sf_dir.replace("0.001", "0.01") + "/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = li.identify_held_out(docs).collect()
    assert len(got) == len(truth) and all(r.held_out == cases.held(r.doc_id, 5, 0) and 0 <= r.score <= 1 for r in got)
    own = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in own]) > 0.97


def test_awkward_documents(spark):
    rows = cases.awkward()
    got = li.identify_held_out(cases.table(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for d, t, *_ in rows if d == r.doc_id)
        if text is None or not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in ("en", "fr", "xx") and 0 < r.score <= 1
    assert li.identify_held_out(cases.empty(spark)).count() == 0
    unlabelled = [(k, "words here", None, "s") for k in range(10)]
    assert {(r.lang_pred, r.score) for r in li.identify_held_out(cases.table(spark, unlabelled)).collect()} == {("und", 0.0)}


def test_predictions_use_the_text_alone(spark):
    rows = [(k, f"the plain words of text {k} are english here" if k % 2 else f"les mots du texte {k} sont français été là", "en" if k % 2 else "fr", f"s{k}") for k in range(60)]
    model = li.train(cases.table(spark, rows))
    a = li.identify(cases.table(spark, rows), model).collect()
    b = li.identify(cases.table(spark, [(d, t, "zz", None) for d, t, *_ in rows]), model).collect()
    assert cases.same(a, b) and all(r.lang_pred == ("en" if r.doc_id % 2 else "fr") for r in a)


def test_numerals_are_no_letters(spark):
    rows = [(k, "the plain words" if k % 2 else "les mots du texte", "en" if k % 2 else "fr", "s") for k in range(40)]
    marks = ["²", "½", "Ⅷ", "①", "_", "٣", "12 ³", "ª", "日", "²a"]
    model = li.train(cases.table(spark, rows))
    got = {r.doc_id: r.lang_pred for r in li.identify(cases.table(spark, [(k, t, None, None) for k, t in enumerate(marks)]), model).collect()}
    assert {k for k in got if got[k] == "und"} == {0, 1, 2, 3, 4, 5, 6} == {k for k, t in enumerate(marks) if not any(c.isalpha() for c in t)}


def test_a_rare_language_is_learned(spark):
    """Three documents in two thousand, none among the smallest hashes of a plain sample of 100."""
    import random

    rng = random.Random(8)
    pools = {"en": cases.pool(rng, "abcdefghinorst"), "fr": cases.pool(rng, "éèàçuvxylmqpoa"), "xx": cases.pool(rng, "кжщыэюя")}
    rows = [(k, " ".join(cases.words(rng, 20, pools[lang])), lang, "s") for k, lang in enumerate(["xx"] * 3 + ["en", "fr"] * 1000)]
    model = li.train(cases.table(spark, rows), sample=100)
    assert model.languages == ["en", "fr", "xx"]
    asked = [(k, " ".join(cases.words(rng, 20, pools[lang])), lang, "s") for k, lang in enumerate(["xx", "en", "fr"] * 20)]
    got = {r.doc_id: r.lang_pred for r in li.identify(cases.table(spark, asked), model).collect()}
    assert all(got[k] == lang for k, _, lang, _ in asked)


def plain_model(rows, sample, least, features, alpha=0.5, beta=1.0, l1=0.02, l2=0.05):
    """TF-IDF, FTRL and prediction with dicts and loops; rows (hash, text, lang)."""
    import math
    from collections import Counter, defaultdict

    def grams(text):
        low, out = f" {text.lower()} ", Counter()
        for n in (1, 2, 3):
            for k in range(len(low) - n + 1):
                h = ord(low[k]) * 2654435761 % 2**32
                for m, c in zip((2246822519, 3266489917), low[k + 1 : k + n], strict=False):
                    h = ((h ^ h >> 15) * m + ord(c) * 2654435761) % 2**32
                out[(h ^ h >> 16) & (features - 1)] += 1
        return out

    df = Counter()
    for _, text, _ in rows:
        df.update(grams(text).keys())

    def vector(text):
        x = {g: (1 + math.log(c)) * (math.log((1 + len(rows)) / (1 + df[g])) + 1) for g, c in grams(text).items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        return {g: v / norm for g, v in sorted(x.items())} | {-1: 1.0}

    totals = Counter(r[2] for r in rows)
    names = sorted(totals)
    each = max(least, -(-sample // len(names)))
    seen, fitted, held = Counter(), [], []
    for _, text, lang in sorted(rows):
        if seen[lang] < each:
            (held if seen[lang] % 5 == 4 else fitted).append((vector(text), names.index(lang)))
            seen[lang] += 1
    z, n = defaultdict(float), defaultdict(float)

    def weight(g, k):
        free = 0.0 if g == -1 else l1
        if abs(z[g, k]) <= free:
            return 0.0
        return -(z[g, k] - math.copysign(free, z[g, k])) / ((beta + math.sqrt(n[g, k])) / alpha + l2)

    def softmax(s):
        e = [math.exp(v - max(s)) for v in s]
        return [v / sum(e) for v in e]

    order = np.random.default_rng(7)
    for _ in range(3):
        for at in order.permutation(len(fitted)):
            x, label = fitted[at]
            w = {(g, k): weight(g, k) for g in x for k in range(len(names))}
            p = softmax([sum(v * w[g, k] for g, v in x.items()) for k in range(len(names))])
            for g, v in x.items():
                for k in range(len(names)):
                    d = v * (p[k] - (k == label))
                    step = (math.sqrt(n[g, k] + d * d) - math.sqrt(n[g, k])) / alpha
                    z[g, k] += d - step * w[g, k]
                    n[g, k] += d * d
    score = lambda text: [sum(v * weight(g, k) for g, v in vector(text).items()) for k in range(len(names))]
    return names, score, softmax


def test_against_a_plain_model(spark):
    rows = [(d, t, lang, s) for d, t, lang, s in cases.awkward(3) if d != 39 and lang and t]
    docs = cases.table(spark, rows)
    hashes = {(r.doc_id, r.text): r.h for r in docs.selectExpr("doc_id", "text", "xxhash64(doc_id) h").collect()}
    names, score, softmax = plain_model([(hashes[d, t], t, lang) for d, t, lang, _ in rows], 30, 4, 1 << 12)
    model = li.train(docs, sample=30, least=4, features=1 << 12)
    assert model.languages == names
    for r in li.identify(docs, model).collect():
        for t in [t for d, t, *_ in rows if d == r.doc_id]:
            assert model.logits(t) == pytest.approx(np.array(score(t)), abs=1e-6)
            if li.has_letter(t):
                p = softmax([v / model.temperature for v in score(t)])
                assert model.predict(t) == (names[int(np.argmax(p))], pytest.approx(max(p)))


def test_grams_of_blocks_add_up(monkeypatch):
    text = "abc déf " * 50
    want = li.gram_counts(text)
    monkeypatch.setattr(li, "_BLOCK", 37)
    got = li.gram_counts(text)
    assert (want[0] == got[0]).all() and (want[1] == got[1]).all()
    assert want[1].sum() == 3 * (len(text) + 2) - 3


def test_gradient_steps_sparsify():
    rng = np.random.default_rng(0)
    rows = [(np.array([k % 2, 2 + rng.integers(0, 50)]), np.array([0.8, 0.6]), k % 2) for k in range(400)]
    weights, _ = li.ftrl(rows, 60, 2, l1=0.5)
    assert weights[0, 0] > 0.2 > -0.2 > weights[0, 1] and (weights[2:] == 0).mean() > 0.7


def test_temperature():
    rng = np.random.default_rng(1)
    logits = rng.normal(size=(4000, 3))
    p = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    labels = np.array([rng.choice(3, p=x) for x in p])
    assert li.fit_temperature(3 * logits, labels) == pytest.approx(3.0, rel=0.1) and li.fit_temperature(logits[:0], labels[:0]) == 1.0

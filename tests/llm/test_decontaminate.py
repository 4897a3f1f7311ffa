import re

import llm_cases as cases

from strandloom.llm import decontaminate as d

ITEMS = [
    (0, "A train leaves the old station at 60 miles per hour while Anna walks 3 km to the village market on Monday morning"),
    (1, "how many marbles remain in the wooden box after the children share them equally among their friends today"),
    (2, "too short"),
    (3, None),
    (4, "1 2 3 4 5 6 7 8 9 10 11 12"),
    (None, "how many marbles remain in the wooden box after the children share them equally among their friends today"),
]
REWORDED = "A train leaves the old station at 85 kilometers per hour while Bertha walks 7 miles to the village market on Friday morning"
UNSOUND = ITEMS[1][1].replace("remain", "stay").replace("wooden", "iron").replace("equally", "evenly")


def rows():
    filler = "some unrelated words stand here in front of the passage and"
    return [
        (0, f"{filler} {ITEMS[1][1]} and more follows.", "en", "s"),
        (1, f"{filler}. {REWORDED}. more", "en", "s"),
        (2, UNSOUND, "en", "s"),
        (3, filler, "en", "s"),
        (4, None, "en", "s"),
        (5, "", "en", "s"),
        (6, ITEMS[1][1].upper(), "en", "s"),
        (7, "1 2 3 4 5 6 7 8 9 10 11 12", "en", "s"),
        (8, ITEMS[1][1], "en", "s"),
        (8, "clean text under the same id", "en", "s"),
        (9, ITEMS[1][1], "en", "s"),
        (9, ITEMS[1][1], "en", "s"),
        (None, ITEMS[1][1], "en", "s"),
        (10, "word " * 20_000 + ITEMS[1][1], "en", "s"),
        (11, ITEMS[1][1][:60], "en", "s"),
    ]


def benchmark(spark, items=ITEMS):
    return spark.createDataFrame(items, "item_id long, text string")


def test_leaks(spark):
    got = d.find_leaks(cases.table(spark, rows()), benchmark(spark)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(0, 1), (1, 0), (6, 1), (8, 1), (9, 1), (None, 1), (10, 1)}
    assert {r.doc_id: r.reworded for r in got}[1] is True and {r.doc_id: r.reworded for r in got}[0] is False
    assert all(r.containment >= 0.8 and r.n_matched <= r.n_windows for r in got)


def test_slots_must_stand_for_one_value(spark):
    item = "take 5 apples from basket one then put 5 apples into basket two and count 5 apples in all"
    text = lambda a, b, c: item.replace("5", a, 1).replace("5", b, 1).replace("5", c, 1) if a != "5" else item
    docs = cases.table(spark, [(0, text("7", "7", "7"), "en", "s"), (1, item.replace("take 5", "take 7").replace("put 5", "put 8"), "en", "s")])
    got = d.find_leaks(docs, benchmark(spark, [(0, item)])).collect()
    assert [(r.doc_id, r.reworded) for r in got] == [(0, True)]


def plain_leaks(rows, items, window=5, threshold=0.8):
    """Containment of literal windows, for texts without numbers, units or names."""
    cut = lambda t: re.sub(r"[^\w%$€£¢]+", " ", (t or "").lower()).split()
    grams = lambda w: [tuple(w[k : k + window]) for k in range(len(w) - window + 1)]
    out = set()
    for doc_id, text, *_ in rows:
        have = set(grams(cut(text)))
        for item_id, item in items:
            want = grams(cut(item))
            if want and sum(g in have for g in want) / len(want) >= threshold:
                out.add((doc_id, item_id))
    return out


def test_against_plain_containment(spark):
    import random

    rng = random.Random(5)
    pool = cases.pool(rng, "bcdfgaeiou", 300)
    items = [(k, " ".join(cases.words(rng, rng.randint(5, 40), pool))) for k in range(12)]
    texts = []
    for k in range(60):
        own = cases.words(rng, 60, pool)
        if k % 2:
            item = items[k % 12][1].split()
            for _ in range(k % 7):  # from none to six words changed
                item[rng.randrange(len(item))] = "zzz"
            own[30:30] = item
        texts.append((k, " ".join(own), "en", "s"))
    got = {(r.doc_id, r.item_id) for r in d.find_leaks(cases.table(spark, texts), benchmark(spark, items)).collect()}
    assert got == plain_leaks(texts, items) and len(got) >= 8


def test_without_key_words_or_broadcast(spark, monkeypatch):
    docs, items = cases.table(spark, rows()), benchmark(spark)
    want = sorted(map(str, d.find_leaks(docs, items).collect()))
    monkeypatch.setattr(d, "KEYS", 1)
    monkeypatch.setattr(d, "BROADCAST_BYTES", 1)
    monkeypatch.setattr(d, "BROADCAST_LEAKS", 0)
    assert sorted(map(str, d.find_leaks(docs, items).collect())) == want
    assert sorted(str(r.doc_id) for r in d.decontaminate(docs, items).collect()) == sorted(map(str, [2, 3, 4, 5, 7, 8, 11]))


def test_keys_lose_no_leak(spark, monkeypatch):
    """With and without the choice of documents by keys: names, numbers and punctuation between the words of keys."""
    rng = __import__("random").Random(11)
    pool = cases.pool(rng, "bcdfgaeiou", 60)
    noisy = lambda w: rng.choice([w, w, w, w.capitalize(), w + ",", w + ".", f"{rng.randint(1, 99)}", f"3.{rng.randint(1, 9)} km", f"{w} New York"])
    items = [(k, " ".join(noisy(w) for w in cases.words(rng, rng.randint(2, 40), pool))) for k in range(25)]
    texts = []
    for k in range(150):
        words = items[k % 25][1].split(" ")
        for _ in range(rng.choice([0, 0, 1, 3])):
            words[rng.randrange(len(words))] = rng.choice(["9", "Bertha", "zzz", "7.5"])
        a = rng.randint(0, max(0, len(words) // 2))
        texts.append((k, " ".join(cases.words(rng, 20, pool) + words[a:] + cases.words(rng, 20, pool)), "en", "s"))
    docs, items = cases.table(spark, texts), benchmark(spark, items)
    want = sorted(map(str, d.find_leaks(docs, items, run=d.RUN).collect()))
    monkeypatch.setattr(d, "KEYS", 0)
    assert len(want) > 20 and sorted(map(str, d.find_leaks(docs, items, run=d.RUN).collect())) == want


def test_names_and_numbers_of_several_parts(spark):
    item = "last summer the family went from New York to the sea and paid 1,000 dollars for 3.5 days in the old house with Uncle Sam Miller near the port"
    other = item.replace("New York", "Paris").replace("1,000", "750").replace("3.5", "12").replace("Uncle Sam Miller", "Aunt Jane")
    docs = cases.table(spark, [(0, other, "en", "s"), (1, item, "en", "s")])
    got = {r.doc_id: (r.containment, r.reworded) for r in d.find_leaks(docs, benchmark(spark, [(0, item)])).collect()}
    assert got == {0: (1.0, True), 1: (1.0, False)}


def test_names_stay_apart(spark):
    """Two persons of the item can't be one person in the document; two numbers may become equal."""
    item = "in the garden Tom gives 2 apples to Anna and the mother of Tom gives 3 pears to the mother of Anna every day"
    docs = cases.table(spark, [(0, item.replace("Tom", "Paul").replace("Anna", "Eva"), "en", "s"), (1, item.replace("Tom", "Paul").replace("Anna", "Paul"), "en", "s"), (2, item.replace("2", "7").replace("3", "7"), "en", "s")])
    got = {r.doc_id for r in d.find_leaks(docs, benchmark(spark, [(0, item)])).collect()}
    assert got == {0, 2}


def test_decontaminated_rows(spark):
    docs = cases.table(spark, rows())
    kept = d.decontaminate(docs, benchmark(spark))
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [2, 3, 4, 5, 7, 8, 11]))


def test_edges(spark):
    assert d.find_leaks(cases.empty(spark), benchmark(spark)).count() == 0
    assert d.find_leaks(cases.table(spark), benchmark(spark, [(1, None)])).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.decontaminate(cases.table(spark), none).count() == len(cases.awkward())


def test_plan_is_native(spark, sf_dir):
    from strandloom.llm import queries

    plan = queries.op2_template_decontamination(spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_finds_the_planted_passages(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    planted = {(i, r.item_id) for r in items.collect() for i, t in texts if r.text.lower() in (t or "").lower()}
    found = {(r.doc_id, r.item_id) for r in d.find_leaks(docs, items).collect()}
    assert planted and planted <= found


def test_signs_and_names_at_sentence_starts(spark):
    shop = "Tom has $4 and buys pens at 20¢ each. Anna gives him €9 more. How many pens does the boy buy in the little shop near the old bridge if he keeps half of it"
    other = shop.replace("Tom", "Paul").replace("Anna", "Maria").replace("$4", "$8").replace("20¢", "35¢").replace("€9", "€7")
    mixed = f"it was said that {other[0].lower()}{other[1:]}"
    twice = "The child plays in the green garden. The child sings a song about little birds. The child sleeps in a big bed near an open window until morning comes again"
    same = twice.replace("The child plays", "One child plays")
    docs = cases.table(spark, [(0, shop, "en", "s"), (1, other, "en", "s"), (2, mixed, "en", "s"), (3, same, "en", "s"), (4, other.replace("pens", "nails"), "en", "s")])
    got = {(r.doc_id, r.item_id): r for r in d.find_leaks(docs, benchmark(spark, [(0, shop), (1, twice)])).collect()}
    assert set(got) == {(0, 0), (1, 0), (2, 0), (3, 1)}
    assert got[1, 0].containment == 1 and got[1, 0].reworded and not got[0, 0].reworded


def test_a_name_stands_for_one_value(spark):
    item = "Tom walks to the market with a basket. Tom buys bread for the family and walks home. Tom eats the bread with butter"
    docs = cases.table(spark, [(0, item.replace("Tom", "Anna"), "en", "s"), (1, "Anna".join(item.split("Tom", 2)[:2]) + "Paul" + item.split("Tom", 2)[2].replace("Tom", "Eva"), "en", "s")])
    assert [r.doc_id for r in d.find_leaks(docs, benchmark(spark, [(0, item)])).collect()] == [0]


def test_parts_and_short_items(spark):
    words = cases.words(__import__("random").Random(3), 60, [f"{a}{b}{c}o" for a in "bdfgkl" for b in "aeiou" for c in "mnprst"])
    long, plain = " ".join(words), "the quick fox"
    texts = [" ".join(words[10:50]) + " and other things", "it ends so " + " ".join(words[:13]), " ".join(words[:12]) + " no more", "a text with the quick fox, in it", "the quick and the fox", f"x {' '.join(words[:20])} 5 {' '.join(words[21:30])}"]
    docs = cases.table(spark, [(k, t, "en", "s") for k, t in enumerate(texts)])
    items = benchmark(spark, [(0, long), (1, plain)])
    assert {(r.doc_id, r.item_id) for r in d.find_leaks(docs, items, run=d.RUN).collect()} == {(0, 0), (1, 0), (5, 0), (3, 1)}
    assert sorted(r.doc_id for r in d.decontaminate(docs, items).collect()) == [2, 4]


def test_a_stretch_agrees_in_itself(spark):
    item = "we count 5 apples in the basket and put them on the old table near the door then take 5 apples home again"
    docs = cases.table(spark, [(0, item.replace("count 5", "count 7"), "en", "s")])
    assert [r.doc_id for r in d.find_leaks(docs, benchmark(spark, [(0, item)]), run=d.RUN).collect()] == [0]

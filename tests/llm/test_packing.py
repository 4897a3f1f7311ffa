import zlib
from collections import Counter, defaultdict

import llm_cases as cases
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.llm import packing


@pytest.fixture(scope="module")
def memo():
    return packing.WordMemo(packing.tokenizer_path())


def plain_ids(memo, text):
    return memo.tokenizer.encode(text or "", add_special_tokens=False).ids


ODD = [
    "Thé. a, B.. c.,d É. ß. ſ. İ. K Å. ÿ. ×. x,\n",
    "a<|endoftext|>b <|startoftext|> x",
    "don't I'LL we've 'S ' s it's.",
    "   \n\n \t\x0b\x0c\x1f  ",
    "ﬁ ½ ① ​ q \U0001f600‍\U0001f600 à é́ ΣΑΣ ΟΔΟΣ.",
    "日本語 テキスト。 12345 1,234.56 $5.00",
    "x" * 5000,
    "",
]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts_match_the_tokenizer(memo, text):
    assert np.frombuffer(memo.documents([text])[0], "<u4").tolist() == plain_ids(memo, text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n.,'’éÉßİΣab")), max_size=40), max_size=4))
def test_any_texts_match_the_tokenizer(memo, texts):
    assert [np.frombuffer(x, "<u4").tolist() for x in memo.documents(texts)] == [plain_ids(memo, t) for t in texts]


def test_letters_and_marks_match_the_tokenizer(memo):
    words = [*packing.LETTERS, packing.LETTERS, *(f"word{a}{b}" for a in packing.MARKS for b in packing.MARKS), "a<|endoftext|>", "a<|endoftext|>.", "It's,", "x'.", "1.", "é!?", "x\u0338=", "=\u0338"]
    assert memo.merges is not None and set(packing.MARKS) - set(memo.marks) == set("<|>")
    assert [np.frombuffer(x, "<u4").tolist() for x in memo.documents([*words, " ".join(words)])] == [plain_ids(memo, w) for w in [*words, " ".join(words)]]


def test_words_in_use_outlive_a_full_memo(monkeypatch):
    """The memo stays within its bytes, and a word that texts have again and again is tokenised once."""
    monkeypatch.setattr(packing, "MEMO_BYTES", 400_000)
    memo, seen = packing.WordMemo(packing.tokenizer_path()), Counter()
    for way in ("merged", "encode"):
        monkeypatch.setattr(memo, way, lambda words, f=getattr(memo, way): seen.update(words) or f(words))
    for k in range(30):
        text = " ".join(["often", "frequent.", *(f"{a}{b}{chr(97 + k % 26)}{chr(97 + k // 26)}" for a in "abcdefghijklmno" for b in "abcdefghijklmnopqrst")])
        assert np.frombuffer(memo.documents([text])[0], "<u4").tolist() == plain_ids(memo, text)
        held = sum(packing.WORD_BYTES + len(w) + len(x) for have in (memo.words, memo.older) for w, x in have.items())
        assert held <= 400_000 + 2 * 60_000
    assert sum(seen.values()) > 8_000 and seen["often"] == seen["frequent"] == 1


def test_other_tokenizers_get_whole_words(tmp_path):
    import json

    kind = json.load(open(packing.tokenizer_path()))
    kind["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = "\\S+"
    (tmp_path / "other.json").write_text(json.dumps(kind))
    memo = packing.WordMemo(str(tmp_path / "other.json"))
    assert memo.merges is None
    text = "Words, and more words. Here;"
    assert np.frombuffer(memo.documents([text])[0], "<u4").tolist() == plain_ids(memo, text)


def test_corpus_matches_the_tokenizer(spark, sf_dir, memo):
    texts = [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = memo.documents(texts)
    assert all(np.frombuffer(x, "<u4").tolist() == plain_ids(memo, t) for x, t in zip(found, texts, strict=True))


def check_plan(histogram, capacity, **how):
    runs, sequences = packing.plan_packing(dict(histogram), capacity, **how)
    used, fill, ranks = Counter(), np.zeros(sequences, np.int64), defaultdict(list)
    for length, rank, count, first, offset in runs:
        assert count > 0 and first >= 0 and first + count <= sequences
        used[length] += count
        ranks[length].append((rank, count))
        fill[first : first + count] += length
    assert used == Counter({k: v for k, v in histogram.items() if v})
    for length, parts in ranks.items():  # ranks are gapless
        at = 0
        for rank, count in sorted(parts):
            assert rank == at
            at += count
    assert sequences == 0 or (fill.max() <= capacity and fill.min() > 0)
    places = defaultdict(list)
    for length, _, count, first, offset in runs:
        if count < 50:
            for k in range(count):
                places[first + k].append((offset, length))
    return sequences


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 300), max_size=20), st.sampled_from([1, 2, 3, 4]), st.sampled_from([4, 16, 64]))
def test_plans_place_everything_once(histogram, depth, bins):
    sequences = check_plan(histogram, 64, bins=bins, depth=depth)
    assert sequences >= -(-sum(k * v for k, v in histogram.items()) // 64)


def test_plans_are_tight():
    rng = np.random.default_rng(0)
    lengths = np.minimum(4096, np.maximum(1, rng.lognormal(6.3, 1.0, 20_000).astype(int)))
    histogram = Counter(lengths.tolist())
    least = -(-int(lengths.sum()) // 4096)
    assert check_plan(histogram, 4096) <= 1.01 * least
    assert check_plan(Counter({k: 1000 * v for k, v in histogram.items()}), 4096) <= 1010 * least


def test_nnls_against_conditions():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = rng.random((12, 20)), rng.normal(size=12)
        x = packing.nnls(a, b)
        slope = a.T @ (b - a @ x)
        assert (x >= 0).all() and slope.max() < 1e-5 and np.abs(slope[x > 0]).max(initial=0) < 1e-5


def test_patterns():
    found = packing.patterns(8, 3)
    assert len(found) == len(set(found)) and all(sum(p) == 8 and list(p) == sorted(p, reverse=True) and len(p) <= 3 for p in found)
    assert len(found) == 10


def test_pieces(spark, memo):
    rows = cases.awkward()
    got = packing.pack(cases.table(spark, rows), capacity=256).collect()
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = [*plain_ids(memo, text), 1]
        for k, at in enumerate(range(0, len(ids), 256)):
            part = np.asarray(ids[at : at + 256], "<u4")
            want[doc_id, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by_sequence = defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(r.length for r in got)
    assert len(by_sequence) <= 1.05 * total / 256 + 2


def test_hot_lengths_are_salted(spark):
    pieces = spark.range(500).selectExpr("id as doc_id", "0 as piece", "0L as start", "if(id % 2 = 0, 7L, 5L) as length", "id as ids_crc32")
    runs, _ = packing.plan_packing({7: 250, 5: 250}, 16)
    got = packing.place(pieces, runs, per_task=20).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == 500


def test_empty(spark):
    assert packing.pack(cases.empty(spark)).count() == 0

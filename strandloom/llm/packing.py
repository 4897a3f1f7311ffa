"""Best-fit packing of tokenised documents by length patterns and non-negative least squares.

1. Every whole text becomes token ids (a bounded memo of white-space separated words in front of the tokenizer),
   an end id is appended, and only documents over the capacity are cut, into full pieces and a rest.
2. The histogram of piece lengths (at most `capacity` entries, whatever the corpus) goes to the driver. Patterns of
   up to `depth` binned lengths that fill a sequence are enumerated, their repeat counts fitted to the binned
   histogram by non-negative least squares and rounded down; each pattern's slots are then filled with the exact
   lengths at hand. What the rounding leaves is packed best-fit, longest first, into the gaps that patterns left and
   into new sequences, for whole runs of equal lengths at a time.
3. The plan has runs "the a-th to b-th piece of length L go to sequences s, s+1, ... at offset o" and its size
   depends on the capacity alone. Pieces are ranked within their length (salted, so that a length that a third of
   all pieces share is split over tasks) and look their place up.

Defined results: null and empty texts are one end token; repeated rows and repeated ids are packed row by row; an
empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, materialise, small_batches

TOKENIZER = "word_bpe_49k.json"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
MEMO_BYTES = 48 << 20  # of words in a worker's memo, as WORD_BYTES each and their letters and ids; half of it for older ones
WORD_BYTES = 170  # what an entry, its key and its value take beside them
LONGEST_MEMO_WORD = 64
TOGETHER = 512


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Lower-casing a word without such characters beforehand is what the tokenizer does itself; one with some is left to it.
BEYOND_LATIN = re.compile("[^\\x00-\u024f]")
#: Letters that neither NFC nor lower-casing changes.
LETTERS = "".join(c for c in map(chr, range(0x250)) if c.isalpha() and c.lower() == c)
PLAIN = re.compile(f"[{LETTERS}]+")
#: After a letter, some of these at a word's end are a token's text of their own. An apostrophe may begin a contraction.
MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
#: What a tokenizer does before its merges, for PLAIN and MARKS to be right.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": SPLIT, "behavior": "Removed", "invert": True}, BYTES]}


class WordMemo:
    """Words → their ids as little-endian 32-bit bytes. The tokenizer drops white space and never merges across it.

    When half of MEMO_BYTES is full, its words become the older ones, and the older ones that no text has had since go.
    Where the tokenizer is of the kind that PLAIN and MARKS describe, a word is held without the marks at its end, and words
    of letters go right to the merges: a token that ends a word says so by its suffix."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.size = 0
        self.marks = ""
        self.merges = self.merging(Tokenizer)

    def merging(self, kind: type):
        """The tokenizer's merges alone, over the same model; None for tokenizers of other kinds."""
        from tokenizers import pre_tokenizers

        model, steps = self.tokenizer.model, (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer)
        suffix = getattr(model, "end_of_word_suffix", None)
        if not suffix or None in steps or [json.loads(x.__getstate__()) for x in steps] != [NORMALIZER, PRE_TOKENIZER]:
            return None
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        alphabet = pre_tokenizers.ByteLevel.alphabet()
        if self.tokenizer.truncation or self.tokenizer.padding or not all({c, c + suffix} <= vocabulary.keys() for c in alphabet):
            return None
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        special = "".join(x.content for x in self.tokenizer.get_added_tokens_decoder().values())
        self.marks = "".join(c for c in MARKS if c not in special)
        out = kind(model)
        out.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        return out

    def merged(self, words: list[str]) -> list[bytes]:
        """Ids of PLAIN words: many to a text, told apart by the tokens that end a word."""
        out: list[bytes] = []
        groups = [" ".join(words[at : at + TOGETHER]) for at in range(0, len(words), TOGETHER)]
        for found in self.merges.encode_batch_fast(groups, add_special_tokens=False):
            numbers = np.asarray(found.ids, "<u4")
            ends = (4 * np.flatnonzero(self.last[numbers]) + 4).tolist()
            ids = numbers.tobytes()
            out += [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        return out

    def encode(self, words: list[str]) -> list[bytes]:
        """Ids of words without spaces: many to a text, told apart by the tokens' places in it."""
        out: list[bytes] = []
        groups = [words[at : at + TOGETHER] for at in range(0, len(words), TOGETHER)]
        for own, found in zip(groups, self.tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            begins = np.cumsum([0, *(len(w) + 1 for w in own)])
            places = np.array(found.offsets, np.int64).reshape(-1, 2)[:, 0]
            cuts = (4 * np.searchsorted(places, begins)).tolist()
            ids = np.asarray(found.ids, "<u4").tobytes()
            out += [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        return out

    def hold(self, words: Sequence[str], ids: Sequence[bytes]) -> None:
        self.words.update(zip(words, ids, strict=True))
        self.size += WORD_BYTES * len(words) + sum(map(len, words)) + sum(map(len, ids))

    def learn(self, unseen: set[str]) -> None:
        again = list(unseen.intersection(self.older))
        self.hold(again, [self.older[w] for w in again])
        new = unseen.difference(again)
        plain = [w for w in new if PLAIN.fullmatch(w)] if self.merges is not None else []
        others = list(new.difference(plain))
        self.hold(plain, self.merged(plain) if plain else [])
        self.hold(others, self.encode(others))

    @staticmethod
    def lowered(words: pa.Array) -> list[str]:
        """Words without line ends, lower-cased unless that is left to the tokenizer."""
        every = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), "\n")[0].as_py()
        if BEYOND_LATIN.search(every):
            return [w if BEYOND_LATIN.search(w) else w.lower() for w in every.split("\n")]
        return every.lower().split("\n")

    def ids_of(self, words: pa.Array) -> list[bytes]:
        """Ids of different words without spaces and line ends."""
        ended = pc.ascii_rtrim(words, self.marks)
        stems, tails = self.lowered(ended), {}
        cut = np.flatnonzero(pc.not_equal(pc.binary_length(words), pc.binary_length(ended)))
        for k, w in zip(cut.tolist(), self.lowered(words.take(pa.array(cut))) if len(cut) else [], strict=True):
            if stems[k][-1:].isalpha():
                tails[k] = w[len(stems[k]) :]
            else:
                stems[k] = w
        if self.size >= MEMO_BYTES // 2:
            self.older, self.words, self.size = self.words, {}, 0
        unseen = set(stems).union(tails.values()).difference(self.words)
        self.learn(unseen)
        have = self.words
        out = list(map(have.__getitem__, stems))
        for k, tail in tails.items():
            out[k] += have[tail]
        for w in unseen:
            if len(w) > LONGEST_MEMO_WORD:
                self.size -= WORD_BYTES + len(w) + len(have.pop(w))
        return out

    def documents(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts: their words are numbered, each different one is looked up once."""
        if not texts:
            return []
        split = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.string()), "\n", " "), " ")
        words = split.values.dictionary_encode()
        ids = self.ids_of(words.dictionary)
        numbers = words.indices.to_numpy()
        sizes = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
        begins = np.cumsum(sizes) - sizes
        ends = np.concatenate([[0], np.cumsum(sizes[numbers])])
        every = np.frombuffer(b"".join(ids), "<u4")
        bounds = ends[split.offsets.to_numpy()].tolist()
        tokens = every[np.repeat(begins[numbers] - ends[:-1], sizes[numbers]) + np.arange(ends[-1])]
        return [tokens[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]


@lru_cache(maxsize=4)
def memo_of(path: str) -> WordMemo:
    return WordMemo(path)


def tokenise_pieces(docs: DataFrame, *, capacity: int, end_id: int, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, end = memo_of(path), int(end_id).to_bytes(4, "little")
        for whole in batches:
            for batch in small_batches(whole):
                out: list[list] = [[], [], [], [], []]
                texts = [x or "" for x in batch.column(1).to_pylist()]
                for key, ids in zip(batch.column(0).to_pylist(), memo.documents(texts), strict=True):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        for column, value in zip(out, (key, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        give_back()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """min |ax - b| over x >= 0 by Lawson and Hanson's active sets, on the normal equations."""
    gram, right = a.T @ a, a.T @ b
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    slope = right.copy()
    for _ in range(rounds):
        slope[active] = -np.inf
        best = int(np.argmax(slope))
        if slope[best] <= 1e-9 * max(1.0, float(np.abs(right).max())):
            break
        active[best] = True
        while True:
            on = np.flatnonzero(active)
            trial = np.linalg.lstsq(gram[np.ix_(on, on)], right[on], rcond=None)[0]
            if (trial > 0).all():
                break
            low = trial <= 0
            step = np.min(x[on][low] / np.maximum(x[on][low] - trial[low], 1e-300))
            x[on] += step * (trial - x[on])
            x[on[x[on] <= 1e-12]] = 0.0
            active = active & (x > 0)
            if not active.any():
                trial, on = np.zeros(0), np.zeros(0, int)
                break
        x[:] = 0.0
        x[on] = trial
        slope = right - gram @ x
    return x


@lru_cache(maxsize=8)
def patterns(bins: int, depth: int) -> list[tuple[int, ...]]:
    """All multisets of at most `depth` bin sizes 1..bins that add up to `bins`, larger sizes first."""
    out: list[tuple[int, ...]] = []

    def grow(left: int, largest: int, have: tuple[int, ...]) -> None:
        if left == 0:
            out.append(have)
        elif len(have) < depth:
            for size in range(min(left, largest), -(-left // (depth - len(have))) - 1, -1):
                grow(left - size, size, (*have, size))

    grow(bins, bins, ())
    return out


def plan_packing(histogram: dict[int, int], capacity: int, *, bins: int = 128, depth: int = 3) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, count, first sequence, offset), and the number of sequences."""
    width = -(-capacity // bins)
    left = dict(histogram)
    used: dict[int, int] = defaultdict(int)
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free tokens → [(first sequence, how many)]
    sequences = 0

    def put(length: int, count: int, first: int, offset: int) -> None:
        runs.append((length, used[length], count, first, offset))
        used[length] += count
        left[length] -= count

    def open_up(lengths: tuple[int, ...], count: int) -> None:
        nonlocal sequences
        offset = 0
        for length in lengths:
            put(length, count, sequences, offset)
            offset += length
        if offset < capacity:
            gaps[capacity - offset].append((sequences, count))
        sequences += count

    full = [x for x in left if x == capacity and left[x]]
    for length in full:
        open_up((length,), left[length])
    of_bin: dict[int, list[int]] = defaultdict(list)
    for length in sorted(left):
        if left[length] and length < capacity:
            of_bin[-(-length // width)].append(length)
    if of_bin:
        want = np.zeros(bins + 1)
        for size, lengths in of_bin.items():
            want[size] = sum(left[x] for x in lengths)
        usable = [p for p in patterns(bins, depth) if all(want[s] > 0 for s in p)]
        if usable:
            matrix = np.zeros((bins + 1, len(usable)))
            for k, p in enumerate(usable):
                for s in p:
                    matrix[s, k] += 1
            weight = np.sqrt(np.arange(bins + 1) / bins + 0.05)  # long pieces are harder to place later
            repeat = np.floor(nnls(matrix * weight[:, None], want * weight) + 1e-6).astype(np.int64)
            for k in np.argsort(-repeat, kind="stable"):
                todo = int(repeat[k])
                while todo > 0:
                    slots, taken = [], defaultdict(int)
                    for s in usable[k]:  # the longest that the bin still has
                        length = next((x for x in reversed(of_bin[s]) if left[x] > taken.get(x, 0)), None)
                        if length is None:
                            break
                        taken[length] += 1
                        slots.append(length)
                    if len(slots) < len(usable[k]):
                        break
                    count = min(todo, *(left[x] // n for x, n in taken.items()))
                    open_up(tuple(slots), count)
                    todo -= count
    for length in sorted((x for x in left if left[x]), reverse=True):
        while left[length]:
            room = min((g for g in gaps if g >= length), default=None)
            if room is None:
                each = capacity // length
                whole, rest = divmod(left[length], each)
                if whole:
                    open_up((length,) * each, whole)
                if rest:
                    open_up((length,) * rest, 1)
                continue
            first, have = gaps[room].pop()
            if not gaps[room]:
                del gaps[room]
            each = room // length
            whole = min(have, left[length] // each)
            if whole == 0:
                whole, each = 1, left[length]
            offset = capacity - room
            for j in range(each):
                put(length, whole, first, offset + j * length)
            if room > each * length:
                gaps[room - each * length].append((first, whole))
            if have > whole:
                gaps[room].append((first + whole, have - whole))
    return runs, sequences


def place(pieces: DataFrame, runs: list[tuple[int, int, int, int, int]], *, per_task: int = 1_000) -> DataFrame:
    """Adds sequence_id and offset: the rank of a piece within its length picks the run."""
    salts = F.greatest(F.lit(1), F.ceil(F.col("n") / per_task)).cast("int")
    spread = pieces.groupBy("length").agg(F.count("*").alias("n")).select("length", salts.alias("salts"))
    salted = pieces.join(F.broadcast(spread), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("salts")).cast("int")).drop("salts")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(inside) - 1).join(offsets, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("base")).drop("salt", "base")
    table = np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)
    scale = np.int64(1) << 40
    key = table[:, 0] * scale + table[:, 1]
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            row = table[np.searchsorted(key, length * scale + rank, side="right") - 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(row[:, 3] + rank - row[:, 1]), pa.array(row[:, 4])], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, f"{PIECES}, sequence_id long, offset long")


def pack(docs: DataFrame, *, capacity: int = 4096, end_id: int = 1, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text", bins: int = 128, depth: int = 3) -> DataFrame:
    """One row per piece with its sequence and place."""
    pieces = materialise(tokenise_pieces(docs, capacity=capacity, end_id=end_id, path=tokenizer or tokenizer_path(), doc_id=doc_id, text=text), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    runs, _ = plan_packing(histogram, capacity, bins=bins, depth=depth)
    return place(pieces, runs)

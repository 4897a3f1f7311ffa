"""A hierarchical Pitman-Yor language model, seated by Gibbs sampling, and corpus-wide scores.

Dishes are words (the end of a text is one). Every word that some text has has a restaurant: its customers are the training
tokens that follow the word. Restaurants whose words end alike (in the same two bytes) share a parent, whose customers are
their tables; where an ending is so frequent that its words fill more than `PART` tokens, the words with it have as many
parents as that takes, by a hash. All parents share the root. The root's base is diffuse: each word has one table there, and
the mass of a new table is that of all words that the training texts lack, which are one dish, as in the base score.

Seating starts with one table a dish. A sweep goes through all dishes with two customers or more. All customers of a dish
with up to `LARGE` of them leave and come back together, their number of tables drawn from its exact conditional (by
generalised Stirling numbers); of larger dishes single customers leave their table and are seated again, `MOVES` a sweep, each
dish's tables kept one by one. Dishes move in two halves, side by side, given the tables of the others and the parents'
probabilities before. Then the tables are the parents' customers, and these move alike. Discounts and strengths of both
levels are drawn on a grid from their posterior after every sweep, by each bucket for its restaurants, those of the root by
the driver from counts of counts. Predictive probabilities are averaged over the sweeps after `BURN_IN`.

What is counted grows with the corpus and stays distributed. Texts become numbers of words in *chunks* (a few million
tokens, one row each). Words meet by hash, as bytes, for the counts of the base score. Pairs of a word and the one before
meet in *buckets*, whole restaurants with their parents, of about `BUCKET_TOKENS` tokens each, so that sweeps need no
exchange; a word's own restaurant with more than PART customers is split by dishes, its totals estimated from each part's
(its size is known). Buckets ask the root for their dishes' customers once, and tell it of further tables after sampling; the
root's probability stands meanwhile. In restaurants and at the root words are told apart by 40 bits of their hash. The driver
sees counts by ending, words with more than PART tokens, counts of counts, and a few numbers of each bucket.

Defined results: null and empty texts are the end alone; null ids fall into the training part or not by the crc of
the empty text; repeated rows are counted and scored one by one; with no training text all counts are 0, the base
score is 0 a token and every token has probability 1; an empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bucket_of, discard, forget_shuffles, give_back, materialise, small_batches, words_of

CHUNK_TOKENS, CHUNK_WORDS = 3_000_000, 500_000
WORD_BYTES = 24_000_000  # of text for each bucket of words
BUCKET_TOKENS, PART = 2_250_000, 750_000
SIDE = 257  # a byte or none
FIRST_CLASS = SIDE * SIDE  # the ending of the start of a text, which has no word
LARGE, MOVES = 64, 16
SWEEPS, BURN_IN = 6, 2
DISCOUNTS = np.linspace(0.05, 0.95, 37)
STRENGTHS = np.logspace(-2, 4, 61)
START = xxhash.xxh3_64_intdigest(b" ") >> 24  # no word has a space


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers: Stirling's series after eight steps up."""
    x = np.asarray(x, np.float64)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        shift += np.log(y)
        y = y + 1
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + (1 / 12 - (1 / 360 - 1 / (1260 * y * y)) / (y * y)) / y - shift


@lru_cache(maxsize=64)
def stirling(discount: float, most: int = LARGE) -> np.ndarray:
    """[c, t]: log of the generalised Stirling number, the weight of all seatings of c customers at t tables."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    tables = np.arange(most + 1)
    for c in range(most):
        with np.errstate(divide="ignore"):
            stay = out[c] + np.log(np.maximum(c - discount * tables, 0))
        out[c + 1, 1:] = np.logaddexp(out[c, :-1], stay[1:])
    return out


def draw_tables(customers: np.ndarray, parent: np.ndarray, others: np.ndarray, discount: float, strength: float, rng) -> np.ndarray:
    """Tables of dishes with 1 to LARGE customers, each given the tables of all other dishes of its restaurant."""
    out = np.ones(len(customers), np.int64)
    weights = stirling(discount)
    for c in np.unique(customers).tolist():
        if c < 2:
            continue
        own = np.flatnonzero(customers == c)
        t = np.arange(c)
        log = weights[c, 1 : c + 1] + np.log(np.maximum(parent[own], 1e-300))[:, None] * (t + 1) + np.log(strength + discount * (others[own][:, None] + t)).cumsum(axis=1)
        chance = np.exp(log - log.max(axis=1, keepdims=True)).cumsum(axis=1)
        out[own] = 1 + (chance < (rng.random(len(own)) * chance[:, -1])[:, None]).sum(axis=1)
    return out


class Crowd:
    """Large dishes with every table's customers: slots in a row for each dish, some of them empty."""

    def __init__(self, customers: np.ndarray, opening: np.ndarray, discount: float, rng):
        """A first seating: openings drawn in blocks that grow by a sixteenth, customers shared out at random. Moves do the rest."""
        self.customers, self.rng = customers.astype(np.int64), rng
        tables, at, left = np.ones(len(customers), np.int64), 1, np.arange(len(customers))
        while len(left):
            block = np.minimum(max(1, at // 16), customers[left] - at)
            chance = opening[left] / np.maximum(at + block / 2 - discount * tables[left] + opening[left], 1e-12)
            tables[left] += rng.binomial(block, np.clip(chance, 0, 1))
            at += max(1, at // 16)
            left = left[customers[left] > at]
        self.tables = np.minimum(tables, self.customers)
        parts = [1 + rng.multinomial(c - t, rng.dirichlet(np.full(t, 1 - discount))) if t > 1 else np.array([c]) for c, t in zip(self.customers.tolist(), self.tables.tolist(), strict=True)]
        self._lay(parts)

    def _lay(self, parts: list[np.ndarray]) -> None:
        room = np.array([2 * len(p) + MOVES for p in parts], np.int64)
        self.start = np.concatenate([[0], np.cumsum(room)]).astype(np.int64)
        self.size = np.zeros(self.start[-1], np.int64)
        for at, p in zip(self.start.tolist(), parts, strict=False):
            self.size[at : at + len(p)] = p

    def _slot(self, weights: np.ndarray, draw: np.ndarray) -> np.ndarray:
        """The slot of each dish that `draw`, a point below the sum of its weights, falls into."""
        total = np.concatenate([[0], np.cumsum(weights)])
        at = np.searchsorted(total, total[self.start[:-1]] + draw, side="right") - 1
        return np.clip(at, self.start[:-1], self.start[1:] - 1)

    def move(self, opening: np.ndarray, discount: float) -> np.ndarray:
        """One customer of every dish leaves and is seated again. The changes of the numbers of tables."""
        if not len(self.customers):
            return np.zeros(0, np.int64)
        before, each = self.tables.copy(), np.arange(len(self.customers))
        gone = self._slot(self.size, np.floor(self.rng.random(len(each)) * self.customers).astype(np.int64))
        self.size[gone] -= 1
        self.tables -= self.size[gone] == 0
        draw = self.rng.random(len(each)) * (self.customers - 1 - discount * self.tables + opening)
        fresh = draw < opening
        weights = np.where(self.size > 0, self.size - discount, 0.0)
        to = self._slot(weights, np.where(fresh, 0.0, draw - opening))
        empty = np.minimum.reduceat(np.where(self.size == 0, np.arange(len(self.size)), len(self.size)), self.start[:-1])
        to = np.where(fresh | (self.size[to] == 0), empty, to)  # rounding may end in an empty slot: then it is a new table as well
        self.tables += self.size[to] == 0
        self.size[to] += 1
        if (np.add.reduceat((self.size == 0).astype(np.int64), self.start[:-1]) < 2).any():
            self._lay([p[p > 0] for p in np.split(self.size, self.start[1:-1])])
        return self.tables - before

    def sizes(self) -> np.ndarray:
        return self.size[self.size > 0]


@dataclass
class Level:
    """Restaurants of one level of a bucket and their dishes. scale: how many parts a restaurant has of which this is one."""

    customers: np.ndarray
    owner: np.ndarray  # of each dish its restaurant
    scale: np.ndarray
    total: np.ndarray | None  # customers of whole restaurants where that is known
    discount: float
    strength: float
    rng: object

    def __post_init__(self) -> None:
        self.tables = np.minimum(self.customers, 1)
        self.crowd: Crowd | None = None
        self.halves = self.rng.random(len(self.customers)) < 0.5

    def seated(self) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables of every (whole) restaurant."""
        of = lambda x: np.bincount(self.owner, weights=x, minlength=len(self.scale)) * self.scale
        return of(self.customers) if self.total is None else self.total, of(self.tables)

    def parts(self) -> tuple[np.ndarray, np.ndarray]:
        """By dish what it has of its own; by restaurant the weight of the parent's probability."""
        customers, tables = self.seated()
        size = self.strength + customers
        return np.maximum(self.customers - self.discount * self.tables, 0) / size[self.owner], (self.strength + self.discount * tables) / size

    def sweep(self, parent: np.ndarray, keep: bool) -> None:
        """parent: each dish's probability in the parent. keep: large dishes have the customers that they had in the last sweep."""
        large = np.flatnonzero(self.customers > LARGE)
        small = (self.customers > 1) & (self.customers <= LARGE)
        self.tables = np.where(self.customers > LARGE, np.maximum(self.tables, 1), np.minimum(np.maximum(self.tables, np.minimum(self.customers, 1)), self.customers))
        for half in (self.halves, ~self.halves):
            own = np.flatnonzero(small & half)
            _, tables = self.seated()
            others = np.maximum(tables[self.owner[own]] - self.tables[own], 0)
            self.tables[own] = draw_tables(self.customers[own], parent[own], others, self.discount, self.strength, self.rng)
        _, tables = self.seated()
        where = self.owner[large]
        opening = lambda: (self.strength + self.discount * tables[where]) * parent[large]
        if self.crowd is None or not keep:
            self.crowd = Crowd(self.customers[large], opening(), self.discount, self.rng)
            self.tables[large] = self.crowd.tables
            _, tables = self.seated()
        for _ in range(MOVES):
            np.add.at(tables, where, self.crowd.move(opening(), self.discount) * self.scale[where])
        self.tables[large] = self.crowd.tables

    def learn(self) -> None:
        """Draw strength and discount from their posterior on the grid, by counts of restaurants and dishes of each kind."""
        customers, tables = self.seated()
        busy = customers > 0
        t, nt = np.unique(np.maximum(tables[busy], 1), return_counts=True)
        c, nc = np.unique(customers[busy], return_counts=True)
        small = (self.customers > 0) & (self.customers <= LARGE)
        kinds = np.bincount(self.customers[small].astype(np.int64) * (LARGE + 1) + self.tables[small], minlength=(LARGE + 1) ** 2).reshape(LARGE + 1, -1)
        at = np.nonzero(kinds)
        sizes, ns = np.unique(self.crowd.sizes(), return_counts=True) if self.crowd is not None and len(self.crowd.customers) else (np.zeros(0), np.zeros(0))

        def openings(d: float, s: float) -> float:
            return float(nt @ ((t - 1) * np.log(d) + log_gamma(s / d + t) - log_gamma(s / d + 1)))

        def dishes(d: float) -> float:
            return float(kinds[at] @ stirling(d)[at]) + (float(ns @ (log_gamma(sizes - d) - log_gamma(np.array(1 - d)))) if len(sizes) else 0.0)

        def pick(grid: np.ndarray, log: list[float]) -> float:
            weight = np.exp(np.array(log) - max(log))
            return float(self.rng.choice(grid, p=weight / weight.sum()))

        if len(t):
            self.discount = pick(DISCOUNTS, [openings(d, self.strength) + dishes(d) for d in DISCOUNTS.tolist()])
            self.strength = pick(STRENGTHS, [openings(self.discount, s) - float(nc @ (log_gamma(s + c) - log_gamma(np.array(s + 1.0)))) for s in STRENGTHS.tolist()])


def fit_root(sizes: np.ndarray, counts: np.ndarray) -> tuple[float, float]:
    """Discount and strength of the root with one table a dish, most likely on the grid: counts of dishes by customers."""
    if not len(sizes):
        return 0.5, 1.0
    words, customers = float(counts.sum()), float(sizes @ counts)

    def likely(d: float, s: float) -> float:
        tables = (words - 1) * np.log(d) + log_gamma(np.array(s / d + words)) - log_gamma(np.array(s / d + 1))
        return float(tables - log_gamma(np.array(s + customers)) + log_gamma(np.array(s + 1.0)) + counts @ (log_gamma(sizes - d) - log_gamma(np.array(1 - d))))

    discount, strength = 0.5, 1.0
    for _ in range(4):
        discount = max(DISCOUNTS.tolist(), key=lambda d: likely(d, strength))
        strength = max(STRENGTHS.tolist(), key=lambda s: likely(discount, s))
    return discount, strength


@dataclass(frozen=True)
class Root:
    """The root's parameters. A word's probability follows from its customers there, the number of tables that serve it."""

    discount: float
    strength: float
    words: int
    customers: int

    def probability(self, customers: np.ndarray) -> np.ndarray:
        size = self.strength + self.customers
        known = np.maximum(customers - self.discount, 0) / size
        return np.where(customers > 0, known, (self.strength + self.discount * self.words) / size)


def sample(group: np.ndarray, of_context: np.ndarray, context: np.ndarray, word: np.ndarray, count: np.ndarray, root: np.ndarray, scale: np.ndarray, known: np.ndarray, rng, sweeps: int = SWEEPS, burn_in: int = BURN_IN):
    """Seat a bucket and average its predictive probabilities.

    group: of each (group, word) dish its group; of_context: of each context its group; context, word and count: of each pair
    its context, its (group, word) dish and its training count; root: each (group, word) dish's probability at the root; scale:
    of each group its number of parts; known: of each context its customers where the group is a part, else 0.
    → of each pair its own share, of each context the weight of the root's probability, the last seating's tables of each
    (group, word) dish, and the last parameters. A pair has probability share + weight * root."""
    if count.sum() == 0:
        return np.zeros(len(count)), np.ones(len(of_context)), np.zeros(len(group), np.int64), (0.5, 1.0, 0.5, 1.0)
    total = np.bincount(context, weights=count, minlength=len(of_context))
    total = np.where(known > 0, known, total)
    leaf = Level(count.astype(np.int64), context, scale[of_context], total, 0.5, 1.0, rng)
    above = Level(np.zeros(len(group), np.int64), group, scale, None, 0.5, 1.0, rng)
    share, weight = np.zeros(len(count)), np.zeros(len(of_context))
    up = lambda: np.bincount(word, weights=leaf.tables, minlength=len(group)).astype(np.int64)
    above.customers = up()
    above.tables = np.minimum(above.customers, 1)
    for s in range(sweeps):
        own, back = above.parts()
        leaf.sweep((own + back[group] * root)[word], True)
        above.customers = up()
        above.sweep(root, False)
        leaf.learn()
        above.learn()
        if s >= burn_in:
            own, back = above.parts()
            first, rest = leaf.parts()
            share += first + rest[context] * own[word]
            weight += rest * back[of_context]
    kept = max(1, sweeps - burn_in)
    return share / kept, weight / kept, above.tables, (leaf.discount, leaf.strength, above.discount, above.strength)


# What goes from task to task ------------------------------------------------------------------------------------------


@lru_cache(maxsize=1)
def _zstd() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _small(data: bytes) -> bytes:
    return _zstd()[0].compress(data)


def _pack(values: np.ndarray, kind: str) -> bytes:
    """Compressed; bytes of equal weight stand together."""
    own = np.ascontiguousarray(values.astype(kind))
    return _small(own.view(np.uint8).reshape(len(own), own.itemsize).T.tobytes())


def _values(packed: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(_zstd()[1].decompress(packed), np.uint8).reshape(width, -1).T).view(kind).ravel()


def _rising(values: np.ndarray) -> bytes:
    return _pack(np.diff(values.astype(np.int64), prepend=0), "<u8")


def _risen(packed: bytes) -> np.ndarray:
    return np.cumsum(_values(packed, "<u8").astype(np.int64))


def _shares(values: np.ndarray) -> bytes:
    """Probabilities with 16 bits of mantissa: a token's score is off by less than 1e-5."""
    return _pack((values.astype("<f4").view("<u4") + np.uint32(0x80)) & np.uint32(0xFFFFFF00), "<u4")


def _words(packed: bytes, lengths: np.ndarray) -> list[bytes]:
    blob, ends = _zstd()[1].decompress(packed), np.cumsum(lengths)
    return [blob[a:b] for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]


def codes_of(words: list[bytes]) -> np.ndarray:
    return (np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) >> np.uint64(24)).astype(np.int64)


def endings_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(((w[-2] if len(w) > 1 else 256) * SIDE + (w[-1] if w else 256) for w in words), np.int64, len(words))


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


CHUNKS = "chunk long, ids binary, marks binary, lengths binary, numbers binary, words binary, word_lengths binary"


def chunked(docs: DataFrame) -> DataFrame:
    """docs (doc_id, held_out, text) → a row for each chunk: ids, marks (1: held out, 2: no id), lengths, the number of every
    token's word, and the words, the frequent ones first."""
    schema = _schema(CHUNKS)

    class Numbers(dict):
        def __missing__(self, word: bytes) -> int:
            self[word] = number = len(self)
            return number

    def settle(chunk: int, words: list[bytes], texts: list[tuple]) -> pa.RecordBatch:
        numbers = np.concatenate([t[2] for t in texts])
        order = np.argsort(-np.bincount(numbers, minlength=len(words)), kind="stable")
        rank = np.empty(len(words), np.int32)
        rank[order] = np.arange(len(words))
        named = [words[k] for k in order.tolist()]
        marks = np.array([bool(t[1]) + 2 * (t[0] is None) for t in texts])
        return _table(
            schema,
            [(chunk, _pack(np.array([t[0] or 0 for t in texts]), "<i8"), _pack(marks, "u1"), _pack(np.array([len(t[2]) for t in texts]), "<u4"), _pack(rank[numbers], "<u4"), _small(b"".join(named)), _pack(np.fromiter(map(len, named), np.int64, len(named)), "<u4"))],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 24
        numbers, texts, tokens = Numbers(), [], 0
        for batch in batches:
            for part in small_batches(batch, 128):
                for key, held, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), as_bytes(part.column(2)), strict=True):
                    words = words_of(data)
                    words.append(b"")
                    texts.append((key, held, np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))))
                    tokens += len(words)
                    if tokens >= CHUNK_TOKENS or len(numbers) >= CHUNK_WORDS:
                        yield settle(chunk, list(numbers), texts)
                        chunk += 1
                        numbers, texts, tokens = Numbers(), [], 0
        if texts:
            yield settle(chunk, list(numbers), texts)
        del numbers, texts
        give_back()

    return docs.mapInArrow(run, CHUNKS)


class Chunk:
    """A row of chunked, unpacked."""

    def __init__(self, row: dict):
        self.chunk = row["chunk"]
        self.marks = _values(row["marks"], "u1")
        self.ids = _values(row["ids"], "<i8")
        self.lengths = _values(row["lengths"], "<u4").astype(np.int64)
        self.numbers = _values(row["numbers"], "<u4").astype(np.int64)
        self.words = _words(row["words"], _values(row["word_lengths"], "<u4").astype(np.int64))
        self.train = np.repeat((self.marks & 1) == 0, self.lengths)
        self.codes = codes_of(self.words)

    def by_bucket(self, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
        """Numbers of the words of each bucket of words."""
        bucket = self.codes * buckets >> 40
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for k in range(buckets):
            if cuts[k] < cuts[k + 1]:
                yield k, order[cuts[k] : cuts[k + 1]]


WORDS = "bucket int, chunk long, words binary, lengths binary, n binary"
VOCABULARY = "bucket int, tokens long, distinct long, codes binary, c binary, endings binary, ending_n binary, hot binary, hot_n binary, hot_end binary, chunks binary, sizes binary, place binary"


def words_asked(chunks: DataFrame, buckets: int) -> DataFrame:
    """For each chunk and bucket of words its words and their training counts there."""
    schema = _schema(WORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = Chunk(row)
                n = np.bincount(own.numbers[own.train], minlength=len(own.words))
                for k, which in own.by_bucket(buckets):
                    named = [own.words[i] for i in which.tolist()]
                    yield _table(schema, [(k, own.chunk, _small(b"".join(named)), _pack(np.fromiter(map(len, named), np.int64, len(named)), "<u4"), _pack(n[which], "<u4"))])
        give_back()

    return chunks.mapInArrow(run, WORDS)


def vocabulary_of(asked: DataFrame) -> DataFrame:
    """A row for each bucket: its words' codes and counts, counts by ending, words with very many tokens, and where the words of
    each chunk stand among them."""

    def merge(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        index: dict[bytes, int] = {}
        places, counts = [], []
        for r in rows:
            words = _words(r["words"], _values(r["lengths"], "<u4").astype(np.int64))
            places.append(np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words)))
            counts.append(_values(r["n"], "<u4").astype(np.int64))
        c = np.bincount(np.concatenate(places), weights=np.concatenate(counts), minlength=len(index)).astype(np.int64)
        words = list(index)
        codes, endings = codes_of(words), endings_of(words)
        by_ending = np.bincount(endings, weights=c, minlength=FIRST_CLASS).astype(np.int64)
        at, hot = np.flatnonzero(by_ending), np.flatnonzero(c > PART)
        row = (rows[0]["bucket"], int(c.sum()), int((c > 0).sum()), _pack(codes, "<i8"), _pack(c, "<i8"), _pack(at, "<u4"), _pack(by_ending[at], "<i8"), _pack(codes[hot], "<i8"), _pack(c[hot], "<i8"), _pack(endings[hot], "<u4"))
        row += (_pack(np.array([r["chunk"] for r in rows]), "<i8"), _pack(np.array([len(p) for p in places]), "<u4"), _pack(np.concatenate(places), "<u4"))
        return pa.Table.from_batches([_table(_schema(VOCABULARY), [row])])

    return asked.groupBy("bucket").applyInArrow(merge, VOCABULARY)


@dataclass(frozen=True)
class Plan:
    """Which bucket a pair belongs to. Groups are numbered: those of each ending, then the parts of each frequent word."""

    first: np.ndarray  # of each ending its first group
    parts: np.ndarray  # and how many it has
    hot: np.ndarray  # sorted codes of words with a restaurant in parts
    hot_first: np.ndarray
    hot_parts: np.ndarray
    hot_count: np.ndarray
    bucket: np.ndarray  # of each group
    buckets: int

    def groups(self, contexts: np.ndarray, endings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each context (its code and ending) its group, and which of the frequent words it is, or -1."""
        own = self.first[endings] + contexts % self.parts[endings]
        if not len(self.hot):
            return own, np.full(len(own), -1)
        at = np.minimum(np.searchsorted(self.hot, contexts), len(self.hot) - 1)
        return own, np.where(self.hot[at] == contexts, at, -1)

    def scales(self, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each group: how many parts its restaurants have, and their customers if it is a part of one restaurant, else 0."""
        scale, known = np.ones(len(groups), np.int64), np.zeros(len(groups), np.int64)
        if len(self.hot):
            at = np.clip(np.searchsorted(self.hot_first, groups, side="right") - 1, 0, None)
            own = (groups >= self.hot_first[at]) & (groups < self.hot_first[at] + self.hot_parts[at])
            scale[own], known[own] = self.hot_parts[at[own]], self.hot_count[at[own]]
        return scale, known


def plan_of(vocabulary: DataFrame, texts: int) -> tuple[Plan, int, int]:
    """The plan, training tokens and distinct training words. texts: training texts, the customers of the start's restaurant."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                at, n = _values(r["endings"], "<u4").astype(np.int64), _values(r["ending_n"], "<i8")
                hot, hot_n, end = _values(r["hot"], "<i8"), _values(r["hot_n"], "<i8"), _values(r["hot_end"], "<u4").astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([at, end, np.full(len(hot), -1)])), pa.array(np.concatenate([np.full(len(at), -1), np.full(len(end), -1), hot])), pa.array(np.concatenate([n, -hot_n, hot_n]))], names=["ending", "code", "n"])

    sums = vocabulary.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t"), F.coalesce(F.sum("distinct"), F.lit(0)).alias("d")).first()
    rows = vocabulary.select("endings", "ending_n", "hot", "hot_n", "hot_end").mapInArrow(run, "ending long, code long, n long").groupBy("ending", "code").agg(F.sum("n").alias("n")).toPandas()
    size = np.zeros(FIRST_CLASS + 1, np.int64)  # by ending, without the frequent words
    endings = rows[rows["ending"] >= 0]
    size[endings["ending"].to_numpy(np.int64)] = endings["n"].to_numpy(np.int64)
    size[FIRST_CLASS] = texts if texts <= PART else 0
    frequent = sorted([(int(c), int(n)) for c, n in rows[rows["ending"] < 0][["code", "n"]].itertuples(index=False)] + ([(START, texts)] if texts > PART else []))
    hot, count = (np.array([x[k] for x in frequent], np.int64) for k in range(2))
    parts = np.maximum(1, -(-size // PART))
    hot_parts = -(-count // PART)
    first = np.cumsum(parts) - parts
    hot_first = int(parts.sum()) + np.cumsum(hot_parts) - hot_parts
    load = np.concatenate([np.repeat(size // parts, parts), np.repeat(count // np.maximum(hot_parts, 1), hot_parts)])
    buckets = max(1, -(-int(sums["t"]) // BUCKET_TOKENS))
    heap = [(0, k) for k in range(buckets)]
    bucket = np.zeros(len(load), np.int32)
    for g in np.argsort(-load, kind="stable").tolist():  # the largest first, each to the emptiest bucket
        if not load[g]:
            bucket[g] = g % buckets
            continue
        have, k = heapq.heappop(heap)
        bucket[g] = k
        heapq.heappush(heap, (have + int(load[g]), k))
    return Plan(first, parts, hot, hot_first, hot_parts, count, bucket, buckets), int(sums["t"]), int(sums["d"])


class Pairs:
    """The distinct pairs (word before, word) of a chunk, by bucket, group, context and word."""

    def __init__(self, own: Chunk, plan: Plan):
        n = len(own.words)
        before = np.empty_like(own.numbers)
        before[1:] = own.numbers[:-1]
        before[np.cumsum(own.lengths) - own.lengths] = n
        pairs, self.back = np.unique(before * n + own.numbers, return_inverse=True)
        del before
        contexts, self.words = pairs // n, pairs % n
        self.count = np.bincount(self.back[own.train], minlength=len(pairs))
        # Contexts by number; after them the parts of frequent ones, each a group of its own.
        codes = np.append(own.codes, START)
        group, hot = plan.groups(codes, np.append(endings_of(own.words), FIRST_CLASS))
        base = int(plan.parts.sum())
        every = np.concatenate([group, np.arange(base, len(plan.bucket))])
        split = np.flatnonzero(hot[contexts] >= 0)
        if len(split):
            at = hot[contexts[split]]
            contexts[split] = n + 1 + plan.hot_first[at] - base + own.codes[self.words[split]] % plan.hot_parts[at]
        names = np.concatenate([codes, np.repeat(plan.hot, plan.hot_parts)])
        rank, place = np.empty(len(every), np.int64), np.empty(n, np.int64)
        rank[np.lexsort((names, every, plan.bucket[every]))] = np.arange(len(every))
        place[np.argsort(own.codes, kind="stable")] = np.arange(n)
        self.order = np.argsort(rank[contexts] * n + place[self.words], kind="stable")
        self.group, self.context_code, self.word_code = every[contexts], names[contexts], own.codes[self.words]
        self.bucket = plan.bucket[self.group]

    def by_bucket(self) -> Iterator[tuple[int, np.ndarray]]:
        own = self.bucket[self.order]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1, [len(own)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if a < b:
                yield int(own[a]), self.order[a:b]


PAIRS = "bucket int, chunk long, groups binary, contexts binary, sizes binary, words binary, n binary"
RESTAURANTS = "bucket int, groups binary, contexts binary, sizes binary, words binary, n binary, chunks binary, pairs binary, place binary"


def pairs_asked(chunks: DataFrame, plan: Plan) -> DataFrame:
    schema, shared = _schema(PAIRS), chunks.sparkSession.sparkContext.broadcast(plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = Chunk(row)
                pairs = Pairs(own, shared.value)
                for k, which in pairs.by_bucket():
                    group, context = pairs.group[which], pairs.context_code[which]
                    begins = np.flatnonzero(np.concatenate([[True], (np.diff(group) != 0) | (np.diff(context) != 0)]))
                    sizes = np.diff(np.append(begins, len(which)))
                    yield _table(schema, [(k, own.chunk, _rising(group[begins]), _pack(context[begins], "<i8"), _pack(sizes, "<u4"), _pack(pairs.word_code[which], "<i8"), _pack(pairs.count[which], "<u4"))])
                del own, pairs
        give_back()

    return chunks.mapInArrow(run, PAIRS)


def restaurants_of(asked: DataFrame) -> DataFrame:
    """A row for each bucket: contexts with their group, pairs with their training count, and where each chunk's pairs stand."""

    def merge(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        groups = np.concatenate([_risen(r["groups"]) for r in rows])
        contexts = np.concatenate([_values(r["contexts"], "<i8") for r in rows])
        order = np.lexsort((contexts, groups))
        fresh = np.concatenate([[True], (np.diff(groups[order]) != 0) | (np.diff(contexts[order]) != 0)])
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(fresh) - 1
        groups, contexts = groups[order][fresh], contexts[order][fresh]
        sizes = np.concatenate([_values(r["sizes"], "<u4").astype(np.int64) for r in rows])
        key = np.repeat(number, sizes) << 40 | np.concatenate([_values(r["words"], "<i8") for r in rows])
        pairs, place = np.unique(key, return_inverse=True)
        n = np.bincount(place, weights=np.concatenate([_values(r["n"], "<u4") for r in rows]), minlength=len(pairs)).astype(np.int64)
        each = [int(_values(r["sizes"], "<u4").astype(np.int64).sum()) for r in rows]
        steps = np.concatenate([np.diff(p, prepend=0) for p in np.split(place, np.cumsum(each)[:-1])])
        row = (rows[0]["bucket"], _rising(groups), _pack(contexts, "<i8"), _pack(np.bincount(pairs >> 40, minlength=len(groups)), "<u4"), _pack(pairs & (1 << 40) - 1, "<i8"), _pack(n, "<u4"))
        row += (_pack(np.array([r["chunk"] for r in rows]), "<i8"), _pack(np.array(each), "<u4"), _pack(steps, "<i4"))
        return pa.Table.from_batches([_table(_schema(RESTAURANTS), [row])])

    return asked.groupBy("bucket").applyInArrow(merge, RESTAURANTS)


class Bucket:
    """A row of restaurants_of, unpacked: contexts, pairs, and the (group, word) dishes above them."""

    def __init__(self, row: dict):
        self.bucket = row["bucket"]
        group = _risen(row["groups"])
        self.groups, self.of_context = np.unique(group, return_inverse=True)
        self.sizes = _values(row["sizes"], "<u4").astype(np.int64)
        self.context = np.repeat(np.arange(len(group)), self.sizes)
        self.word_code, self.count = _values(row["words"], "<i8"), _values(row["n"], "<u4").astype(np.int64)
        self.dishes, self.dish = np.unique(self.of_context[self.context] << 40 | self.word_code, return_inverse=True)
        self.dish_group, self.dish_code = self.dishes >> 40, self.dishes & (1 << 40) - 1
        served = np.bincount(self.dish, weights=self.count, minlength=len(self.dishes)) > 0
        self.codes, self.at_root = np.unique(self.dish_code, return_inverse=True)  # words, and which one a dish is
        self.serving = np.bincount(self.at_root, weights=served, minlength=len(self.codes)).astype(np.int64)  # groups that serve a word


ASKED = "word_bucket int, bucket int, codes binary, k binary"
ROOT = "kind int, word_bucket int, bucket int, codes binary, k binary"


def root_asked(restaurants: DataFrame, buckets: int) -> DataFrame:
    schema = _schema(ASKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = Bucket(row)
                place = own.codes * buckets >> 40
                cuts = np.searchsorted(place, np.arange(buckets + 1))
                for k in range(buckets):
                    if cuts[k] < cuts[k + 1]:
                        part = slice(cuts[k], cuts[k + 1])
                        yield _table(schema, [(k, own.bucket, _rising(own.codes[part]), _pack(own.serving[part], "<u4"))])
        give_back()

    return restaurants.mapInArrow(run, ASKED)


def root_of(asked: DataFrame) -> DataFrame:
    """Rows of kind 0, the customers of each word of a bucket of words; rows of kind 1, those of the words that a bucket asked for."""

    def merge(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["bucket"])
        asked = [_risen(r["codes"]) for r in rows]
        codes, place = np.unique(np.concatenate(asked), return_inverse=True)
        k = np.bincount(place, weights=np.concatenate([_values(r["k"], "<u4") for r in rows]), minlength=len(codes)).astype(np.int64)
        out = [(0, rows[0]["word_bucket"], -1, _rising(codes), _pack(k, "<i8"))]
        for r, p in zip(rows, np.split(place, np.cumsum([len(x) for x in asked])[:-1]), strict=True):
            out.append((1, r["word_bucket"], r["bucket"], b"", _pack(k[p], "<i8")))
        return pa.Table.from_batches([_table(_schema(ROOT), out)])

    return asked.groupBy("word_bucket").applyInArrow(merge, ROOT)


def root_parameters(root: DataFrame) -> Root:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column(0):
                k, n = np.unique(_values(packed.as_py(), "<i8"), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n.astype(np.int64))], names=["k", "n"])

    rows = root.filter("kind = 0").select("k").mapInArrow(run, "k long, n long").filter("k > 0").groupBy("k").agg(F.sum("n").alias("n")).toPandas()  # distinct numbers alone
    k, n = rows["k"].to_numpy(np.float64), rows["n"].to_numpy(np.float64)
    discount, strength = fit_root(k, n)
    return Root(discount, strength, int(n.sum()), int(k @ n))


SEATED = "kind int, chunk long, bucket int, word_bucket int, share binary, weight binary, sizes binary, codes binary, k binary, d double, s double, d2 double, s2 double"


def seated(restaurants: DataFrame, root: DataFrame, plan: Plan, parameters: Root, word_buckets: int, sweeps: int, burn_in: int) -> DataFrame:
    """Rows of kind 0: of a chunk's pairs in a bucket their shares, and by context the root's weight; of kind 1: tables beyond the
    first that a bucket's dishes have at the root; of kind 2: a bucket's parameters."""
    schema, shared = _schema(SEATED), restaurants.sparkSession.sparkContext.broadcast((plan, parameters))
    none = (None,) * 4

    def seat(own_rows: pa.Table, replies: pa.Table) -> pa.Table:
        if not own_rows.num_rows:
            return pa.Table.from_batches([_table(schema, [])])
        plan, parameters = shared.value
        row = own_rows.to_pylist()[0]
        own = Bucket(row)
        told = sorted(replies.select(["word_bucket", "k"]).to_pylist(), key=lambda r: r["word_bucket"])
        customers = np.concatenate([_values(r["k"], "<i8") for r in told])
        scale, known = plan.scales(own.groups)
        share, weight, tables, (d, s, d2, s2) = sample(
            own.dish_group, own.of_context, own.context, own.dish, own.count, parameters.probability(customers)[own.at_root], scale, known[own.of_context], np.random.default_rng(own.bucket), sweeps, burn_in
        )
        out: list[tuple] = [(2, -1, own.bucket, -1, None, None, None, None, None, d, s, d2, s2)]
        more = np.bincount(own.at_root, weights=np.maximum(tables - 1, 0), minlength=len(own.codes)).astype(np.int64)
        where = np.flatnonzero(more)
        place = own.codes[where] * word_buckets >> 40
        for k in np.unique(place).tolist():
            part = where[place == k]
            out.append((1, -1, own.bucket, k, None, None, None, _rising(own.codes[part]), _pack(more[part], "<u4"), *none))
        steps, each = _values(row["place"], "<i4").astype(np.int64), _values(row["pairs"], "<u4").astype(np.int64)
        for chunk, part in zip(_values(row["chunks"], "<i8").tolist(), np.split(steps, np.cumsum(each)[:-1]), strict=True):
            at = np.cumsum(part)
            contexts = own.context[at]
            begins = np.flatnonzero(np.concatenate([[True], np.diff(contexts) != 0]))
            out.append((0, chunk, own.bucket, -1, _shares(share[at]), _shares(weight[contexts[begins]]), _pack(np.diff(np.append(begins, len(at))), "<u4"), None, None, *none))
        return pa.Table.from_batches([_table(schema, out)])

    replies = root.filter("kind = 1").select(F.col("bucket").alias("own"), "word_bucket", "k")
    return restaurants.groupBy("bucket").cogroup(replies.groupBy("own")).applyInArrow(seat, SEATED)


REPLIES = "of long, kind int, part int, one binary, two binary, three binary"


def words_told(vocabulary: DataFrame, root: DataFrame, seats: DataFrame, parameters: Root) -> DataFrame:
    """For each chunk and bucket of words: the words' training counts and their probabilities at the root."""
    schema, shared = _schema(REPLIES), vocabulary.sparkSession.sparkContext.broadcast(parameters)

    def tell(known: pa.Table, served: pa.Table) -> pa.Table:
        if not known.num_rows:
            return pa.Table.from_batches([_table(schema, [])])
        row = known.to_pylist()[0]
        codes, c = _values(row["codes"], "<i8"), _values(row["c"], "<i8")
        rows = served.select(["codes", "k"]).to_pylist()
        have = np.concatenate([_risen(r["codes"]) for r in rows]) if rows else np.zeros(0, np.int64)
        n = np.concatenate([_values(r["k"], "<i8" if r["kind"] == 0 else "<u4").astype(np.int64) for r in served.select(["kind", "k"]).to_pylist()]) if rows else np.zeros(0, np.int64)
        names, at = np.unique(np.concatenate([codes, have]), return_inverse=True)
        k = np.bincount(at[len(codes) :], weights=n, minlength=len(names))[at[: len(codes)]]
        p = shared.value.probability(k)
        sizes, place = _values(row["sizes"], "<u4").astype(np.int64), _values(row["place"], "<u4").astype(np.int64)
        parts = np.split(place, np.cumsum(sizes)[:-1])
        return pa.Table.from_batches([_table(schema, [(chunk, 1, row["bucket"], _pack(c[own], "<i8"), _pack(p[own], "<f4"), None) for chunk, own in zip(_values(row["chunks"], "<i8").tolist(), parts, strict=True)])])

    served = root.filter("kind = 0").select("kind", "word_bucket", "codes", "k").unionByName(seats.filter("kind = 1").select("kind", "word_bucket", "codes", "k"))
    return vocabulary.groupBy("bucket").cogroup(served.groupBy("word_bucket")).applyInArrow(tell, REPLIES)


def score_documents(docs: DataFrame, held_out, *, text: str = "text", doc_id: str = "doc_id", sweeps: int = SWEEPS, burn_in: int = BURN_IN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row; the model learns from the others."""
    spark = docs.sparkSession
    marked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text).alias("text"))
    sizes = marked.agg(F.sum(F.octet_length(F.col("text").cast("string")).cast("long")).alias("bytes"), F.count_if(~F.col("held_out")).alias("texts")).first()
    word_buckets = max(4, -(-(sizes["bytes"] or 0) // WORD_BYTES))
    chunks = materialise(chunked(marked), "chunks")
    vocabulary = materialise(vocabulary_of(words_asked(chunks, word_buckets)), "vocabulary")
    forget_shuffles(spark)
    plan, tokens, words = plan_of(vocabulary, sizes["texts"])
    restaurants = materialise(restaurants_of(pairs_asked(chunks, plan)), "restaurants")
    forget_shuffles(spark)
    root = materialise(root_of(root_asked(restaurants, word_buckets)), "root")
    parameters = root_parameters(root)
    seats = materialise(seated(restaurants, root, plan, parameters, word_buckets, sweeps, burn_in), "seats")
    more = seats.filter("kind = 1").select("k").mapInArrow(_sums, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parameters = Root(parameters.discount, parameters.strength, parameters.words, parameters.customers + more)
    discard(restaurants)
    forget_shuffles(spark)
    told = words_told(vocabulary, root, seats, parameters)
    pairs_told = seats.filter("kind = 0").select(F.col("chunk").alias("of"), F.lit(0).alias("kind"), F.col("bucket").alias("part"), F.col("share").alias("one"), F.col("weight").alias("two"), F.col("sizes").alias("three"))
    scale = tokens + words + 1
    shared = spark.sparkContext.broadcast(plan)

    def total(texts: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        told = sorted(replies.to_pylist(), key=lambda r: (r["kind"], r["part"]))
        for row in texts.to_pylist():
            own = Chunk(row)
            pairs = Pairs(own, shared.value)
            c, p = np.zeros(len(own.words), np.int64), np.zeros(len(own.words))
            for (_, which), r in zip(own.by_bucket(word_buckets), [r for r in told if r["kind"] == 1], strict=True):
                c[which], p[which] = _values(r["one"], "<i8"), _values(r["two"], "<f4")
            log = np.zeros(len(pairs.count))
            for (_, which), r in zip(pairs.by_bucket(), [r for r in told if r["kind"] == 0], strict=True):
                weight = np.repeat(_values(r["two"], "<f4").astype(np.float64), _values(r["three"], "<u4").astype(np.int64))
                log[which] = np.log10(np.maximum(_values(r["one"], "<f4") + weight * p[pairs.words[which]], 1e-300))
            base = np.log10((c + 1.0) / scale)
            sums = lambda x, own=own: np.add.reduceat(x, np.cumsum(own.lengths) - own.lengths)
            out.append(
                pa.table(
                    {
                        "doc_id": pa.array(own.ids, mask=(own.marks & 2) > 0),
                        "held_out": pa.array((own.marks & 1) > 0),
                        "n_tokens": pa.array(own.lengths),
                        "n_known": pa.array(sums((c[own.numbers] > 0).astype(np.int64))),
                        "train_tokens": pa.array(np.full(len(own.lengths), tokens)),
                        "base_score": pa.array(sums(base[own.numbers])),
                        "score": pa.array(sums(log[pairs.back])),
                    }
                )
            )
        return pa.concat_tables(out) if out else pa.table({c: pa.array([], t) for c, t in (("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()))})

    kinds = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return chunks.groupBy("chunk").cogroup(told.unionByName(pairs_told).groupBy("of")).applyInArrow(total, kinds)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([int(_values(x.as_py(), "<u4").sum()) for x in batch.column(0)], pa.int64())], names=["n"])


def score_held_out(docs: DataFrame, **how) -> DataFrame:
    """Ids whose crc32 mod 7 is 2 are held out."""
    return score_documents(docs, bucket_of("doc_id", 7) == 2, **how)


def perplexity(scores: DataFrame) -> DataFrame:
    """held_out, tokens, and perplexity a token under the base and under the model."""
    each = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scores.groupBy("held_out").agg(F.sum("n_tokens").alias("tokens"), each("base_score").alias("base_perplexity"), each("score").alias("perplexity"))

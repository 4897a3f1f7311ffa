"""Removal of repeated byte strings, found by distributed suffix sorting (linear grouping construction).

A byte goes if some string of `length` bytes covers it that also starts elsewhere in the corpus. Which suffixes are
sorted together:

* The *anchor* of a start i is the leftmost smallest hash of 8 bytes among the `reach` positions from i. It depends on
  the string at i alone, so equal strings have their anchors at the same place. The starts with one anchor are an
  interval; it and the strings that begin there form the anchor's *segment*.
* Suffixes are dealt out by the `length - reach + 1` bytes at their anchor, all of which lie within every string of
  that anchor: equal strings always meet. Anchors whose bytes occur once are done with at that point.
* Segments that are equal as a whole are counted, not moved: all their starts repeat. For an anchor with different
  segments one copy of each goes to a task. There the segments' blocks of 16 bytes (aligned to the anchor, named by
  rank) are sorted as suffixes by grouping_sort, common prefixes of neighbours tell which runs of blocks repeat, and an
  comparison of whole strings, by 64-bit fingerprints, settles the starts in those runs.

An anchor with more than `crowd` different segments isn't brought to one task: for those the strings themselves are
dealt out by a 128-bit digest and counted, which is exact at any size.

Defined results: null and empty texts have 0 bytes and keep the hash of nothing; texts shorter than `length` lose
nothing; rows that repeat a doc_id with the same text are copies of each other; null ids are ids like any other;
an empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, materialise, small_batches
from .grouping_sort import common_prefixes, suffix_array

LENGTH, REACH, BLOCK = 400, 256, 16
_GRAM = 8
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_PART = 1 << 20  # positions whose anchors are found at a time


def _gram_hashes(data: bytes, at: int, count: int) -> np.ndarray:
    """Hashes of the 8 bytes at each of `count` positions from `at`."""
    own = np.frombuffer(data, np.uint8, count + _GRAM - 1, at)
    grams = np.lib.stride_tricks.sliding_window_view(own, _GRAM)
    h = np.ascontiguousarray(grams).view(np.uint64).ravel()
    h = (h ^ (h >> np.uint64(32))) * _A
    h ^= h >> np.uint64(29)
    h *= _B
    return h ^ (h >> np.uint64(32))


def _leftmost_minima(h: np.ndarray, reach: int) -> np.ndarray:
    """For each start, the position of the leftmost smallest value among `reach` from there."""
    n = len(h) - reach + 1
    pad = -len(h) % reach
    full = np.concatenate([h, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, reach)
    front = np.minimum.accumulate(full, axis=1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[:n], front[reach - 1 : reach - 1 + n])
    # A position is the leftmost minimum of a start i if it holds least[i]; starts go on to the next holder when it is passed.
    change = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    value = least[change]
    ends = np.concatenate([change[1:], [n]])
    out = np.empty(n, np.int64)
    for begin, end, v in zip(change.tolist(), ends.tolist(), value.tolist(), strict=True):
        stretch = h[begin : end - 1 + reach]
        first = int(np.argmax(stretch == v)) + begin
        if first >= end - 1:
            out[begin:end] = first
            continue
        holders = np.flatnonzero(stretch == v) + begin
        starts = np.arange(begin, end)
        out[begin:end] = holders[np.searchsorted(holders, starts)]
    return out


def anchors(data: bytes, length: int, reach: int) -> list[tuple[int, int, int]]:
    """(anchor, first start, last start) in order, covering the starts 0 .. len(data) - length."""
    starts = len(data) - length + 1
    out: list[tuple[int, int, int]] = []
    for at in range(0, max(0, starts), _PART):
        count = min(_PART, starts - at)
        where = _leftmost_minima(_gram_hashes(data, at, count + reach - 1), reach) + at
        new = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        last = np.concatenate([new[1:], [count]]) - 1
        rows = list(zip(where[new].tolist(), (new + at).tolist(), (last + at).tolist(), strict=True))
        if out and rows and out[-1][0] == rows[0][0]:
            rows[0] = (rows[0][0], out.pop()[1], rows[0][2])
        out += rows
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def cut_up(docs: DataFrame, length: int, reach: int) -> DataFrame:
    """Rows without text: doc_id, k1, k2 (row key), n_bytes, sha, and an array of anchors."""
    anchor = pa.struct([("key", pa.int64()), ("seg", pa.int64()), ("at", pa.int32()), ("first", pa.int32()), ("last", pa.int32())])
    schema = pa.schema([("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("n_bytes", pa.int64()), ("sha", pa.string()), ("anchors", pa.list_(anchor))])
    core = length - reach + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_batches(batch):
                texts = as_bytes(part.column(3))
                offsets, keys, segs, rows = [0], [], [], []
                for data in texts:
                    found = anchors(data, length, reach)
                    rows += found
                    for at, first, last in found:
                        keys.append(_signed(xxhash.xxh3_64_intdigest(data[at : at + core])))
                        segs.append(_signed(xxhash.xxh3_64_intdigest(data[first : last + length], seed=at - first)))
                    offsets.append(len(rows))
                places = np.array(rows, np.int32).reshape(-1, 3)
                flat = pa.StructArray.from_arrays([pa.array(keys, pa.int64()), pa.array(segs, pa.int64()), *(pa.array(places[:, k]) for k in range(3))], fields=list(anchor))
                shas = [hashlib.sha256(x).hexdigest() for x in texts]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(3)), pa.array([len(x) for x in texts], pa.int64()), pa.array(shas), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)], schema=schema)

    return docs.mapInArrow(run, "doc_id long, k1 long, k2 long, n_bytes long, sha string, anchors array<struct<key:long,seg:long,at:int,first:int,last:int>>")


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last index of each run of true."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(int(a), int(b) - 1) for a, b in zip(edge[::2], edge[1::2], strict=True)]


_TABLE = np.random.default_rng(20).integers(0, 1 << 64, 256, np.uint64, endpoint=False)  # one number for each byte value
_BASE = np.uint64(0x2545F4914F6CDD1D)  # odd, so that powers of it can be divided by
_UNBASE = np.uint64(pow(0x2545F4914F6CDD1D, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _A
    return (x ^ (x >> np.uint64(29))) * _B


class Fingerprints:
    """64-bit fingerprints of any substrings of a byte array, from one running sum."""

    def __init__(self, data: bytes):
        values = _TABLE[np.frombuffer(data, np.uint8)]
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * _powers(_BASE, len(data)), dtype=np.uint64)])
        self.inverse = _powers(_UNBASE, len(data) + 1)

    def of(self, at: np.ndarray, length: int) -> np.ndarray:
        return (self.sums[at + length] - self.sums[at]) * self.inverse[at]


def repeated_starts(segments: list[tuple[int, int, bytes]], length: int, block: int = BLOCK) -> list[list[tuple[int, int]]]:
    """Segments are (group, offset of the anchor, bytes); per segment the runs of starts whose string some other segment of its group has too."""
    sizes = np.array([len(x[2]) for x in segments])
    base = np.cumsum(sizes) - sizes  # where each segment begins in the whole
    anchor = np.array([x[1] for x in segments])
    group = _mix(np.array([x[0] for x in segments], np.int64).view(np.uint64))
    prints = Fingerprints(b"".join(x[2] for x in segments))

    lead = anchor % block
    count = np.maximum((sizes - lead) // block, 0)
    first = np.cumsum(count) - count
    owner = np.repeat(np.arange(len(segments)), count)
    number = np.arange(count.sum()) - first[owner]
    offset = number - anchor[owner] // block  # blocks from the anchor: equal only where they are aligned alike
    value = _mix(prints.of(base[owner] + lead[owner] + number * block, block) + _mix(group[owner] + offset.astype(np.uint64) * _A))
    _, names, counts = np.unique(value, return_inverse=True, return_counts=True)

    need = (length - block + 1) // block  # whole blocks that any string of this length holds
    # A run of blocks that are all found elsewhere can repeat only if it is long enough; everything else ends a suffix.
    shared = counts[names] > 1
    edge = np.zeros(len(shared) + 1, bool)
    edge[first[count > 0]] = True
    edge[-1] = True
    begins = np.flatnonzero(shared & (edge[:-1] | ~np.concatenate([[False], shared[:-1]])))
    ends = np.flatnonzero(shared & (edge[1:] | ~np.concatenate([shared[1:], [False]])))
    long = ends - begins + 1 >= need
    begins, ends = begins[long], ends[long]
    spans = ends - begins + 1
    symbols = np.empty(int(spans.sum()) + len(spans), np.int64)
    place = np.full(len(symbols), -1, np.int64)
    stops = np.cumsum(spans + 1) - 1
    inner = np.ones(len(symbols), bool)
    inner[stops] = False
    place[inner] = np.arange(int(spans.sum())) + np.repeat(begins - (np.cumsum(spans) - spans), spans)
    symbols[inner] = names[place[inner]]
    symbols[stops] = len(counts) + np.arange(len(spans))  # every end is a symbol of its own
    text = symbols.tolist()
    order = suffix_array(text)
    shares = np.array([*common_prefixes(text, order), 0], np.int64)
    good = np.zeros(len(names), bool)
    if len(text):
        here = place[np.array(order)]
        long_here = (np.maximum(shares[:-1], shares[1:]) >= need) & (here >= 0)
        good[here[long_here]] = True

    # A start's first whole block must be good; the starts before it that reach into no earlier block come along.
    candidate = np.zeros(int(sizes.sum()) + 1, np.int64)
    g = np.flatnonzero(good)
    o = owner[g]
    at = lead[o] + number[g] * block
    low, high = np.maximum(at - block + 1, 0), np.minimum(at, sizes[o] - length)
    some = low <= high
    np.add.at(candidate, base[o][some] + low[some], 1)
    np.add.at(candidate, base[o][some] + high[some] + 1, -1)
    starts = np.flatnonzero(np.cumsum(candidate[:-1]) > 0)
    which = np.searchsorted(base, starts, side="right") - 1
    shift = (starts - base[which] - anchor[which]).astype(np.uint64)
    whole = _mix(prints.of(starts, length) + _mix(group[which] + shift * _A))
    _, back, many = np.unique(whole, return_inverse=True, return_counts=True)
    flags = np.zeros(int(sizes.sum()) + 1, bool)
    flags[starts[many[back] > 1]] = True
    return [_runs(flags[b : b + n]) for b, n in zip(base.tolist(), sizes.tolist(), strict=True)]


def compare_segments(segments: DataFrame, length: int, batch_bytes: int = 6_000_000) -> DataFrame:
    """key, seg, runs for the segments (key, seg, anchor, body), co-located and sorted by key."""
    schema = pa.schema([("key", pa.int64()), ("seg", pa.int64()), ("runs", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))])

    def settle(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        found = repeated_starts([(key, anchor, body) for key, _, anchor, body in rows], length)
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([[{"a": a, "b": b} for a, b in x] for x in found], schema.field(2).type)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, int, bytes]] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= batch_bytes and row[0] != rows[-1][0]:
                    yield settle(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[3])
        if rows:
            yield settle(rows)

    return segments.repartition("key").sortWithinPartitions("key").select("key", "seg", "anchor", "body").mapInArrow(run, "key long, seg long, runs array<struct<a:int,b:int>>")


def compare_crowded(segments: DataFrame, length: int) -> DataFrame:
    """As compare_segments, for anchors with very many segments: every string's digest is counted over all tasks."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, seg, anchor, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = len(body) - length + 1
                digests = [hashlib.blake2b(body[i : i + length], digest_size=16).digest() for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.int64()), pa.array([seg] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([anchor - i for i in range(n)], pa.int32()), pa.array(digests, pa.binary())], names=["key", "seg", "i", "x", "digest"])

    flat = segments.select("key", "seg", "anchor", "body").mapInArrow(strings, "key long, seg long, i int, x int, digest binary")
    many = flat.groupBy("key", "x", "digest").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    return flat.join(many, ["key", "x", "digest"]).groupBy("key", "seg").agg(F.collect_list(F.struct(F.col("i").alias("a"), F.col("i").alias("b"))).alias("runs"))


def remove_repeats(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, reach: int = REACH, crowd: int = 20_000) -> DataFrame:
    """doc_id, k1, k2, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes, null where nothing went)."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    keyed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(doc_id, body).alias("k1"), F.xxhash64(body, doc_id, F.lit(1)).alias("k2"), body.alias("text"))
    cut = materialise(cut_up(keyed, length, reach), "anchors")

    rows = cut.select("k1", "k2", F.explode("anchors").alias("c")).select("k1", "k2", "c.*")
    kinds = rows.groupBy("key", "seg").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "at", "first", "last")).alias("copy"))
    by_key = kinds.groupBy("key").agg(F.count("*").alias("kinds"), F.sum("n").alias("total")).filter("total > 1").select("key", "kinds")
    repeated = materialise(kinds.join(by_key, "key"), "repeated")

    touched = materialise(
        rows.join(repeated.select("key", "seg", "n", "kinds"), ["key", "seg"]).select("k1", "k2", "key", "seg", "first", "last", (F.col("n") > 1).alias("whole")),
        "touched",
    )
    needed = touched.select("k1", "k2").distinct()
    texts = materialise(keyed.join(needed, ["k1", "k2"]).select("k1", "k2", "text").dropDuplicates(["k1", "k2"]), "texts")

    wanted = repeated.filter("kinds > 1").select("key", "seg", "kinds", "copy.*")
    per_text = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("key", "seg", "kinds", "at", "first", "last")).alias("wanted"))

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, own in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([w["key"] for w in own], pa.int64()),
                        pa.array([w["seg"] for w in own], pa.int64()),
                        pa.array([w["kinds"] for w in own], pa.int64()),
                        pa.array([w["at"] - w["first"] for w in own], pa.int32()),
                        pa.array([data[w["first"] : w["last"] + length] for w in own], pa.binary()),
                    ],
                    names=["key", "seg", "kinds", "anchor", "body"],
                )

    segments = texts.join(per_text, ["k1", "k2"]).select("text", "wanted").mapInArrow(slices, "key long, seg long, kinds long, anchor int, body binary")
    segments = materialise(segments, "segments")
    runs = compare_segments(segments.filter(F.col("kinds") <= crowd), length)
    if segments.filter(F.col("kinds") > crowd).limit(1).count():
        runs = runs.unionByName(compare_crowded(segments.filter(F.col("kinds") > crowd), length))
    partly = touched.filter("not whole").join(runs, ["key", "seg"]).select("k1", "k2", F.explode("runs").alias("r"), "first").select("k1", "k2", (F.col("first") + F.col("r.a")).alias("a"), (F.col("first") + F.col("r.b")).alias("b"))
    fully = touched.filter("whole").select("k1", "k2", F.col("first").alias("a"), F.col("last").alias("b"))
    starts = partly.unionByName(fully).distinct().groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("starts"))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_batches(batch, 64):
                out = []
                for data, own in zip(as_bytes(part.column(2)), part.column(3).to_pylist(), strict=True):
                    kept, at, end, spans = [], 0, -1, 0
                    for r in own:
                        if r["a"] > end:
                            kept.append(data[max(at, end) : r["a"]])
                            spans += 1
                            at = r["a"]
                        end = max(end, r["b"] + length)
                    kept.append(data[max(at, end) :])
                    rest = b"".join(kept)
                    out.append((len(data) - len(rest), spans, hashlib.sha256(rest).hexdigest(), rest))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True))], names=["k1", "k2", "n_removed", "n_spans", "left_sha", "kept"])

    stripped = texts.join(starts, ["k1", "k2"]).select("k1", "k2", "text", "starts").mapInArrow(strip, "k1 long, k2 long, n_removed long, n_spans long, left_sha string, kept binary")
    return (
        cut.select("doc_id", "k1", "k2", "n_bytes", "sha")
        .join(stripped, ["k1", "k2"], "left")
        .select("doc_id", "k1", "k2", "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"), F.coalesce("left_sha", "sha").alias("kept_sha256"), "kept")
    )

"""Near-duplicate groups by fast similarity sketching, banding and exact verification.

A document's set holds its distinct shingles. Its sketch has `coordinates` bins filled in rounds: in each of the first
`coordinates` rounds every element is thrown into a hashed bin, in each of the last `coordinates` rounds all elements
go to one fixed bin; a bin keeps the least (round, value) thrown into it, and rounds stop when no bin is empty. So
every coordinate is filled, agreement of two sketches estimates the Jaccard similarity with concentration bounds like
those of full MinHash, and a document with many shingles needs only a round or two.

Documents with equal sets form a class; only classes go on. Bands of `rows` coordinates put classes in buckets (with
128 coordinates in bands of 4 a pair at similarity 0.8 is missed with probability 5e-8). In each bucket the
class that collides most becomes its centre, and members are compared with it on full sets. Classes that a bucket
still holds in different components are then joined by their rarest shingles: as many of each set, in one order of all
shingles, that two similar sets can't do without a common one. A shingle's classes are paired between components only,
never within one; what is paired, and by sizes and places can still be similar, is compared on full sets. No bucket is
expanded into all its pairs, and no cap drops any.

Defined results: null, empty and blank texts have no shingle and are linked with nothing (component_id is their own
id); a text with fewer words than a shingle is one shingle, its whole sequence; rows that repeat a doc_id share the
component of their text, and all of them are kept if that id is the smallest; null ids are never the smallest unless
the component has no other, then component_id is null and kept is false; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, discard, give_back, materialise, small_batches, words_of
from .graph import components

COORDINATES, ROWS = 128, 4
COUNTERS = 1 << 21
SENT_ROWS = 1_000_000  # ids or class numbers that go to every task; beyond, rows are dealt out
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def shingle_set(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - size + 1
    out = h[:n].copy()
    for k in range(1, size):
        out = mix(out * _A + np.uint64(k)) + h[k : n + k]
    return np.unique(mix(out))


def sketch(elements: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """One 64-bit value for each coordinate; coordinates is a power of two. Two sets agree in a coordinate with probability J."""
    shift = np.uint64(64 - (coordinates.bit_length() - 1))
    numbers = np.arange(2 * coordinates, dtype=np.uint64)
    seeds = mix((numbers + np.uint64(1)) * _A)
    out, empty = np.zeros(coordinates, np.uint64), np.ones(coordinates, bool)
    at = 0
    while at < coordinates and empty.any():
        rounds = np.arange(at, min(coordinates, at + max(1, 2048 // len(elements))))
        thrown = np.sort(mix(elements[None, :] ^ seeds[rounds][:, None]), axis=1)
        flat = thrown.ravel()  # by round, then by bin and value: a bin's first entry is what it keeps
        bins, first = np.unique((flat >> shift).astype(np.int64), return_index=True)
        fresh = empty[bins]
        out[bins[fresh]] = mix(flat[first[fresh]] + numbers[rounds[first[fresh] // len(elements)]])
        empty[bins] = False
        at += len(rounds)
    for b in np.flatnonzero(empty):  # the fixed rounds
        least = mix(elements ^ seeds[coordinates + b]).min(keepdims=True)
        out[b] = mix(least + numbers[coordinates + b])[0]
    return out


def band_keys(coordinates: np.ndarray, rows: int) -> np.ndarray:
    parts = coordinates.reshape(-1, rows)
    key = np.arange(len(parts), dtype=np.uint64) * _A
    for k in range(rows):
        key = mix(key * _A + parts[:, k])
    return key.view(np.int64)


def signatures(docs: DataFrame, *, text: str, doc_id: str, shingle: int, coordinates: int, rows: int) -> DataFrame:
    """doc_id, key (a hash of the text), n_shingles, cls (digest of the set, null if empty) and bands, for every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n_shingles", pa.int64()), ("cls", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, np.ndarray] = {}  # copies are often neighbours
        for batch in batches:
            for part in small_batches(batch):
                sizes, digests, bands = [], [], []
                for data in as_bytes(part.column(2)):
                    own = shingle_set(words_of(data), shingle)
                    sizes.append(len(own))
                    if not len(own):
                        digests.append(None)
                        bands.append(None)
                        continue
                    digest = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                    if digest not in seen:
                        if len(seen) > 5000:
                            seen.clear()
                        seen[digest] = band_keys(sketch(own, coordinates), rows)
                    digests.append(digest)
                    bands.append(seen[digest])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], schema=schema)
        seen.clear()
        give_back()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, key long, n_shingles long, cls binary, bands array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, *, text: str, doc_id: str, shingle: int) -> DataFrame:
    """cid, items (the full set as bytes) for the classes `wanted` (cid, cls, doc_id of a member)."""
    chosen = wanted.select("cid", "cls", F.col("doc_id").alias("member"))
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(chosen, F.col("doc_id").eqNullSafe(F.col("member"))).select("cid", "cls", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_batches(batch):
                ids, items = [], []
                for cid, cls, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), as_bytes(part.column(2)), strict=True):
                    own = shingle_set(words_of(data), shingle).tobytes()
                    if hashlib.blake2b(own, digest_size=16).digest() == cls:  # rows that repeat an id may hold other texts
                        ids.append(cid)
                        items.append(own)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(items, pa.binary())], names=["cid", "items"])

    return texts.mapInArrow(run, "cid long, items binary").dropDuplicates(["cid"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union."""
    left = sets.select(F.col("cid").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("cid").alias("b"), F.col("items").alias("y"))
    n, m = F.octet_length("x"), F.octet_length("y")
    both = pairs.join(left, "a").join(right, "b").filter(100 * F.least(n, m) >= percent * F.greatest(n, m)).select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                every = np.sort(np.concatenate([p, q]), kind="stable")
                common = int(np.count_nonzero(every[1:] == every[:-1]))
                keep.append(100 * common >= percent * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def item_counts(sets: DataFrame, size: int = COUNTERS) -> np.ndarray:
    """How often items occur in all sets, in `size` hashed counters. Each task sums its own and sends them in 64 segments;
    whoever gets a segment adds part after part, so that no task holds more than its segments, however many parts come."""
    step = size // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for items in batch.column(0):
                np.add.at(total, (np.frombuffer(items.as_buffer(), np.uint64) % np.uint64(size)).astype(np.int64), 1)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(64), pa.int32()), pa.array([total[k * step : (k + 1) * step].tobytes() for k in range(64)], pa.binary())], names=["segment", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for segment, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                totals.setdefault(segment, np.zeros(step, np.int64))[:] += np.frombuffer(part.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([x.tobytes() for x in totals.values()], pa.binary())], names=["segment", "part"])

    kinds = "segment int, part binary"
    rows = sets.select("items").mapInArrow(run, kinds).repartition("segment").mapInArrow(add, kinds).collect()
    out = np.zeros(size, np.int64)
    for r in rows:  # 64
        out[r["segment"] * step : (r["segment"] + 1) * step] = np.frombuffer(r["part"], np.int64)
    return out


def rare_items(sets: DataFrame, percent: int) -> DataFrame:
    """cid, root, n, pos, item: of each set the n - ceil(percent n / 100) + 1 items that come first in one order of all items,
    rare ones first. Two sets with a similarity of `percent` or more have one of these in common, whatever the order."""
    shared = sets.sparkSession.sparkContext.broadcast(item_counts(sets).astype(np.int32))  # its size is COUNTERS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            columns: list[list[np.ndarray]] = [[] for _ in range(5)]
            for cid, root, items in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                own = np.frombuffer(items.as_buffer(), np.uint64)
                keep = len(own) - -(-percent * len(own) // 100) + 1
                order = np.lexsort((own, counts[(own % np.uint64(len(counts))).astype(np.int64)]))[:keep]
                for column, x in zip(columns, (np.full(len(order), cid), np.full(len(order), root), np.full(len(order), len(own)), np.arange(len(order)), own[order].view(np.int64)), strict=True):
                    column.append(x)
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in columns], names=["cid", "root", "n", "pos", "item"])

    return sets.select("cid", "root", "items").mapInArrow(run, "cid long, root long, n long, pos long, item long")


def _small(table: DataFrame) -> DataFrame:
    """The table, for every task if it has at most SENT_ROWS rows."""
    return F.broadcast(table) if table.count() <= SENT_ROWS else table


def _ordered(pairs: DataFrame, x: str, y: str) -> DataFrame:
    return pairs.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def between_roots(rare: DataFrame, percent: int) -> DataFrame:
    """a, b: classes of different components that share a rare item and can still be similar.

    An item's components are paired first, by what the sizes and places of their classes allow, then the classes of those;
    a component's own classes never meet, however many."""
    rest = F.col("n") - F.col("pos")  # what follows the item, and the item
    of_item = rare.groupBy("item", "root").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max(rest).alias("rest"))
    several = of_item.groupBy("item").agg(F.count("*").alias("k")).filter("k > 1").select("item")
    of_item, rare = of_item.join(several, "item"), rare.join(several, "item")
    left, right = (of_item.select("item", *[F.col(c).alias(c + k) for c in ("root", "least", "most", "rest")]) for k in ("_1", "_2"))

    def possible(least_1: str, most_1: str, rest_1: str, least_2: str, most_2: str, rest_2: str) -> Column:
        """Sets of other sizes can't be similar; at the first item that two sets share, what follows in either must make up the
        intersection that they need."""
        near = (100 * F.col(most_1) >= percent * F.col(least_2)) & (100 * F.col(most_2) >= percent * F.col(least_1))
        return near & ((100 + percent) * F.least(rest_1, rest_2) >= percent * (F.col(least_1) + F.col(least_2)))

    pairs = left.join(right.withColumnRenamed("item", "item_2"), (F.col("item") == F.col("item_2")) & (F.col("root_1") < F.col("root_2")) & possible("least_1", "most_1", "rest_1", "least_2", "most_2", "rest_2")).drop("item_2", "least_1", "most_1", "rest_1")
    one, two = (rare.select(F.col("item").alias("at" + k), F.col("root").alias("of" + k), F.col("cid").alias("cid" + k), F.col("n").alias("n" + k), rest.alias("left" + k)) for k in ("_1", "_2"))
    first = pairs.join(one, (F.col("item") == F.col("at_1")) & (F.col("root_1") == F.col("of_1")) & possible("n_1", "n_1", "left_1", "least_2", "most_2", "rest_2"))
    both = first.join(two, (F.col("item") == F.col("at_2")) & (F.col("root_2") == F.col("of_2")) & possible("n_1", "n_1", "left_1", "n_2", "n_2", "left_2"))
    return _ordered(both, "cid_1", "cid_2")


def _grouped(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", shingle: int = 4, percent: int = 80, coordinates: int = COORDINATES, rows: int = ROWS) -> DataFrame:
    """near_duplicates with the hash of the text (key)."""
    signed = materialise(signatures(docs, text=text, doc_id=doc_id, shingle=shingle, coordinates=coordinates, rows=rows), "signatures")
    classes = signed.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = materialise(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")

    banded = classes.select("cid", "n", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    buckets = materialise(banded.join(shared, "bucket"), "buckets")
    degree = buckets.groupBy("cid").agg(F.sum("size").alias("degree"))
    ranked = buckets.join(degree, "cid")
    centre = ranked.groupBy("bucket").agg(F.max(F.struct("degree", "cid", "n")).alias("c")).select("bucket", F.col("c.cid").alias("centre"), F.col("c.n").alias("centre_n"))
    near = 100 * F.least("n", "centre_n") >= percent * F.greatest("n", "centre_n")
    stars = materialise(_ordered(buckets.join(centre, "bucket").filter(near & (F.col("cid") != F.col("centre"))), "cid", "centre"), "stars")
    wanted = classes.join(buckets.select("cid").distinct(), "cid", "left_semi")
    sets = materialise(sets_of(docs, wanted, text=text, doc_id=doc_id, shingle=shingle), "sets")
    links = materialise(verified(stars, sets, percent), "verified")
    roots = materialise(components(links), "roots")

    placed = buckets.join(roots.select(F.col("node").alias("cid"), "root"), "cid", "left").select("bucket", "cid", F.coalesce("root", "cid").alias("root"))
    split = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("bucket")
    apart = materialise(placed.join(split, "bucket").select("cid", "root").distinct(), "apart")
    rare = materialise(rare_items(sets.join(_small(apart), "cid"), percent), "rare")
    rest = between_roots(rare, percent).join(stars, ["a", "b"], "left_anti")
    more = materialise(verified(rest, sets, percent), "verified")
    if more.limit(1).count():
        discard(roots)
        roots = materialise(components(links.unionByName(more)), "roots")
    discard(buckets, stars, sets, links, apart, rare, more)  # the result needs signatures, classes and roots

    rooted = classes.select("cls", "cid", "doc_id").join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    smallest = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_class = rooted.join(smallest, "root").select("cls", "component_id")
    return signed.select("doc_id", "key", "n_shingles", "cls").join(of_class, "cls", "left").select(
        "doc_id",
        "key",
        "n_shingles",
        F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce(F.when(F.col("cls").isNull(), F.col("doc_id").isNotNull()).otherwise(F.col("doc_id") == F.col("component_id")), F.lit(False)).alias("kept"),
    )


def near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row for each row of docs."""
    return _grouped(docs, **how).drop("key")


def keep_one(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """The rows of docs that stay: of each component the rows with the smallest id; rows that repeat an id and a text are one.

    Components whose ids are all null keep one row for each text. Only ids and hashes of what goes or repeats are joined
    with the texts, which stay where they are unless those are very many."""
    groups = _grouped(docs, text=text, doc_id=doc_id, **how)
    stays = F.col("kept") | (F.col("doc_id").isNull() & F.col("component_id").isNull())
    marks = groups.groupBy("doc_id", "key").agg(F.bool_or(stays).alias("stays"), F.count("*").alias("n")).filter("not stays or n > 1")
    marks = materialise(marks.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "stays"), "marks")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    own = F.col("row")
    same = own.getField(doc_id).cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(own.getField(text)) == F.col("_key"))
    once = rows.join(_small(marks), same, "left_anti").select("row.*")
    repeated = marks.filter("stays")
    if not repeated.limit(1).count():
        return once
    copies = rows.join(_small(repeated), same, "left_semi").select("row", own.getField(doc_id).alias("id"), F.xxhash64(own.getField(text)).alias("key"))
    return once.unionByName(copies.dropDuplicates(["id", "key"]).select("row.*"))

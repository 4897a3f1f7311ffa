"""Quality classifier by importance resampling (hashed n-gram models, Gumbel top-k).

Byte trigrams are hashed into `buckets`, and words that repeat the word before them have a bucket of their own. Two
bag-of-n-gram models are counted: the raw one over every document, the target one over documents labelled good. A document's log importance weight is the sum over its whole
text of log p_target - log p_raw (the target model smoothed towards the raw one, so that rare n-grams say little). Adding Gumbel noise (a fixed hash of the id) and taking the k largest draws k
documents without replacement with probabilities in proportion to their weights. k is not a parameter: it is the sum
over all documents of the calibrated probability of being good, a logistic curve over the weight per n-gram fitted to
labelled rows. `label_rows` bounds the labelled rows used (those with the smallest id hashes); all else covers all data.

Defined results: null texts and texts of fewer than three bytes have no n-gram and are rejected; a null id is a document like any other
(all null ids share one noise value); repeated rows are kept or rejected alike; documents whose rounded score ties
with the k-th are all kept; without labels of either kind nothing is rejected but texts without n-grams; an empty table
gives an empty result; other columns are carried along untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, materialise, small_batches

BUCKETS = 1 << 16  # a power of two
_REPEAT = 3  # a repeated word weighs as much as the trigrams that a short word has
LABEL_ROWS = 20_000
PRIOR = 10.0  # counts by which the target model is drawn towards the raw one in each bucket
_STEPS = 16  # scores are compared in units of 2^-16
_MIDDLE = 1 << 47


def gram_buckets(data: bytes, buckets: int = BUCKETS) -> np.ndarray:
    """The buckets of a text's byte trigrams; bucket `buckets` for each word that repeats the word before it."""
    codes = np.frombuffer(data, np.uint8).astype(np.uint32)
    h = (codes[:-2] << np.uint32(16)) | (codes[1:-1] << np.uint32(8)) | codes[2:] if len(codes) > 2 else codes[:0]
    h = h * np.uint32(0x9E3779B1)
    grams = ((h ^ (h >> np.uint32(15))) & np.uint32(buckets - 1)).astype(np.int64)
    words = data.split()
    again = sum(map(eq, words, islice(words, 1, None)))
    return np.concatenate([grams, np.full(again * _REPEAT, buckets)]) if again else grams


def labelled(docs: DataFrame, labels: DataFrame, *, doc_id: str, rows: int) -> DataFrame:
    """docs' `doc_id` and text with `good`: true, false, or null for documents not in the bounded label sample."""
    one = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") > 0).alias("good"))
    sample = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select(F.col("doc_id").alias("label_id"), "good")
    return docs.join(F.broadcast(sample), F.col(doc_id) == F.col("label_id"), "left").drop("label_id")  # at most `rows` rows are sent


def fit_ratio(marked: DataFrame, buckets: int) -> np.ndarray:
    """log p_target - log p_raw by bucket, from one pass over all texts; each task sends two vectors of counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets + 1, np.int64), np.zeros(buckets + 1, np.int64)
        for batch in batches:
            for part in small_batches(batch):
                for data, good in zip(as_bytes(part.column(0)), part.column(1).to_pylist(), strict=True):
                    counts = np.bincount(gram_buckets(data, buckets), minlength=buckets + 1)
                    raw += counts
                    if good:
                        target += counts
        if raw.any():
            at = np.flatnonzero(raw)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "n_raw", "n_target"])

    rows = marked.select("text", "good").mapInArrow(run, "bucket long, n_raw long, n_target long").groupBy("bucket").agg(F.sum("n_raw").alias("n_raw"), F.sum("n_target").alias("n_target")).collect()
    raw, target = np.zeros(buckets + 1), np.zeros(buckets + 1)
    for r in rows:  # at most `buckets` + 1
        raw[r["bucket"]] += r["n_raw"]
        target[r["bucket"]] += r["n_target"]
    if not target.any():
        return np.zeros(buckets + 1)
    return np.log((target + PRIOR) / (target.sum() * raw / raw.sum() + PRIOR))


def weigh(marked: DataFrame, ratio: np.ndarray) -> DataFrame:
    """Adds log_weight and n_grams to every column but text."""
    shared = marked.sparkSession.sparkContext.broadcast(ratio)
    kept = [f for f in marked.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in small_batches(batch):
                grams = [gram_buckets(x, len(own) - 1) for x in as_bytes(part.column(0))]
                weights = [float(own[g].sum()) for g in grams]
                columns = [part.column(k) for k in range(1, part.num_columns)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(weights, pa.float64()), pa.array([len(g) for g in grams], pa.int64())], names=[*part.schema.names[1:], "log_weight", "n_grams"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return marked.select("text", *[f.name for f in kept]).mapInArrow(run, f"{kinds}, log_weight double, n_grams long")


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and bias of a ridge-penalised logistic curve, by Newton's method."""
    a = np.stack([x, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + 1e-3 * w
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2), g)
        w -= step * min(1.0, 5.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def gumbel(column: str, seed: int) -> Column:
    """-ln(-ln u) of a hash of the id; u lies strictly between 0 and 1."""
    u = (F.pmod(F.xxhash64(F.col(column), F.lit(seed)), F.lit(1 << 40)).cast("double") + 0.5) / float(1 << 40)
    return -F.log(-F.log(u))


def kth_largest(scores: DataFrame, column: str, k: int) -> int:
    """The k-th largest of a long column of 48-bit values: three rounds of counts, 65,536 at most come to the driver."""
    prefix, left = 0, k
    for shift in (32, 16, 0):
        digit = F.shiftrightunsigned(F.col(column), shift)
        inside = scores if shift == 32 else scores.filter(F.shiftrightunsigned(F.col(column), shift + 16) == prefix)
        counts = {r["d"]: r["n"] for r in inside.groupBy(digit.alias("d")).agg(F.count("*").alias("n")).collect()}
        for d in sorted(counts, reverse=True):
            if counts[d] >= left:
                prefix = d
                break
            left -= counts[d]
        else:
            return 0
    return prefix


def score_key(column: Column) -> Column:
    """A perturbed weight as a long of 48 bits, in the same order."""
    return F.least(F.lit(2 * _MIDDLE - 1), F.greatest(F.lit(0), F.floor(column * (1 << _STEPS)).cast("long") + _MIDDLE))


def draw(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", buckets: int = BUCKETS, label_rows: int = LABEL_ROWS, seed: int = 11) -> tuple[np.ndarray, DataFrame, int]:
    """The log ratios, every document's id, log_weight, n_grams and key, and the least key that the sample holds."""
    packed = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    marked = labelled(packed, labels, doc_id="id", rows=label_rows)
    ratio = fit_ratio(marked, buckets)
    weighed = materialise(weigh(marked, ratio), "weights")
    sample = weighed.filter("good is not null and n_grams > 0").select("good", (F.col("log_weight") / F.col("n_grams")).alias("x")).collect()  # at most label_rows ids
    y = np.array([r["good"] for r in sample], float)
    if len(y) and 0 < y.sum() < len(y):
        x = np.array([r["x"] for r in sample])
        scale = float(x.std()) or 1.0
        slope, bias = fit_logistic((x - x.mean()) / scale, y)
        slope, bias = slope / scale, bias - slope * x.mean() / scale
    else:
        slope, bias = 0.0, 50.0
    logit = F.greatest(F.lit(-50.0), F.least(F.lit(50.0), slope * F.col("log_weight") / F.col("n_grams") + bias))
    k = round(weighed.filter("n_grams > 0").agg(F.sum(1 / (1 + F.exp(-logit)))).first()[0] or 0)
    scored = weighed.withColumn("key", score_key(F.col("log_weight") + gumbel("id", seed)))
    return ratio, scored, kth_largest(scored.filter("n_grams > 0"), "key", k) if k > 0 else 2 * _MIDDLE


def resample(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """id, log_weight, n_grams and kept, for every document."""
    _, scored, cut = draw(docs, labels, **how)
    return scored.select("id", "log_weight", "n_grams", ((F.col("n_grams") > 0) & (F.col("key") >= cut)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", seed: int = 11, **how) -> DataFrame:
    """The rows of docs that the sample holds, all columns. Weights are computed once more where the rows are, so no text is shuffled."""
    ratio, _, cut = draw(docs, labels, text=text, doc_id=doc_id, seed=seed, **how)
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    rows = docs.select(F.col(text).alias("text"), gumbel(doc_id, seed).alias("noise"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in small_batches(batch):
                keep = []
                for data, noise in zip(as_bytes(part.column(0)), part.column(1).to_pylist(), strict=True):
                    grams = gram_buckets(data, len(own) - 1)
                    score = np.floor((float(own[grams].sum()) + noise) * (1 << _STEPS)) + _MIDDLE
                    keep.append(len(grams) > 0 and min(2 * _MIDDLE - 1, max(0, score)) >= cut)
                yield part.select([2]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, rows.select("row").schema).select("row.*")

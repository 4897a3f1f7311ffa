"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Character 1- to 3-grams of the lower-cased text are hashed into `features` buckets. Document frequencies are counted
over all training documents; weights are trained by FTRL-proximal with elastic-net (L1 and L2) penalties on a
bounded sample, drawn by language: of each the documents with the smallest id hashes, `sample` by the number of
languages, `least` at any rate. So a rare language is learned like any other, and all are held equally likely beforehand
(shares of languages in the bias would outvote clear texts of rare ones, whose few documents give small weights). A
temperature is fitted on a slice of the sample that the weights have not seen, each document with the weight of its language. Features of the sample are made where its texts are. Prediction reads the whole text only.

Defined results: null text, or text without a letter (a character of Unicode's letter categories: no digits, numerals or
superscripts), is `und` with score 0; with no training document at all every text is `und` with score 0; null languages
are not learned from; repeated rows are predicted one by one; an empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_of, give_back

FEATURES = 1 << 16
_MULTIPLY = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))
_BLOCK = 1 << 20  # characters hashed at a time; counts of blocks add up, so texts of any length are whole


def gram_counts(text: str, features: int = FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that occur, and how often."""
    low = f" {text.lower()} "
    total = None
    for at in range(0, len(low), _BLOCK):
        codes = np.frombuffer(low[at : at + _BLOCK + 2].encode("utf-32-le", "replace"), "<u4")
        own = min(_BLOCK, len(low) - at)  # starts in this block; the two characters after it complete its grams
        one = codes * _MULTIPLY[0]
        h = one.copy()
        parts = [h[:own]]
        for n in (1, 2):
            if len(codes) > n:
                h = (h[: len(codes) - n] ^ (h[: len(codes) - n] >> np.uint32(15))) * _MULTIPLY[n] + one[n:]
                parts.append(h[:own])
        mixed = np.concatenate(parts)
        counts = np.bincount((mixed ^ (mixed >> np.uint32(16))) & np.uint32(features - 1), minlength=features)
        total = counts if total is None else total + counts
    present = np.flatnonzero(total)
    return present, total[present]


def weigh(present: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit-length sublinear TF-IDF."""
    x = (1.0 + np.log(counts)) * idf[present]
    norm = np.sqrt(x @ x)
    return x / norm if norm > 0 else x


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # features × languages, mostly zero
    bias: np.ndarray
    temperature: float

    def logits(self, text: str) -> np.ndarray:
        present, counts = gram_counts(text, len(self.idf))
        return weigh(present, counts, self.idf) @ self.weights[present] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not has_letter(text):
            return "und", 0.0
        z = self.logits(text) / self.temperature
        p = np.exp(z - z.max())
        best = int(np.argmax(p))
        return self.languages[best], float(p[best] / p.sum())


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], features: int, classes: int, *, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05, epochs: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by per-coordinate follow-the-regularised-leader; the bias is feature `features`, unpenalised by L1."""
    z, n = np.zeros((features + 1, classes)), np.zeros((features + 1, classes))

    def solve(at: np.ndarray) -> np.ndarray:
        zi, ni = z[at], n[at]
        bound = np.where(at == features, 0.0, l1)[:, None]
        return np.where(np.abs(zi) <= bound, 0.0, -(zi - np.sign(zi) * bound) / ((beta + np.sqrt(ni)) / alpha + l2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            present, x, label = rows[k]
            at, value = np.append(present, features), np.append(x, 1.0)
            w = solve(at)
            score = value @ w
            p = np.exp(score - score.max())
            p /= p.sum()
            p[label] -= 1.0
            g = value[:, None] * p
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
    every = solve(np.arange(features + 1))
    return every[:features], every[features]


def fit_temperature(logits: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None) -> float:
    """The temperature of least (weighted) negative log likelihood, by golden section on its logarithm."""
    if not len(labels):
        return 1.0
    weights = np.ones(len(labels)) if weights is None else weights

    def loss(t: float) -> float:
        z = logits / np.exp(t)
        z = z - z.max(axis=1, keepdims=True)
        return float(np.average(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(labels)), labels], weights=weights))

    low, high, ratio = -4.0, 3.0, (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def document_frequencies(docs: DataFrame, text: str, features: int) -> tuple[np.ndarray, int]:
    """Over all given documents: each task sends one vector of counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = np.zeros(features, np.int64), 0
        for batch in batches:
            for body in batch.column(0):
                if value := body.as_py():
                    found[gram_counts(value, features)[0]] += 1
                    n += 1
        if n:
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(found[at], n))], names=["feature", "n"])
        give_back()

    rows = docs.select(F.col(text).alias("text")).mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(features, np.int64)
    n = 0
    for r in rows:  # at most features + 1
        if r["feature"] < 0:
            n = r["n"]
        else:
            counts[r["feature"]] = r["n"]
    return counts, n


def sample_features(known: DataFrame, sample: int, least: int, features: int) -> tuple[dict[str, int], list[tuple[str, np.ndarray, np.ndarray]]]:
    """Documents of each language, and (language, buckets, counts) of the sampled ones, in the order of their hashes.

    Hashes alone meet first, at most the wanted number of each language from a task; then only the sample's texts are read."""
    totals = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not totals:
        return {}, []
    each = max(least, -(-sample // len(totals)))
    ranked = known.select("lang", "h").withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("r") <= each)
    reach = ranked.groupBy(F.col("lang").alias("own")).agg(F.max("h").alias("reach"))
    chosen = known.join(F.broadcast(reach), (F.col("lang") == F.col("own")) & (F.col("h") <= F.col("reach"))).select("lang", "h", "text")  # a row a language is sent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [gram_counts(x.as_py(), features) for x in batch.column(2)]
            kind = pa.list_(pa.int32())
            columns = [pa.array([x[k].astype(np.int32) for x in found], kind) for k in range(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["lang", "h", "present", "counts"])

    rows = chosen.mapInArrow(run, "lang string, h long, present array<int>, counts array<int>").collect()
    rows = sorted(((r["h"], r["lang"], np.array(r["present"], np.int64), np.array(r["counts"], np.int64)) for r in rows), key=lambda r: (r[0], r[1], len(r[2]), r[2].tolist(), r[3].tolist()))
    taken: dict[str, int] = defaultdict(int)
    out = []
    for _, lang, present, counts in rows:  # rows that repeat an id share its hash
        taken[lang] += 1
        if taken[lang] <= each:
            out.append((lang, present, counts))
    return totals, out


def train(docs: DataFrame, *, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", features: int = FEATURES, sample: int = 2000, least: int = 20) -> LanguageModel:
    """Learn from rows whose language is not null. `sample` and `least` bound the rows that weights are fitted to; every fifth of them calibrates."""
    known = docs.filter(F.col(lang).isNotNull() & (F.length(text) > 0)).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.xxhash64(F.col(doc_id)).alias("h"))
    counts, n = document_frequencies(known, "text", features)
    idf = np.log((1.0 + n) / (1.0 + counts)) + 1.0
    totals, picked = sample_features(known, sample, least, features)
    languages = sorted(totals)
    rows = [(present, weigh(present, c, idf), languages.index(name)) for name, present, c in picked]
    part: dict[int, int] = defaultdict(int)
    held, fitted = [], []
    for r in rows:  # every fifth of each language
        (held if part[r[2]] % 5 == 4 else fitted).append(r)
        part[r[2]] += 1
    weights, bias = ftrl(fitted, features, max(1, len(languages)))
    held = held or rows
    logits = np.array([x @ weights[p] + bias for p, x, _ in held]).reshape(len(held), weights.shape[1])
    labels = np.array([y for *_, y in held], int)
    worth = np.array([totals[x] for x in languages])[labels] / np.bincount(labels, minlength=len(languages))[labels] if rows else None
    return LanguageModel(languages, idf, weights, bias, fit_temperature(logits, labels, worth))


def identify(docs: DataFrame, model: LanguageModel, *, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of `keep`, lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is set by `features`, not by the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            out = [own.predict(x.as_py()) for x in batch.column(0)]
            columns = [batch.column(k) for k in range(1, batch.num_columns)] + [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[1:], "lang_pred", "score"])
        give_back()

    chosen = docs.select(F.col(text).alias("_text"), F.col(doc_id).cast("long").alias("doc_id"), *keep)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[1:])
    return chosen.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def identify_held_out(docs: DataFrame) -> DataFrame:
    """Train on ids whose crc32 mod 5 is not 0, predict every document."""
    marked = docs.select("doc_id", "text", "lang", (bucket_of("doc_id", 5) == 0).alias("held_out"))
    return identify(marked, train(marked.filter("not held_out")), keep=("held_out",)).select("doc_id", "held_out", "lang_pred", "score")

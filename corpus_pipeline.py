"""From raw documents to packed training sequences: five stages, each one operator, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandloom.llm.common import bounded_batches, discard, materialise, read, shrink_heaps
from strandloom.llm.decontaminate import decontaminate
from strandloom.llm.minhash import keep_one
from strandloom.llm.packing import pack
from strandloom.llm.quality import keep_good
from strandloom.llm.secret_scan import redact


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents outside the importance sample go."""
    shrink_heaps(spark)
    bounded_batches(spark)
    return keep_good(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8 or more."""
    shrink_heaps(spark)
    bounded_batches(spark)
    return keep_one(docs, shingle=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    shrink_heaps(spark)
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live secrets and widely copied examples give way to placeholders; every document stays."""
    shrink_heaps(spark)
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and place."""
    shrink_heaps(spark)
    bounded_batches(spark)
    return pack(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing),
]

#: Neither sampling by trained models nor tokenisation can be said in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, before = materialise(stage(spark, docs, sf_dir), f"stage-{name}"), docs
        discard(before)
    return docs

import llm_cases as cases
import pytest

import corpus_pipeline
from strandloom.llm import queries


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "packing"]
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 11))


def test_whole_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = docs
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, sf_dir)
        assert out.columns == docs.columns, name
        kept = corpus_pipeline.materialise(out, f"test-{name}")
        counts.append(kept.count())
    assert docs.count() > counts[0] > counts[1] >= counts[2] == counts[3] > 0
    packed = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in kept.collect()}
    assert packed.groupBy("doc_id", "piece").count().filter("count > 1").count() == 0


def test_clean_documents_stay(spark, sf_dir):
    """Good documents without copies, secrets or benchmark passages leave the filtering stages as they came."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").collect()}
    after = {r.doc_id for r in corpus_pipeline.quality(spark, docs, sf_dir).collect()}
    assert len(good & after) >= 0.95 * len(good)


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_awkward_and_empty_tables(spark, sf_dir, stage):
    docs = cases.table(spark)
    out = stage(spark, docs, sf_dir)
    if stage is not corpus_pipeline.packing:
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()
    assert stage(spark, cases.empty(spark), sf_dir).count() == 0

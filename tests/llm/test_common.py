import os

import corpus_pipeline
import llm_cases as cases
import pytest

from strandloom.llm import common


def test_scratch_tables_come_and_go(spark):
    a, b = (common.materialise(spark.range(5), "t") for _ in range(2))
    paths = [x._scratch_path for x in (a, b)]
    assert a.count() == 5 and all(map(os.path.isdir, paths))
    common.discard(a, spark.range(1))
    assert [os.path.isdir(p) for p in paths] == [False, True]
    common.release(spark)
    assert not os.path.isdir(paths[1])


def test_session_setting_is_put_back(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    common.materialise(spark.range(1), "t")
    assert spark.conf.get(key) == before


def test_words_split_on_ascii_white_space_alone():
    assert common.words_of("A\tB\x0bC\x0cD\x1cE F \r\n É".encode()) == [b"a", b"b", b"c", "d\x1ce f".encode(), "É".encode()]


def test_buckets_of_ids(spark):
    df = cases.table(spark)
    for r in df.select("doc_id", (common.bucket_of("doc_id", 7) == 2).alias("x")).collect():
        assert r.x == cases.held(r.doc_id, 7, 2)


def test_one_process_has_no_executors_to_ask(spark):
    assert common.shrink_heaps(spark) == 0


def test_every_stage_begins_with_small_heaps(monkeypatch):
    class Begun(Exception):
        pass

    def begin(spark):
        raise Begun

    monkeypatch.setattr(corpus_pipeline, "shrink_heaps", begin)
    for _, stage in corpus_pipeline.STAGES:
        with pytest.raises(Begun):
            stage(None, None, "")

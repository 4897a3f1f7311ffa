import json
import subprocess
import sys

import pytest
from pyspark import cloudpickle
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strandloom.functions.config import AlignConfig
from strandloom.operators.rescore import score_alignment
from strandloom.plans import speedup, sweep
from strandloom.sources import connectors, generated, series
from strandloom.streaming import dimers

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this file


def test_random_sequences(spark):
    a = generated.random_dna(spark, 300, 8, 40, seed=3)
    assert a.filter("length(seq1) < 8 or length(seq1) > 40 or not seq1 rlike '^[ACGT]+$'").count() == 0
    assert sorted(a.collect()) == sorted(generated.random_dna(spark, 300, 8, 40, seed=3).repartition(3).collect())
    assert a.agg(F.countDistinct(F.length("seq1"))).first()[0] > 25
    assert generated.witnesses_and_random(spark, 7, 1, 3, sequences=3).count() == 11
    with pytest.raises(ValueError):
        generated.primer_set(spark, ["A"], [])


def test_random_alignments(spark):
    pairs = generated.random_dna(spark, 100, 1, 12, seed=1)
    r = generated.random_alignment(pairs)
    assert r.filter("replace(aligned1, '-', '') <> seq1 or replace(aligned2, '-', '') <> seq2 or length(aligned1) <> length(aligned2)").count() == 0
    assert r.select(score_alignment("aligned1", "aligned2")).count() == 100
    passed = sweep.alignment_swap_cases(r, AlignConfig(free=(False, True, True, False)))
    assert passed.filter("not ok").count() == 0


def test_series(spark, tmp_path):
    data = [("3d", "rust", 20, 0.1), ("2d", "python", 20, 2.0), ("2d", "rust", 20, 0.5), ("2d", "rust", 10, 0.25), ("2d", "python", 10, 0.5), ("2d", "python", 40, 9.0)]
    df = spark.createDataFrame(data, series.SERIES)
    path = str(tmp_path / "series")
    series.write_series(df, path)
    back = [tuple(r) for r in series.read_series(spark, path).collect()]
    assert back == [("2d", "python", 10, 0.5), ("2d", "python", 20, 2.0), ("2d", "python", 40, 9.0), ("2d", "rust", 10, 0.25), ("2d", "rust", 20, 0.5), ("3d", "rust", 20, 0.1)]
    (tmp_path / "other.csv").write_text("dimension,backend,n,time_s\n2d,fortran,1,1.0\n2d,rust,1,1.0\n")
    assert series.read_series(spark, str(tmp_path / "other.csv")).count() == 1
    s = speedup.speedup_summary(df).first()
    assert (s.points, s.median_ratio, s.tail_n, s.tail_ratio) == (2, 3.0, 20, 4.0)
    assert {(r.dimension, r.backend): r.exponent for r in speedup.scaling(df).collect()}[("2d", "rust")] == pytest.approx(1.0)
    assert speedup.common_sizes(df).count() == 2
    assert spark.range(1).select(speedup.dp_bytes(F.lit(6500), 2), speedup.dp_bytes(F.lit(260), 3)).first() == (6501.0**2 * 33, 261.0**3 * 84)
    assert speedup.before_cap(df, 33 * 21.0**2).count() == 4
    assert speedup.median_times(df.unionByName(df.withColumn("time_s", F.col("time_s") * 3))).filter("dimension='3d'").first().time_s == pytest.approx(0.2)
    series.write_sweep(df, str(tmp_path / "sweep"))


def test_symmetry_sweep(spark):
    cases = generated.witnesses_and_random(spark, 3, 4, 10)
    assert len(sweep.grid()) * 3 == 768 and len(sweep.grid(3)) * 5 == 2560
    some = [c for c in sweep.grid() if c.free in ((False,) * 4, (False, True, True, False))]
    rows = sweep.condition_rows(sweep.symmetry_cases(cases, some)).cache()
    assert rows.count() == len(some) * 3 and sweep.sweep_passes(rows)
    total = {r.symmetry: r for r in sweep.by_symmetry(rows).collect()}
    assert total[None].n_rows == len(some) * 3 and total["swap"].expected_true_failures == 0
    assert total["complement"].expected_known == len(some) and total["reverse"].expected_unknown == len(some)
    failing = rows.filter("symmetry = 'complement' and matrix = 'non_comp_symmetric' and score_pass = 0")
    assert failing.count() > 0 and failing.first().first_failure is not None
    three = [sweep.Condition("comp_symmetric", False, True, True, f) for f in ((False,) * 6, (False, False, False, True, True, False))]
    short = generated.witnesses(spark, 3)
    assert sweep.sweep_passes(sweep.condition_rows(sweep.symmetry_cases(short, three), "triples_total"))


def test_consistency_sweeps(spark):
    cases = generated.random_dna(spark, 5, 6, 12, 4)
    configs = [AlignConfig(free=f) for f in ((False,) * 4, (True, False, True, False))]
    assert sweep.fully_passing(sweep.passes_by_flags(sweep.rescoring_cases(cases, configs))).first() == (2, 2)
    assert sweep.dimer_swap_cases(cases, configs).filter("not ok").count() == 0
    unsound = sweep.rescoring_cases(cases, configs).withColumn("ok", F.lit(False))
    assert sweep.printed_failures(unsound, "ok", ["flags"], 2).count() == 4


# Connectors against stand-ins.


def sets(spark):
    return generated.primer_set(spark, ["acgt acgt ", "TTTT"], ["p1", "p2"]), generated.primer_set(spark, ["TGCA", "GGG"], ["q1", "q2"])


def engine(a, b):
    return {"tm": 1.0, "dg": -1.0, "ds": 0.0, "dh": 0.0, "structure_found": True, "ascii_structure": a + b}


def thermal(a, b):
    if b == "GGG":
        raise RuntimeError("too short")
    return connectors.parse_ntthal_text(f"Calculated dS = -1.5\tdH = 2 \t dG = -3.25\tt = 40\n  x\nSEQ {a}\nSTR {b}  \n")


def test_primer3_batch(spark):
    one, two = sets(spark)
    r = connectors.heterodimer_batch_primer3(one, two, primer3=engine, ntthal=thermal, raise_on_error=False).collect()
    assert [(x.primer1_name, x.primer2_name) for x in r] == [("p1", "q1"), ("p1", "q2"), ("p2", "q1"), ("p2", "q2")]
    assert r[0].primer3_ascii_structure == "ACGTACGTTGCA" and r[0].ntthal_dg == -3.25 and r[0].ntthal_ascii_structure == "SEQ ACGTACGT\nSTR TGCA"
    assert r[1].error == "too short" and r[1].ntthal_t is None
    with pytest.raises(PySparkException, match="too short"):
        connectors.heterodimer_batch_primer3(one, two, primer3=engine, ntthal=thermal).collect()
    with pytest.raises(ValueError):
        connectors.heterodimer_batch_primer3(one, two, n_jobs=0)
    with pytest.raises(ValueError):
        connectors.Ntthal(timeout_s=0)
    assert len(connectors.heterodimer_batch_primer3(one, two, primer3=engine, ntthal=lambda a, b: thermal(a, "x")).columns) == 13


def test_program(tmp_path):
    tool = tmp_path / "ntthal"
    tool.write_text("#!/bin/sh\necho \"dS = 1 dH = 2 dG = 3 t = 4\"; echo \"SEQ $2\"\n")
    tool.chmod(0o755)
    assert connectors.Ntthal(str(tool))("AC", "GT") == {"ds": 1.0, "dh": 2.0, "dg": 3.0, "t": 4.0, "ascii_structure": "SEQ AC"}
    with pytest.raises(RuntimeError, match="no program"):
        connectors.Ntthal("/nowhere/ntthal")("A", "C")
    tool.write_text("#!/bin/sh\nexit 3\n")
    with pytest.raises(RuntimeError, match="failed with 3"):
        connectors.Ntthal(str(tool))("A", "C")
    tool.write_text("#!/bin/sh\nsleep 5\n")
    with pytest.raises(RuntimeError, match="longer"):
        connectors.Ntthal(str(tool), 0.2)("A", "C")


def test_ntthal_columns(spark):
    df = spark.createDataFrame([("", "ds = 1.5 DH = -2 dG = +3 T = 4\nSTR x\n y \n")], "o string, e string")
    assert tuple(df.select(connectors.parse_ntthal("o", "e").alias("r")).select("r.*").first()) == (1.5, -2.0, 3.0, 4.0, "STR x\n y")
    for text, match in (("", "no output"), ("dS = x", "no thermodynamics")):
        with pytest.raises(PySparkException, match=match):
            spark.createDataFrame([(text,)], "o string").select(connectors.parse_ntthal("o")).collect()
        with pytest.raises(RuntimeError):
            connectors.parse_ntthal_text(text)


class Service:
    """Answers by a script of statuses, then well."""

    def __init__(self, script=(), lifetime=3600, token="t"):
        self.script, self.lifetime, self.token, self.calls, self.tokens = list(script), lifetime, token, 0, 0

    def __call__(self, url, **what):
        if url == connectors.TOKEN_URL:
            self.tokens += 1
            return {"access_token": self.token, "expires_in": self.lifetime}
        self.calls += 1
        status = self.script.pop(0) if self.script else 200
        if status == 200:
            return [{"DeltaG": -1.0, "Bonds": [2]}]
        if status is None:
            raise connectors.NetworkError("unreachable")
        raise connectors.HttpError(*status) if isinstance(status, tuple) else connectors.HttpError(status, f"status {status}")


ACCOUNT = connectors.IdtAccount("a", "b", "c", "d")


def call(script, retries=6, raise_on_error=False, **how):
    service, waits = Service(script, **how), []
    client = connectors.IdtClient(ACCOUNT, service)
    limiter = connectors.RateLimiter(500, 60)
    return connectors.idt_call(client, limiter, "A", "C", max_retries=retries, raise_on_error=raise_on_error, sleep=waits.append), service, waits


def test_retries():
    (ok, response, status, error), service, waits = call([429, (429, "slow", "7"), None, 401, 200])
    assert ok and status == 200 and error is None and json.loads(response)[0]["DeltaG"] == -1.0
    assert waits == [1.0, 7.0, 4.0, 1.0] and service.tokens == 2
    result, service, waits = call([404])
    assert result == (False, None, 404, "status 404") and service.calls == 1 and waits == []
    result, service, _ = call([None] * 9, retries=2)
    assert result[2] is None and result[3] == "unreachable" and service.calls == 3
    with pytest.raises(connectors.HttpError):
        call([500], raise_on_error=True)
    assert call([], lifetime=0)[0][0] is False  # a token answer without a lifetime is a failed row
    assert connectors.retry_decision(429, 9, 20) == ("retry", 120.0) and connectors.retry_decision(429, 1, 6, "soon") == ("retry", 1.0)


def test_tokens_expire():
    now = [0.0]
    service = Service(lifetime=100)
    client = connectors.IdtClient(ACCOUNT, service, clock=lambda: now[0])
    for now[0], tokens in ((0.0, 1), (69.0, 1), (70.0, 2)):
        client.heterodimer("A", "C")
        assert service.tokens == tokens


def test_rate_limiter():
    now, waits = [0.0], []

    def sleep(s):
        waits.append(s)
        now[0] += s

    limiter = connectors.RateLimiter(2, 10, clock=lambda: now[0], sleep=sleep)
    for _ in range(3):
        limiter.acquire()
    assert waits == [pytest.approx(10.05)]
    limiter.reset()
    limiter.acquire()
    assert len(waits) == 1
    for bad in ((0, 1), (1, 0)):
        with pytest.raises(ValueError):
            connectors.RateLimiter(*bad)


def test_idt_batch(spark):
    from strandloom.plans.catalog import stand_in_post

    one, two = sets(spark)
    r = connectors.heterodimer_batch_idt(one, two, ACCOUNT, post=stand_in_post).collect()
    assert [(x.primer1_name, x.primer2_name, x.ok, x.status_code) for x in r] == [("p1", "q1", True, 200), ("p1", "q2", True, 200), ("p2", "q1", True, 200), ("p2", "q2", True, 200)]
    assert r[0].primer1 == "acgt acgt "  # as given
    failing = generated.primer_set(spark, ["ACG"], ["x"])
    r = connectors.heterodimer_batch_idt(failing, two, ACCOUNT, post=stand_in_post).collect()
    assert [(x.ok, x.response, x.status_code) for x in r] == [(False, None, 404)] * 2
    with pytest.raises(PySparkException):
        connectors.heterodimer_batch_idt(failing, two, ACCOUNT, post=stand_in_post, raise_on_error=True).collect()


def test_streams(spark, tmp_path):
    pairs = generated.random_dna(spark, 40, 10, 14, 5).select(F.timestamp_seconds(F.col("pair_id") * 10).alias("ts"), "seq1", "seq2")
    pairs.coalesce(2).write.parquet(str(tmp_path / "in"))
    scored = dimers.scored_stream(dimers.stream_pairs(spark, str(tmp_path / "in")))
    counted = dimers.strong_dimers_by_window(scored, 1.0)
    query = counted.writeStream.outputMode("complete").format("memory").queryName("strong").start()
    query.processAllAvailable()
    query.stop()
    got = spark.table("strong").orderBy("start").collect()
    batch = dimers.scored_stream(pairs).groupBy(F.window("ts", "1 minute")).agg(F.count("*"), F.count_if(F.col("score") >= 1)).orderBy("window").collect()
    assert [(r.pairs, r.strong) for r in got] == [(r[1], r[2]) for r in batch] and sum(r.pairs for r in got) == 40


def test_without_the_optional_subpackage(tmp_path):
    """The entry module imports, and has its other queries, where strandloom/llm and the pipeline are gone."""
    import os
    import shutil

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "strandloom"), tmp_path / "strandloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries(), set(e.oracle_sql()) <= set(e.queries()))"], cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert done.returncode == 0, done.stderr
    n, pipeline, known = done.stdout.split()
    assert int(n) > 50 and pipeline == "False" and known == "True"

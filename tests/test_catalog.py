"""Every registered query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from strandloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cells(columns, rows):
    """Rows with columns by name; numbers as floats."""
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = lambda v: "~" if v is None else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(plain(row[k]) for k in order) for row in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, sf_dir, duck, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    got = df.collect()
    said = duck.execute(catalog.ORACLES[name])
    columns = [c[0] for c in said.description]
    assert sorted(columns) == sorted(df.columns)
    assert cells(df.columns, got) == cells(columns, said.fetchall())


def test_random_walks_score_alike_in_both_orders(spark, sf_dir):
    r = catalog.QUERIES["random_walk_swap_symmetry"](spark, sf_dir).first()
    assert r.passed == r.total == 250


def test_symmetry_rows(spark, sf_dir):
    """The whole grid; scores agree wherever they must."""
    rows = catalog.QUERIES["symmetry_rows"](spark, sf_dir).collect()
    assert len(rows) == 768 and {r.pairs_total for r in rows} == {30}
    assert all(r.score_pass == (r.score_failures == 0) for r in rows) and all(r.score_pass for r in rows if r.expected_score_invariant)


def test_long_triples(spark, sf_dir):
    """Strings give the inputs back and score what the score alone is."""
    from strandloom.operators.rescore import score_alignment_3d

    inputs = {r.k1: (r.seq1, r.seq2, r.seq3) for r in catalog.long_triples(spark, sf_dir).collect()}
    scores = {r.k1: r.score for r in catalog.QUERIES["nw3_score_primers"](spark, sf_dir).collect()}
    found = catalog.QUERIES["nw3_align_primers"](spark, sf_dir)
    for r in found.withColumn("again", score_alignment_3d("aligned1", "aligned2", "aligned3", catalog.THREE)).collect():
        assert tuple(x.replace("-", "") for x in (r.aligned1, r.aligned2, r.aligned3)) == inputs[r.k1]
        assert r.score == scores[r.k1] == pytest.approx(r.again)


def test_every_other_query_has_sql():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"random_walk_swap_symmetry", "symmetry_rows", "nw3_align_primers"}


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["k1", "k2", "score"] and df.count() == 10

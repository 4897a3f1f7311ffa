import pytest

from strandloom.plans import cli


@pytest.mark.parametrize(
    "arguments",
    [
        "symmetry --rows 2 --max-len 10 --flags 0110",
        "symmetry --sequences 3 --rows 1 --min-len 3 --max-len 6 --flags 000110",
        "rescoring --rows 4 --max-len 12 --flags 1001",
        "rescoring --sequences 3 --rows 2 --min-len 2 --max-len 6 --flags 011000",
        "dimer-swap --rows 4 --flags 0110",
        "dimer-swap --rows 3 --walks 4 --flags 0110",
    ],
)
def test_sweeps_pass(spark, arguments, capsys):
    assert cli.run(spark, arguments.split())


def test_symmetry_csv(spark, tmp_path):
    assert cli.run(spark, ["symmetry", "--rows", "1", "--max-len", "9", "--flags", "0000", "--csv-out", str(tmp_path / "out")])
    back = spark.read.csv(str(tmp_path / "out"), header=True)
    assert back.count() == 48 and "score_failures" in back.columns and len(back.columns) == 12


def test_series(spark, tmp_path, capsys):
    (tmp_path / "s.csv").write_text("dimension,backend,n,time_s\n2d,python,10,2.0\n2d,rust,10,0.5\n")
    assert cli.run(spark, ["series", str(tmp_path / "s.csv")])
    assert "4.0" in capsys.readouterr().out

import pytest

from caseloom.__main__ import CHECKS, arguments, main
from caseloom.plans import catalog


@pytest.fixture
def tables(spark, tmp_path):
    rows = [(1, "a", "d", "train", "s1", "same text here"), (2, "b", "d", "dev", "s2", "same text here"), (3, "c", "d", "train", "s3", "another one")]
    spark.createDataFrame(rows, "ref_no bigint, id string, dataset string, split string, source_id string, facts string").write.parquet(str(tmp_path / "train_references.parquet"))
    return str(tmp_path)


def test_verbs(spark, tables, tmp_path, capsys):
    assert set(CHECKS) <= set(catalog.queries())
    assert main(["queries"]) == 0 and "exact_dup_groups" in capsys.readouterr().out
    assert main(["overlap", tables]) == 3 and "facts" in capsys.readouterr().out
    assert main(["check", "repeated_ids", tables]) == 0
    out = str(tmp_path / "out")
    assert main(["run", "exact_dup_groups", tables, "--out", out, "--format", "json"]) == 0 and spark.read.json(out).count() == 1
    assert main(["run", "exact_dup_groups", tables, "--out", out]) == 2
    assert main(["run", "nothing", tables]) == 2 and main(["run", "exact_dup_groups", str(tmp_path / "none")]) == 2
    with pytest.raises(SystemExit) as error:
        arguments(["check", "jobs", tables])
    assert error.value.code == 2

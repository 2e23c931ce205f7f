"""The contract's functions, with and without the training-data operators."""

import math
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("gone", [("bitloom/llm", "tests/llm", "corpus_pipeline.py"), ("bitloom/llm", "tests/llm"), ("corpus_pipeline.py",)])
def test_works_without_the_training_data_operators(tmp_path, gone):
    """A copy without these parts names all other queries and collects its tests."""
    root, copy = Path(__file__).resolve().parent.parent, tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", *[Path(x).name for x in gone]))
    assert not any((copy / x).exists() for x in gone)
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(*e.queries())"
    run = lambda *a: subprocess.run([sys.executable, "-B", *a], cwd=copy, capture_output=True, text=True, timeout=300)
    said = run("-c", code)
    assert said.returncode == 0, said.stderr
    mine = set(entry._relational()) if "bitloom/llm" in gone else set(entry.queries()) - {"pipeline"}
    assert set(said.stdout.split()) >= mine and "pipeline" not in said.stdout.split()
    if "bitloom/llm" in gone:
        assert not any(x.startswith("op") and x[2].isdigit() for x in said.stdout.split())
        listed = run("-m", "pytest", "tests", "-q", "--collect-only", "-p", "no:cacheprovider")
        assert listed.returncode == 0, listed.stdout[-2000:]


def _rows(names, rows):
    clean = lambda x: None if x is None or (isinstance(x, float) and math.isnan(x)) else round(x, 9) if isinstance(x, float) else x
    return sorted((tuple(clean(r[n]) for n in names) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith(("op", "pipeline"))))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got = entry.queries()[name](spark, FOLDER)
    want = con.execute(entry.oracle_sql()[name])
    names = sorted(d[0] for d in want.description)
    at = [d[0] for d in want.description]
    assert sorted(got.columns) == names
    assert _rows(names, [r.asDict() for r in got.collect()]) == _rows(names, [dict(zip(at, r)) for r in want.fetchall()])

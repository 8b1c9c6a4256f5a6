import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from quillgraph.plans import catalogue

REPO = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("left", ["nothing", "the pipeline", "an empty package folder", "the package alone"])
def test_imports_without_the_training_text_package(tmp_path, left):
    to = tmp_path / "repo"
    gone = {"nothing": ["llm", "corpus_pipeline.py"], "the package alone": ["corpus_pipeline.py"]}.get(left, ["llm"])
    skip = shutil.ignore_patterns(*gone, ".git", "__pycache__")
    shutil.copytree(REPO, to, ignore=skip)
    if left == "an empty package folder":
        (to / "quillgraph" / "llm" / "__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and not any(k.startswith('op') for k in q); print(len(q))"
    got = subprocess.run([sys.executable, "-B", "-c", code], cwd=to, env=os.environ | {"PYTHONPATH": str(to)}, capture_output=True, text=True)
    assert got.returncode == 0, got.stderr
    assert int(got.stdout) == len(catalogue.QUERIES)
    if left == "nothing":
        got = subprocess.run([sys.executable, "-B", "-m", "pytest", "-q", "-p", "no:cacheprovider", "tests/test_functions.py"], cwd=to, env=os.environ | {"PYTHONPATH": str(to)}, capture_output=True, text=True)
        assert got.returncode == 0, got.stdout


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    cursor = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=str)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_other_queries_have_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0

"""Every registered query with SQL gives the rows that DuckDB gives."""

import glob
import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from tests.conftest import SMALL
from tidemark.plans import catalog


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(name, spark, sf_dir, duck):
    df = catalog.queries()[name](spark, sf_dir)
    rel = duck.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    got = [tuple(map(plain, r)) for r in df.select(*sorted(df.columns)).collect()]
    want = [tuple(map(plain, r)) for r in rel.select(*[f'"{c}"' for c in sorted(rel.columns)]).fetchall()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_rows_only(name, spark, sf_dir):
    assert catalog.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_lives_without_llm(tmp_path):
    """A copy without the subpackage and its tests imports, with or without the pipeline's file, and registers the other queries."""
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    say = "import __spark_entry__ as e; from tidemark.plans import catalog; assert set(e.queries()) == set(catalog.queries()) and set(e.oracle_sql()) == set(catalog.oracle_sql())"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    for _ in range(2):
        assert subprocess.run([sys.executable, "-c", say], cwd=tmp_path, env=env, capture_output=True, timeout=120).returncode == 0
        if (root / "corpus_pipeline.py").exists():
            shutil.copy(root / "corpus_pipeline.py", tmp_path)

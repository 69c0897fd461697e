"""Every query with SQL gives what DuckDB gives on the smallest tables; the others run."""

from __future__ import annotations

import glob
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import quern.plans.more_queries  # noqa: F401
from quern.plans.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(rows, names):
    """Rows as texts, columns by name."""
    order = sorted(range(len(names)), key=names.__getitem__)
    cell = lambda v: "NULL" if v is None else repr(float(v)) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)
    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf, duck, name):
    found = QUERIES[name](spark, sf)
    rows = found.collect()
    assert rows
    if name in ORACLE:
        expected = duck.sql(ORACLE[name])
        assert sorted(found.columns) == sorted(expected.columns)
        assert plain(rows, found.columns) == plain(expected.fetchall(), expected.columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("gone", [("quern/llm", "tests/llm"), ("quern/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_entry_without_the_training_data_operators(tmp_path, gone):
    root = Path(__file__).resolve().parent.parent
    skip = shutil.ignore_patterns(".git", "__pycache__", "*.json", "*.md")
    copy = Path(shutil.copytree(root, tmp_path / "copy", ignore=skip))
    for name in gone:
        if (copy / name).exists():
            (shutil.rmtree if (copy / name).is_dir() else os.remove)(copy / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len([n for n in q if not n.startswith(('op', 'pipeline'))]), 'pipeline' in q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True, check=True).stdout.split()
    assert out == [str(len(QUERIES)), "False"]

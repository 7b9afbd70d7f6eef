"""The driver contract: every query with SQL equals it on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from fissure.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    rows, columns = df.collect(), sorted(df.columns)
    if name not in catalog.ORACLES:
        assert rows
        return
    found = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    expected = [tuple(str(r[names.index(c)]) for c in columns) for r in found.fetchall()]
    assert sorted(tuple(str(r[c]) for c in columns) for r in rows) == sorted(expected)


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 200


def test_imports_without_the_corpus_part(tmp_path):
    import shutil
    import subprocess
    import sys

    for name in ("fissure", "__spark_entry__.py"):
        source = os.path.join(entry.ROOT, name)
        (shutil.copytree if os.path.isdir(source) else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "fissure/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bfs_levels' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)

"""Every registered query with SQL gives the rows DuckDB gives; the others give rows."""

import math
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from tidemark.plans import REGISTERED

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, float):
        assert not math.isnan(v), "a result holds NaN"
        return repr(v + 0.0)
    return v.isoformat() if hasattr(v, "isoformat") else repr(v)


@pytest.mark.parametrize("name", sorted(n for n, q in REGISTERED.items() if q.sql))
def test_matches_sql(spark, duck, folder, name):
    q = REGISTERED[name]
    df = q.run(spark, folder)
    columns = sorted(df.columns)
    got = sorted(tuple(cell(r[c]) for c in columns) for r in df.collect())
    cur = duck.execute(q.sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted(tuple(cell(r[i]) for i in at) for r in cur.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(n for n, q in REGISTERED.items() if not q.sql))
def test_runs(spark, folder, name):
    df = REGISTERED[name].run(spark, folder)
    assert df.columns
    df.count()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_training_text(tmp_path):
    """The rest must import and register its queries where the operators for training text are absent."""
    root = Path(__file__).parent.parent
    shutil.copytree(root / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (root / name).exists():
            shutil.copy(root / name, tmp_path)
    code = "import __spark_entry__ as e; assert not [n for n in e.queries() if n.startswith('op')], e.queries(); print(len(e.queries()), len(e.oracle_sql()))"
    told = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=False)
    assert told.returncode == 0, told.stderr
    assert int(told.stdout.split()[0]) == len(REGISTERED)

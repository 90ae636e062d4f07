"""Every query of the search engine against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tracewell.plans.queries import ORACLE_SQL, QUERIES, flagship

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(x):
    return f"{x:.9g}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    expected = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == expected


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE_SQL.keys()))
def test_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_flagship(spark):
    got = flagship(spark, DATA).collect()
    assert 0 < len(got) <= 16 and all("the" in r.line.lower() and "that" in r.line.lower() for r in got)


def test_entry_imports_without_corpus_operators():
    import subprocess
    import sys
    import tempfile

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    with tempfile.TemporaryDirectory() as folder:
        os.makedirs(f"{folder}/tracewell")
        for name in os.listdir(f"{root}/tracewell"):
            if name not in ("llm", "__pycache__"):
                os.symlink(f"{root}/tracewell/{name}", f"{folder}/tracewell/{name}")
        os.symlink(f"{root}/__spark_entry__.py", f"{folder}/__spark_entry__.py")
        code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not any(n.startswith('op1_') for n in q) and 'pipeline' not in q; e.oracle_sql()"
        env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
        subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, check=True, env=env)

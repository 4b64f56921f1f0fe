"""The registered queries against their SQL on the smallest tables."""

import os

import pytest

from lodestone import registry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(x):
    if x is None or isinstance(x, float) and x != x:
        return None
    if isinstance(x, float):
        return round(x, 8)
    return str(x) if not isinstance(x, (int, bool)) else int(x)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables aren't here")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = registry.queries()[name](spark, FOLDER)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    a = sorted((tuple(_plain(r[c]) for c in order) for r in got.collect()), key=repr)
    b = sorted((tuple(_plain(r[want.columns.index(c)]) for c in order) for r in want.fetchall()), key=repr)
    assert a == b


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables aren't here")
@pytest.mark.parametrize("name", sorted(registry.queries().keys() - registry.oracle_sql().keys()))
def test_query_without_sql_runs(spark, name):
    assert registry.queries()[name](spark, FOLDER).count() > 0


def test_rest_stands_without_the_corpus_operators(tmp_path):
    """Also where a folder of compiled files alone is left of them."""
    import shutil
    import subprocess
    import sys

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{here}/lodestone", f"{tmp_path}/lodestone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    os.makedirs(f"{tmp_path}/lodestone/llm/__pycache__")
    shutil.copy(f"{here}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); e.oracle_sql(); assert 'bm25_topk' in q and not [x for x in q if x.startswith('op') or x == 'pipeline']"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)})

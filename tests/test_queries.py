"""Every query against its SQL on the smallest tables; the entry point without the optional subpackage."""

import subprocess
import sys

import duckdb
import pytest

from quillstone.plans.catalog import ORACLES, QUERIES

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return c


#: Queries that SQL cannot state, and the test that compares them with a plain version.
PLAIN = {"semantic_route": "tests/test_semantic_route.py"}


def test_every_query_is_compared():
    assert set(QUERIES) == set(ORACLES) | set(PLAIN) and not set(ORACLES) & set(PLAIN)


@pytest.mark.parametrize("name", ORACLES)
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, D)
    cols = sorted(df.columns)
    q = duck.execute(ORACLES[name])
    names = [x[0] for x in q.description]
    shown = lambda row: repr([float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in row])
    assert sorted(names) == cols
    assert sorted(shown(r[c] for c in cols) for r in df.collect()) == sorted(shown(r[names.index(c)] for c in cols) for r in q.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_the_subpackage(tmp_path):
    code = "import sys; sys.modules['quillstone.llm'] = None\ntry:\n    import __spark_entry__ as e\nexcept ImportError: raise\nassert 'vec_topk' in e.queries() and not any(n.startswith('op') and n[2].isdigit() for n in e.queries())"
    done = subprocess.run([sys.executable, "-c", code], cwd=__file__.rsplit("/", 2)[0], capture_output=True, text=True)
    assert done.returncode == 0, done.stderr

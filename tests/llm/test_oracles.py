"""Queries of this subpackage against their SQL on the smallest tables."""

import duckdb
import pytest

from quillstone.llm.catalog import ORACLES, QUERIES

D = "/root/testdata/sf0.001"


def rows(names, found):
    order = sorted(names)
    return sorted(repr([float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in (r[names.index(c)] for c in order)]) for r in found)


@pytest.mark.parametrize("name", ORACLES)
def test_same_rows(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings"):
        c.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    q = c.execute(ORACLES[name])
    df = QUERIES[name](spark, D)
    assert rows(df.columns, df.collect()) == rows([x[0] for x in q.description], q.fetchall())

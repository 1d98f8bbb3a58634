"""Blocked k best against the search with queries on the driver; blocks that bounds skip."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.operators import blocked, vectors


def frames(spark, x, ids, every):
    rows = [(int(i), [float(c) for c in v]) for i, v in zip(ids, x, strict=True)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    return e, e.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "embedding")


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("k,floor", [(5, -2.0), (40, 0.3)])
def test_same_rows_as_top_k(spark, k, floor):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[300:420] = x[7]  # a group of copies larger than a block
    e, q = frames(spark, x, range(900), 7)
    assert rows(blocked.top_k(e, q, k, floor, block=50, cells=16)) == rows(vectors.top_k(e, q, k, floor))


def test_far_blocks_are_skipped(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 16))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    x = np.repeat(centres, 100, axis=0) + rng.normal(size=(2000, 16)) * 0.02
    e, q = frames(spark, x, rng.permutation(2000), 10)
    hits, pairs, every = blocked.plan(e, q, 10, block=50, cells=32)
    assert rows(hits) == rows(vectors.top_k(e, q, 10))
    assert pairs.count() < every / 4
    assert pairs.distinct().count() == pairs.count()


def test_odd_rows(spark):
    e = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, [1.0]), (5, []), (6, [0.0, 1.0])], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (9, None), (10, [])], "query_id long, embedding array<float>")
    assert rows(blocked.top_k(e, q, 2)) == [(1, 2, 0.5), (1, 6, 0.0)]
    assert blocked.top_k(e, q.limit(0), 2).collect() == [] and blocked.top_k(e.limit(0), q, 2).collect() == []
    with pytest.raises(ValueError):
        blocked.top_k(e, q.union(spark.createDataFrame([(7, [1.0])], q.schema)), 2)

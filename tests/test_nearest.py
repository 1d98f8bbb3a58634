"""What a task of vectors.top_k holds, and that nothing is lost by it."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from quillstone.operators import vectors


def brute(ids, matrix, found, x, k, floor):
    score = np.round(matrix @ x.T, 6)
    rows = [sorted((-s, int(v)) for s, v in zip(row.tolist(), found.tolist(), strict=True) if v != q and s >= floor)[:k] for q, row in zip(ids.tolist(), score, strict=True)]
    return {(q, v, -s) for q, row in zip(ids.tolist(), rows, strict=True) for s, v in row}


@pytest.mark.parametrize(("k", "floor", "step"), [(5, -2.0, 64), (5, 0.3, 7), (40, -2.0, 1000), (3, 0.99, 1)])
def test_nearest_equals_all_products(k, floor, step):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(400, 4)), 1)  # many ties
    x[100:200], x[7] = x[0], np.nan
    found = rng.permutation(400)
    ids, matrix = found[:60], x[:60].copy()
    held = vectors.Nearest(ids, matrix, k, floor)
    for at in range(0, 400, step):
        held.add(found[at : at + step], x[at : at + step])
    got = held.batch().to_pylist()
    want = brute(ids, matrix, found, x, k, floor)
    assert len(got) == len(want) and {(r["query_id"], r["vec_id"], r["score"]) for r in got} == want


def test_a_task_holds_few_scores(spark, monkeypatch):
    """5,000 queries against an Arrow batch of 10,000 vectors are 400 MB of scores at once."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(10_000, 8)).astype(np.float32)
    e = spark.createDataFrame([(0, [0.0] * 8)], "vec_id long, embedding array<float>")
    tasks = []
    monkeypatch.setattr(type(e), "mapInArrow", lambda self, f, schema: tasks.append(f) or spark.createDataFrame([], schema))
    vectors.top_k(e, spark.createDataFrame([(i, v) for i, v in enumerate(x[:5_000].tolist())], "query_id long, embedding array<float>"), 30)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(10_000)), pa.array(x.tolist(), pa.list_(pa.float32()))], ["vec_id", "embedding"])
    tracemalloc.start()
    n = sum(b.num_rows for b in tasks[0](iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 5_000 * 30 and peak < 150e6

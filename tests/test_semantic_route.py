"""The semantic route over whole tables against all products of all vectors."""

import numpy as np
import pandas as pd

from quillstone.config import CONFIG as C
from quillstone.functions.embed import hashed_ngrams
from quillstone.plans.catalog import QUERIES

D = "/root/testdata/sf0.001"


def test_every_question_against_every_text(spark):
    docs, asks = (pd.read_parquet(f"{D}/{t}.parquet") for t in ("documents", "benchmark"))
    v = hashed_ngrams([(t or "").strip() for t in docs.text]).astype(np.float64)
    q = hashed_ngrams([t.strip() for t in asks.text]).astype(np.float64)
    scores = q @ v.T
    got = QUERIES["semantic_route"](spark, D).toPandas()
    at = {i: n for n, i in enumerate(docs.doc_id)}
    assert set(got.query_id) <= set(asks.item_id) and not got.duplicated(["query_id", "chunk_id"]).any()
    total = 0
    for row, i in zip(scores, asks.item_id, strict=True):
        mine = got[got.query_id == i]
        assert np.allclose(mine.score, row[[at[c] for c in mine.chunk_id]], atol=1e-5)
        want = sorted((s for s in row if s >= C.similarity), reverse=True)[: C.top_k]
        assert abs(len(mine) - len(want)) <= sum(abs(s - C.similarity) < 1e-5 for s in row)
        n = min(len(mine), len(want))
        assert np.allclose(sorted(mine.score, reverse=True)[:n], want[:n], atol=1e-5)
        total += n
    assert total > len(asks)

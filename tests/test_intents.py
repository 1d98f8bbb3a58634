"""Intent fallbacks over many texts that meet many questions: pairs of both never become rows, and nothing is lost."""

import numpy as np

from quillstone.operators import gates, intents

TEXTS = [(i, f"d{i % 7}" if i % 11 else None, ("budget officer " if i % 3 else "officer ") + ("education degree" if i % 5 == 0 else "hearing")) for i in range(3000)]
ASKS = [(1, "role and duties of the budget officer"), (2, "complaint of the officer about budget hearing"), (3, "what is budget"), (4, "required experience of the officer with budget"), (5, "blue sky")]


def made(spark, block):
    u = spark.createDataFrame(TEXTS, "chunk_id long, doc_name string, text string").repartition(5)
    q = spark.createDataFrame(ASKS, "query_id long, question string")
    return gates.by_intent(q, u, {"definition": ["budget officer"]}, block=block)


def test_pairs_of_texts_and_questions_are_no_rows(spark):
    df = made(spark, 5_000)
    # a keyword exploded to rows meets every question that has it
    assert "Generate" not in df._jdf.queryExecution().executedPlan().toString()
    got = {(r.query_id, r.chunk_id): r.score for r in df.collect()}
    assert got == {(r.query_id, r.chunk_id): r.score for r in made(spark, 2).collect()}
    # seven documents and the nameless one: the first three chunks of each that speak of it
    for query, fits in ((1, lambda t: True), (3, lambda t: "budget officer" in t)):
        want, seen = set(), {}
        for i, d, t in TEXTS:
            if fits(t) and seen.setdefault(d, 0) < 3:
                seen[d] += 1
                want.add((query, i))
        assert {k for k in got if k[0] == query} == want and len(want) == 24
    assert not [k for k in got if k[0] == 5]


def test_a_task_holds_the_first_chunks_only(monkeypatch):
    monkeypatch.setattr(intents, "HELD", 500)
    asks = intents.Asks([(9, "role", ["a"], []), (8, "role", ["b"], [])])
    held, rng = intents.First(asks, 2, 10), np.random.default_rng(1)
    ids, kept = rng.permutation(20_000), {9: [], 8: []}
    for part in np.split(ids, 100):
        docs = [f"d{i % 900}" for i in part.tolist()]
        text = np.repeat(np.arange(len(part)), 2)
        q = np.tile([0, 1], len(part))
        held.add(part, docs, (text, q, np.ones(len(q), np.int64), np.zeros(len(q), bool)))
        assert held.n <= 500 and len(held.documents) <= 900
    (out,) = held.batches()
    for r in out.to_pylist():
        kept[r["query_id"]].append((r["chunk_id"], r["doc_name"]))
    assert all(sorted(v) == [(i, f"d{i}") for i in range(10)] for v in kept.values())

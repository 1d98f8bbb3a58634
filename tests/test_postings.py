"""Keyword search with best lists and posting lists against a plain loop over all texts."""

import random
from functools import partial

import pytest
from pyspark.sql import functions as F

from quillstone.operators import keywords, postings
from quillstone.sources.scratch import new_folder


def plain(texts, asks, least=None):
    out = {}
    for q, toks in asks:
        for c, _, t in texts:
            t = (t or "").lower()
            n = sum(w in t for w in toks)
            share = n / max(1, len(toks))
            full = len(toks) > 1 and " ".join(toks) in t
            score = 0.75 if full else 0.65 if n and share == 1 else 0.6 if share >= 0.75 and len(toks) >= 3 else 0.55 if share >= 0.5 and len(toks) >= 2 else 0.0
            if toks and (score or (least and n >= least)):
                out[q, c] = (n, score)
    return out


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(6)
    words = [f"{a}{b}" for a in ("al", "be", "ga", "dé", "日本", "x") for b in ("pha", "ta", "m", "", "ssu", "ma")]
    sentence = lambda n: " ".join(rng.choices(words, weights=range(1, len(words) + 1), k=n))
    ids = [*range(150), *range(65_530, 65_560), *range(200_000, 200_040)]  # ids on both sides of a span's end
    texts = [(c, f"d{c % 7}", rng.choice([sentence(3), sentence(30), sentence(200).upper(), ""])) for c in ids] + [(300_000, "d1", None)]
    asks = [(q, list(dict.fromkeys(sentence(rng.randrange(1, 7)).split()))) for q in range(60)] + [(90, []), (91, ["x"]), (92, ["nowhere", "found"]), (93, ["ta", "m"])]
    units = spark.createDataFrame(texts, "chunk_id long, doc_name string, text string").repartition(4)
    path = new_folder(spark, "postings")
    postings.add(units.filter("chunk_id < 100"), path)
    postings.add(units.filter("chunk_id >= 100"), path)  # a second batch only adds files
    return texts, asks, units, spark.createDataFrame(asks, "query_id long, toks array<string>"), postings.opened(spark, path)


@pytest.mark.parametrize("least", [None, 2])
@pytest.mark.parametrize("block", [7, 1000])
def test_all_hits(data, least, block):
    texts, asks, units, queries, index = data
    want = plain(texts, asks, least)
    for made in (keywords.scan(units, queries, block, least), postings.search(index, units, queries, block, least)):
        assert {(r.query_id, r.chunk_id): (r.n_found, r.score) for r in made.collect()} == want


def test_best_hits(data, monkeypatch):
    texts, asks, units, queries, index = data
    monkeypatch.setattr(keywords, "HELD", 50)
    document = {c: d for c, d, _ in texts}
    want = set()
    for q, _ in asks:
        hits = [(max(0.62, 0.4 + min(0.28, 0.05 * n)) if s == 0.75 else 0.4 + min(0.28, 0.05 * n), c) for (p, c), (n, s) in plain(texts, asks, 2).items() if p == q and n >= 2]
        kept, per = [], {}
        for s, c in sorted((-round(s, 6), c) for s, c in hits):
            per[document[c]] = per.get(document[c], 0) + 1
            if per[document[c]] <= 3:
                kept.append((q, c, -s))
        want |= set(kept[:8])
    for find in (keywords.scan, partial(postings.search, index)):
        made = keywords.lexical(units, queries, 3, 8, find=find)
        assert {(r.query_id, r.chunk_id, r.score) for r in made.collect()} == want


def test_ties_within_a_document_do_not_crowd_others_out(spark):
    texts = [(i, "big", "alpha beta gamma") for i in range(200)] + [(300 + i, f"d{i}", "alpha beta") for i in range(6)]
    units = spark.createDataFrame(texts, "chunk_id long, doc_name string, text string").coalesce(1)
    asks = spark.createDataFrame([(1, ["alpha", "beta", "gamma"])], "query_id long, toks array<string>")
    assert sorted(r.chunk_id for r in keywords.lexical(units, asks, 3, 8).collect()) == [0, 1, 2, 300, 301, 302, 303, 304]


def test_fused(spark, data):
    texts, asks, units, queries, index = data
    rng = random.Random(1)
    near = {(q, c): round(rng.random(), 4) for q, _ in asks for c in rng.sample(range(150), 9)}
    semantic = spark.createDataFrame([(q, c, s) for (q, c), s in near.items()], "query_id long, chunk_id long, score double")
    want = set()
    for q, _ in asks:
        hits = sorted((-round(s + 0.1 * near.get((q, c), 0), 6), c) for (p, c), (_, s) in plain(texts, asks).items() if p == q)
        want |= {(q, c, -s) for s, c in hits[:4]}
    for find in (keywords.scan, partial(postings.search, index)):
        assert {tuple(r) for r in keywords.fused(units, queries, semantic, 0.1, 4, find=find).collect()} == want


def test_a_task_sends_few_rows_and_reads_candidates_only(spark, data):
    _, asks, units, queries, index = data
    four = units.repartition(4)
    best = keywords.Best(5)
    found = keywords.scan(four, queries, best=best)
    sent = found.groupBy(F.spark_partition_id().alias("p"), "query_id").count()
    assert sent.agg(F.max("count")).first()[0] == 5
    rare = spark.createDataFrame([(1, ["日本ssu", "gassu", "dépha"])], "query_id long, toks array<string>")
    one = next(iter(keywords.blocks_of(rare, 10, None)))
    assert 0 < postings.candidates(index, one).count() < units.count() / 2


def test_empty_tables(spark, data):
    _, _, units, queries, index = data
    assert postings.lists(units.limit(0)).collect() == []
    assert postings.search(index.limit(0), units, queries).collect() == []
    assert postings.search(index, units.limit(0), queries).collect() == [] and postings.search(index, units, queries.limit(0)).collect() == []


def test_candidates_reach_the_scan_as_ranges(spark, tmp_path, data):
    assert postings.ranges([]) == [] and postings.ranges([3]) == [(3072, 4095)]
    assert postings.ranges([1, 2, 3, 50, 51, 90], 2) == [(1024, 4095), (51200, 93183)]
    assert postings.ranges([1, 2, 3, 50, 51, 90], 9) == [(1024, 4095), (51200, 53247), (92160, 93183)]
    texts, _, units, _, index = data
    units.orderBy("chunk_id").write.parquet(str(tmp_path / "units"))
    one = spark.createDataFrame([(1, ["日本ssu", "gassu", "dépha"])], "query_id long, toks array<string>")
    made = postings.search(index, spark.read.parquet(str(tmp_path / "units")), one)
    assert {(r.query_id, r.chunk_id): (r.n_found, r.score) for r in made.collect()} == plain(texts, [(1, ["日本ssu", "gassu", "dépha"])])
    assert "GreaterThanOrEqual(chunk_id" in made._jdf.queryExecution().executedPlan().toString()

"""Stages of the pipeline one after the other against brute force on what each of them was given."""

import random

import duckdb

import corpus_pipeline as P
from quillstone.llm import bpe, mixing
from tests.llm import brute


def table(spark):
    rng = random.Random(6)
    words = {"en": ["the", "and", "thing", "over", "with"], "fr": ["les", "eau", "dans", "pour", "étre"], "de": ["der", "und", "ung", "für", "über"]}
    text = lambda g, n: " ".join(rng.choice(words[g]) + rng.choice(words[g]) + str(rng.randrange(50)) for _ in range(n))
    rows = [(i, text(g, 60), g, f"s{i % 4}") for i, g in enumerate(["en", "fr", "de"] * 30)]
    passage = text("en", 30)
    rows += [(100 + i, rows[i][1] + " end", rows[i][2], "s1") for i in range(9)]
    rows += [(200 + i, f"{text('en', 20)} {passage} {text('en', 10)}", "en", "s2") for i in range(6)]
    rows += [(300, "", "en", "s3"), (301, None, None, None), (302, "12 34", "en", "s3"), (303, text("fr", 50), None, None)]
    return [(i, t, g, s, len(t or ""), "extra", 7) for i, t, g, s in rows], "doc_id long, text string, lang string, source string, n_chars long, score string, size int"


def copies(docs, folder):
    """How often the mix takes each document, by DuckDB over the same rows."""
    docs.write.parquet(f"{folder}/mixed/documents.parquet")
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{folder}/mixed/documents.parquet/*.parquet'")
    q = c.execute(mixing.ORACLE_OP4)
    names = [x[0] for x in q.description]
    rows = [dict(zip(names, r, strict=True)) for r in q.fetchall()]
    return {r["doc_id"]: r["taken"] // r["size"] for r in rows if r["taken"]}


def test_unlabelled_texts_are_kept(spark):
    rows = [(i, t, None, "s", 0) for i, t in [(1, "some words"), (2, "other words"), (None, "x"), (3, None), (4, ""), (5, "12 34"), (1, "some words")]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = dict(P.STAGES)["language"](spark, docs, "").collect()
    assert sorted((repr(r.doc_id), r.text) for r in kept) == [("1", "some words"), ("1", "some words"), ("2", "other words"), ("None", "x")]


def test_odd_rows_of_every_stage(spark):
    """Null ids, texts and sources, wordless texts, repeats: each stage's docstring."""
    line = " ".join(f"w{i}" for i in range(30))
    rows = [(None, f"{line} own", None, None), (None, f"{line} own", None, None), (7, f"{line}\nand more words\nfollow here", "en", "a"), (9, f"begin\n{line}\nthe end\tof it", "en", "a"), (9, None, None, None), (10, " \n ", "en", None), (11, line, "en", "b"), (7, f"{line}\nand more words\nfollow here", "en", "a")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    steps = dict(P.STAGES)
    seen = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    cut = seen(steps["repeated_passages"](spark, docs, ""))
    assert cut == sorted([(None, f"{line} own"), (None, f"{line} own"), (7, rows[2][1]), (7, rows[2][1]), (9, "begin\nthe end\tof it"), (9, None), (10, " \n ")], key=repr)
    once = seen(steps["near_duplicates"](spark, docs, ""))
    assert once == sorted([(7, rows[2][1]), (9, None), (10, " \n ")], key=repr)
    mixed = seen(steps["mixture"](spark, docs, ""))
    assert set(mixed) <= {(r[0], r[1]) for r in rows} and all(mixed.count(m) <= 6 for m in mixed)
    assert {r.doc_id: r.n_tokens for r in steps["tokens"](spark, docs.filter("doc_id in (9, 10)"), "").collect() if r.doc_id == 10} == {10: len(bpe.codec(bpe.vocabulary()).encode(" \n "))}


def test_stages(spark, tmp_path):
    rows, schema = table(spark)
    docs = spark.createDataFrame(rows, schema)
    given = {r[0]: r[1] for r in rows}
    steps = dict(P.STAGES)
    assert list(steps) == ["language", "near_duplicates", "repeated_passages", "mixture", "tokens"]

    a = P.persisted(steps["language"](spark, docs, ""), "t")
    assert a.columns == docs.columns and {r.doc_id for r in a.collect()} == set(given) - {300, 301, 302}

    b = P.persisted(steps["near_duplicates"](spark, a, ""), "t")
    want = brute.components([(r.doc_id, r.text) for r in a.collect()], 5)
    assert b.columns == docs.columns and sorted(r.doc_id for r in b.collect()) == sorted(i for i, (_, c) in want.items() if i == c)

    c = P.persisted(steps["repeated_passages"](spark, b, ""), "t")
    left = {i: (k if gone else given[i]) for i, n, gone, k in brute.without_repeats([(r.doc_id, r.text) for r in b.collect()]) if not gone or gone < n}
    assert {r.doc_id: r.text for r in c.collect()} == left and all(r.n_chars == len(r.text) and r.score == "extra" for r in c.collect())

    d = P.persisted(steps["mixture"](spark, c, ""), "t")
    assert d.columns == docs.columns and {r.doc_id for r in d.collect()} <= set(left)
    assert {r.doc_id: r["count"] for r in d.groupBy("doc_id").count().collect()} == copies(c, tmp_path)

    codec = bpe.codec(bpe.vocabulary())
    for r in steps["tokens"](spark, d, "").collect():
        ids = codec.encode(left[r.doc_id])
        assert (r.ids, r.n_tokens, r.decoded_sha256) == (ids, len(ids), brute.sha(left[r.doc_id]))


def test_run_on_empty_table(spark, tmp_path):
    _, schema = table(spark)
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []

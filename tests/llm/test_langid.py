"""Language ID: the bounded sample, prediction by brute force, odd and long texts."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import langid

STEMS = {"en": ["the", "and", "ing"], "de": ["der", "und", "ung"], "fr": ["les", "des", "eau"], "es": ["los", "que", "nez"], "xx": ["zzk", "qwx", "kkq"]}


def texts(n=150, seed=1):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(STEMS[g]) + rng.choice(STEMS[g]).upper() for _ in range(rng.randrange(3, 30))), g) for i, g in enumerate(rng.choice(list(STEMS)) for _ in range(n))]


def brute(model, text):
    """(language, score) with plain loops: margins of all heads, the family, then the votes inside it."""
    if text is None or not any(c.isalpha() for c in text):
        return "und", 0.0
    b = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode()) + b" "
    bins = []
    for i in range(len(b) - 1):
        bins.append((((b[i] << 8 | b[i + 1]) + (1 << 25)) * 2654435761 % 2**32) >> (32 - langid.BITS))
    for i in range(len(b) - 2):
        bins.append(((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 2246822519 % 2**32) >> (32 - langid.BITS))
    sure = []
    for k in range(len(model.heads)):
        margin = sum(float(model.weights[k][x]) for x in bins) / max(1, len(bins)) + model.bias[k]
        sure.append(1 / (1 + math.exp(-max(-30, min(30, margin * model.scale[k])))))
    family = [1.0 if len(model.families) == 1 else 0.0] * len(model.families)
    for (kind, a, c), s in zip(model.heads, sure, strict=True):
        if kind == "family":
            family[a] = s
            if c >= 0:
                family[c] = 1 - s
    total = sum(family)
    best = max(range(len(family)), key=lambda f: (family[f], -f))
    inside = [i for i, g in enumerate(model.langs) if langid.family_of(g) == model.families[best]]
    votes, belief, rivals = dict.fromkeys(inside, 0), dict.fromkeys(inside, 0.0), dict.fromkeys(inside, 0)
    for (kind, a, c), s in zip(model.heads, sure, strict=True):
        if kind == "pair" and a in votes:
            votes[a if s >= 0.5 else c] += 1
            belief[a] += s
            belief[c] += 1 - s
            rivals[a] += 1
            rivals[c] += 1
    mean = {i: belief[i] / rivals[i] if rivals[i] else 1.0 for i in inside}
    pick = max(inside, key=lambda i: (votes[i] + mean[i] / 2, -i))
    return model.langs[pick], family[best] / total * mean[pick]


def test_query_by_brute_force(spark, tmp_path):
    rows = [*texts(), (900, None, "en"), (901, "", "en"), (902, "12 !?", None), (903, "a", "xx"), (None, "the and thing", "en"), (904, "der und ung " * 3, None), (904, "der und ung " * 3, None)]
    spark.createDataFrame([(*r, 0.5, "x") for r in rows], "doc_id long, text string, lang string, score double, lang_pred string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    docs = spark.createDataFrame([r for r in rows if not held(r[0])], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert set(model.langs) == set(STEMS) and {k for k, *_ in model.heads} == {"family", "pair"}
    got = sorted(((repr(r.doc_id), r.held_out, r.lang_pred, r.score) for r in langid.op3_langid(spark, str(tmp_path)).collect()), key=repr)
    want = sorted(((repr(i), held(i), *brute(model, t)) for i, t, _ in rows), key=repr)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-4)


def test_sample_holds_its_bound(spark):
    """20,000 rows without an id, most of them copies of one text, do not fill the sample; nor does a common language."""
    same = spark.range(15_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same text of copies").alias("text"), F.lit("en").alias("lang"))
    own = spark.range(5_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text"), F.when(F.col("id") < 20, "de").otherwise("en").alias("lang"))
    docs = same.unionByName(own).repartition(8)
    got = langid.sampled(docs, 300, 9_000).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in got} == {"en": 300, "de": 20}
    a, b = (sorted((r.lang, r.key) for r in langid.sampled(d, 50, 60).select("lang", "key").collect()) for d in (docs, docs.coalesce(1)))
    assert a == b and len(a) == 30 + 20


def test_long_text_is_read_whole(spark, monkeypatch):
    model = langid.fit(spark.createDataFrame(texts(), "doc_id long, text string, lang string"))
    long = ("the and thing " * 500 + "der und ung " * 2500).encode()
    whole = model.margins([long])
    monkeypatch.setattr(langid, "PIECE", 1000)
    assert np.allclose(model.margins([long]), whole, atol=1e-5)
    assert model.predict([long])[0] == ["de"]


def test_nothing_to_learn_from(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, "en"), (3, "12", "en")], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert model.langs == [] and [tuple(r) for r in langid.predict(docs, model).collect()] == [(i, "und", 0.0) for i in (1, 2, 3)]
    assert model.predict([b"abc"])[0] == pytest.approx(["und"])


def test_held_out_accuracy(spark):
    out = langid.op3_langid(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null and lang_pred <> 'und'")
    right = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.98

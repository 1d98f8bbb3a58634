"""URL rules against a plain version; the trees on planted patterns; odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import urls


def brute(url):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    tail = rest[end:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = []
    for verdict, rule in urls.RULES:
        name, slash, more = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith(slash + more):
            fits.append((len(rule), rule, verdict))
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]


ODD = ["http://Example.ORG/en/1?x#y", "https://a.example.org/en/2", "http://notexample.org/es/", "http://org", "http://org/", "http://x.com/fr/a/de/", "//x.com/de/", "http://x.com?/de/", "http://x.com#/de/", "a://b://c.org/d", "http://x.com/de/\nz", "", None, "http://xorg/", "http://é.com/de/é", "http://x.net/a-b_c?p=1&q=2"]


def test_rules(spark, tmp_path):
    rows = [(i, u, "x", "y", "z") for i, u in enumerate(ODD)] + [(0, ODD[0], "x", "y", "z"), (None, ODD[1], "x", "y", "z")]
    spark.createDataFrame(rows, "page_id long, url string, html string, host string, rule string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.op6_urls(spark, str(tmp_path)).collect()), key=repr)
    want = sorted(((p, *brute(u)) for p, u, *_ in rows), key=repr)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert all(g[4] == w[4] if w[4] else g[4] in ("allow", "block") for g, w in zip(got, want, strict=True))


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    assert urls.op6_urls(spark, str(tmp_path)).collect() == []


def labelled(spark, rows):
    return spark.createDataFrame(rows, "url string, blocked boolean").select("url", urls.host_of(F.col("url")).alias("host"), urls.path_of(F.col("url")).alias("path"), "blocked")


def test_trees_learn_and_match_their_expressions(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(600):
        bad = rng.random() < 0.5
        name = "".join(rng.choice("0123456789" if bad else "abcdef") for _ in range(12))
        rows.append((f"http://h{rng.randrange(9)}.com/{name}", bad))
    df = labelled(spark, rows)
    model = urls.fit(df.limit(400))
    made = urls.lexical(F.col("url"), F.col("host"), F.col("path"))
    names = [*made, "suffix_rate"]
    wide = model.with_rates(df).select("blocked", *[e.alias(k) for k, e in made.items()], "suffix_rate")
    out = wide.select("*", model.margin([F.col(k) for k in names]).alias("m")).collect()
    x = np.array([[r[k] for k in names] for r in out])
    assert np.allclose([r.m for r in out], model.start + sum(t.predict(x) for t in model.trees))
    assert np.mean([(r.m > 0) == r.blocked for r in out]) > 0.98


def test_copies_of_a_url_cannot_fill_the_sample(spark, monkeypatch):
    """200,000 rows of one URL: the sample keeps within its bound, and the other URLs are learned."""
    held = []
    whole = urls.fit_trees
    monkeypatch.setattr(urls, "fit_trees", lambda x, y: held.append(x) or whole(x, y))
    one = spark.range(200_000).select(F.lit("http://a.com/0").alias("url"), F.lit(False).alias("blocked"))
    others = spark.range(9_000).select(F.concat(F.lit("http://b.com/"), F.when(F.col("id") % 2 == 0, F.lit("x")).otherwise(F.lit("9999")), F.col("id").cast("string")).alias("url"), (F.col("id") % 2 == 1).alias("blocked"))
    df = one.unionByName(others).select("url", urls.host_of(F.col("url")).alias("host"), urls.path_of(F.col("url")).alias("path"), "blocked")
    model = urls.fit(df, most=1_000)
    assert len(held[0]) == 1_000 and len(model.trees) > 0
    model = urls.fit(one.select("url", urls.host_of(F.col("url")).alias("host"), urls.path_of(F.col("url")).alias("path"), "blocked"), most=1_000)
    assert len(held[1]) == 1


def test_suffixes_are_counted_over_all_rows(spark):
    model = urls.fit(labelled(spark, [(f"http://h{i}.{'bad' if i % 3 == 0 else 'good'}/p{i}", i % 3 == 0) for i in range(900)]), most=50)
    prior = 301 / 902
    assert {r.suffix: pytest.approx(r.suffix_rate) for r in model.suffixes.collect()} == {"bad": (300 + 4 * prior) / 304, "good": 4 * prior / 604}


def test_joined_rules_equal_written_out_rules(spark):
    rng = random.Random(12)
    label = lambda: rng.choice(["a", "b", "com", "org", "x-y"])
    rules = [(rng.choice(["allow", "block"]), ".".join(label() for _ in range(rng.randrange(1, 4))) + "/" + rng.choice(["", "p", "p/q", "pq"])) for _ in range(150)]
    rows = [(i, ".".join(label() for _ in range(rng.randrange(0, 5))), rng.choice(["", "/", "/p", "/p/q/r", "/pq", "/z"])) for i in range(600)]
    df = spark.createDataFrame(rows, "i long, host string, path string")
    got, want = ({r.i: r["__rule"] for r in urls.with_rule(df, rules, n).collect()} for n in (0, 1000))
    assert got == want and sum(v is not None for v in want.values()) > 100


def test_long_url(spark):
    url = "http://" + "a." * 3000 + "com/" + "x1" * 100_000 + "?" + "k=v&" * 20_000
    got = urls.judge(labelled(spark, [(url, True)]).select(F.lit(1).alias("page_id"), "url"), urls.fit(labelled(spark, [("http://a.com/x", True), ("http://b.com/y", False)]))).first()
    assert got.host == "a." * 3000 + "com" and len(got.path) == 200_001 and got.verdict in ("allow", "block")


def test_held_out_urls(spark):
    """Learned on half of the URLs that the rules label, the trees judge the other half."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    known = urls.rule_labels(pages).withColumn("page_id", F.lit(0))
    held = F.crc32("url") % 2 == 1
    out = urls.judge(known.filter(held), urls.fit(known.filter(~held))).select("url", (F.col("block_margin") > 0).alias("said")).join(known.filter(held).select("url", "blocked"), "url").agg(F.avg((F.col("said") == F.col("blocked")).cast("double")).alias("right"), F.avg(F.greatest(F.col("blocked").cast("double"), F.lit(0.0))).alias("share")).first()
    print("held-out accuracy", out.right, "share blocked", out.share)
    assert out.right > max(out.share, 1 - out.share)


def test_entropy(spark):
    e = spark.createDataFrame([("aabb",), ("",), ("abcd",)], "u string").select(urls.lexical(F.col("u"), F.lit(""), F.lit(""))["entropy"].alias("e"))
    assert [r.e for r in e.collect()] == pytest.approx([1.0, 0.0, 2.0])

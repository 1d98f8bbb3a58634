"""Operators on documents against brute force, over rows that are odd on purpose."""

import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillstone.llm import fingerprints, langid, lm, mixing, neardup, substrings
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept string, component_id long, shard int"


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def rows():
    rng = random.Random(3)
    shared = sentence(rng, 40)
    out = []
    for i in range(60):
        out.append((i, sentence(rng, rng.choice([3, 20, 60, 200])), "en"))
    base = sentence(rng, 120).split()
    for i in range(60, 100):
        w = list(base)
        w[rng.randrange(120)] = f"x{i}"
        out.append((i, " ".join(w), "en"))
    for i in range(100, 130):
        out.append((i, f"{sentence(rng, 9)} {shared}\n{sentence(rng, rng.choice([2, 30]))}", "fr"))
    out += [(130, None, None), (131, "", "en"), (132, " \n\t ", None), (133, "One Two", "en"), (134, "one  two\x0b", "en"), (135, "é ß 日本 😀 " * 5, "fr"), (136, sentence(rng, 30_000, 90_000), "en"), (137, "a a a a a a a a a a a a a a a a", "en"), (138, "12 34 !!", "en")]
    return out


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("docs")
    full = [(i, t, g, f"s{i % 3}" if i % 7 else None, 0, -1, "k", -5, 2) for i, t, g in rows()]
    spark.createDataFrame(full, SCHEMA).repartition(5).write.parquet(f"{folder}/full/documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/empty/documents.parquet")
    odd = [(None, "a b c d e f", None, None, 0, 0, "", 0, 0), (None, None, None, None, 0, 0, "", 0, 0), (5, "same text here it is", "en", "s", 0, 0, "", 0, 0), (5, "same text here it is", "en", "s", 0, 0, "", 0, 0), (5, "another text of one id", "en", "s", 0, 0, "", 0, 0), (6, "same text here it is", "xx", "s", 0, 0, "", 0, 0)]
    spark.createDataFrame(odd, SCHEMA).write.parquet(f"{folder}/odd/documents.parquet")
    return {"folder": str(folder), "full": rows(), "n": {"full": len(full), "empty": 0, "odd": len(odd)}}


QUERIES = {"op2": fingerprints.op2_fingerprints, "op3": langid.op3_langid, "op4": mixing.op4_mixing, "op5": neardup.op5_neardup, "op7": substrings.op7_substrings, "op9": lm.op9_lm}


@pytest.mark.parametrize("name", QUERIES)
@pytest.mark.parametrize("kind", ["empty", "odd"])
def test_one_row_for_each_row(spark, tables, name, kind):
    assert QUERIES[name](spark, f"{tables['folder']}/{kind}").count() == tables["n"][kind]


def test_odd_rows_of_components(spark, tables):
    got = sorted(map(tuple, neardup.op5_neardup(spark, f"{tables['folder']}/odd").collect()), key=repr)
    assert got == sorted([(None, 3, None, True), (None, 0, None, True), (5, 2, 5, True), (5, 2, 5, True), (5, 2, 5, True), (6, 2, 5, False)], key=repr)


ODD = [(None, "a b c d e f"), (None, None), (5, "same text here it is"), (5, "same text here it is"), (5, "another text of one id"), (6, "same text here it is")]


def test_odd_rows_of_substrings(spark, tables):
    got = sorted(map(tuple, substrings.op7_substrings(spark, f"{tables['folder']}/odd").collect()), key=repr)
    assert got == sorted([(i, n, gone, brute.sha(kept)) for i, n, gone, kept in brute.without_repeats(ODD)], key=repr)
    long = [(i, " ".join(f"w{k}" for k in range(20)) + t) for i, t in ((None, ""), (None, ""), (7, " x"), (7, ""), (7, ""), (9, " y"))]
    made = substrings.remove_repeated(spark.createDataFrame(long, "doc_id long, text string"))
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in made.collect()), key=repr)
    assert got == sorted(brute.without_repeats(long), key=repr) and sum(r[2] for r in got) == 20


def test_odd_rows_of_mixing(spark, tables):
    got = sorted(map(tuple, mixing.op4_mixing(spark, f"{tables['folder']}/odd").collect()), key=repr)
    assert sorted(r[:2] for r in got if r[0] is not None) == [(5, 5), (5, 5), (5, 5), (6, 5)]
    assert {(r[0], r[1], r[2]) for r in got if r[0] is None} == {(None, 6, 6), (None, 0, 6)}
    # 26 words: the null source weighs 2, stops at 3 times its 6 words, and source s takes the rest; no row beyond 3 times its size
    assert {(r[2], r[3]) for r in got} == {(20, 26 / 3), (6, 52 / 3)} and all(r[4] <= 3 * r[1] for r in got)
    assert sorted(r[4] for r in got if r[2] == 20)[:2] == [0, 0]


def test_odd_rows_of_the_model(spark, tables):
    got = lm.op9_lm(spark, f"{tables['folder']}/odd").collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    seen = [w for i, t in ODD if not held(i) for w in [*brute.words(brute.lower(t or "")), "</s>"]]
    assert {r.train_tokens for r in got} == {len(seen)}
    base = lambda t: sum(math.log10((seen.count(w) + 0.5) / (len(seen) + 0.5 * (len(set(seen)) + 1))) for w in [*brute.words(brute.lower(t or "")), "</s>"])
    want = sorted((repr(i), held(i), len(brute.words(t or "")) + 1, round(base(t), 9)) for i, t in ODD)
    assert sorted((repr(r.doc_id), r.held_out, r.n_tokens, round(r.base_score, 9)) for r in got) == want


def test_very_long_text_of_the_model(spark):
    long = "alpha beta gamma " * 400_000
    docs = spark.createDataFrame([(1, long), (2, "alpha beta"), (3, "delta")], "doc_id long, text string")
    got = {r.doc_id: r for r in lm.score(docs, lm.fit(docs)).collect()}
    assert got[1].n_tokens == 1_200_001 and got[1].n_known == 1_200_001 and got[1].score > -1200.0


@pytest.mark.parametrize("width,query", [(4, True), (5, False)])
def test_components(spark, tables, width, query):
    folder = f"{tables['folder']}/full"
    df = neardup.op5_neardup(spark, folder) if query else neardup.near_duplicates(spark.read.parquet(f"{folder}/documents.parquet"), width)
    want = brute.components([(i, t) for i, t, _ in tables["full"]], width)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()} == want
    assert len({c for _, c in want.values()}) < len(want)


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 7)
    data = [(i, t) for i, t, _ in rows() if i < 130]
    got = neardup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), 4)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute.components(data, 4)


def chain(n):
    """Texts that each share one half with the text before and one with the text after: none alike, all connected by rare values."""
    half = lambda i: " ".join(f"c{i}x{j}" for j in range(60))
    return [(i, f"{half(i)} {half(i + 1)}") for i in range(n)]


def test_unlike_texts_that_share_rare_values_cost_what_their_lists_cost(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 2)
    none = spark.createDataFrame([], "node long, component long")
    sent = []
    for n in (100, 400):
        docs = spark.createDataFrame(chain(n), "doc_id long, text string")
        made = neardup.sketches(docs, 5)
        classes = made.select(F.col("doc_id").alias("node"), "n_shingles", "sketch")
        groups = neardup.list_groups(neardup.listed(classes, neardup.K, neardup.FLOOR, 0.8))
        sent.append(neardup.block_pairs(neardup.cross_blocks(neardup.in_components(groups, none))).count())
    assert sent[1] < 4.5 * sent[0] and sent[1] < 400 * 80
    docs = [*chain(60), (500, chain(60)[7][1] + " end"), (501, chain(60)[7][1]), (502, chain(60)[30][1])]
    got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 5)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute.components(docs, 5)


def test_long_texts_of_one_group(spark):
    rng = random.Random(5)
    base = sentence(rng, 20_000, 90_000)
    docs = [(1, base), (2, base + " end"), (3, "start " + base), (4, sentence(rng, 20_000, 90_000)), (5, base), (6, None)]
    got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 5)
    assert {r.doc_id: r.component_id for r in got.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 1, 6: 6}


@pytest.mark.parametrize("held", [64, 1 << 20])
def test_repeated_windows(spark, tables, held):
    docs = spark.read.parquet(f"{tables['folder']}/full/documents.parquet").select("doc_id", "text")
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substrings.remove_repeated(docs, most_held=held).collect())
    want = sorted(brute.without_repeats([(i, t) for i, t, _ in tables["full"]]))
    assert got == want and sum(r[2] for r in want) > 1000


def test_crowded_sketch_loses_nothing():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 1 << 63, 1 << 16).astype(np.uint64)
    count = [np.bincount(substrings.cells(h, row, 12).astype(np.int64), minlength=1 << 12) for row in range(substrings.ROWS)]
    estimate = np.min([c[substrings.cells(h, row, 12).astype(np.int64)] for row, c in enumerate(count)], axis=0)
    assert (estimate >= 1).all() and (estimate > 1).mean() > 0.9


def test_query_of_repeated_windows(spark, tables):
    got = sorted(map(tuple, substrings.op7_substrings(spark, f"{tables['folder']}/full").collect()))
    assert got == sorted((i, n, r, brute.sha(k)) for i, n, r, k in brute.without_repeats([(i, t) for i, t, _ in tables["full"]]))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_language_model(spark, tables, order):
    docs = spark.read.parquet(f"{tables['folder']}/full/documents.parquet")
    model = lm.fit(docs.filter(lm.crc_mod("doc_id", 5) != 1), order)
    tokens = {i: [*brute.words(brute.lower(t or "")), "</s>"] for i, t, _ in tables["full"]}
    p, raw = brute.kneser_ney([t for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1], order, lm.discounts)
    assert (model.n_tokens, model.n_words) == (sum(raw.values()), len(raw))
    for r in lm.score(docs, model).collect():
        t = tokens[r.doc_id]
        z = ["<s>"] * (order - 1) + t
        score = sum(math.log10(p(tuple(z[j - order + 1 : j + 1]))) for j in range(order - 1, len(z)))
        base = sum(math.log10((raw[w] + 0.5) / (sum(raw.values()) + 0.5 * (len(raw) + 1))) for w in t)
        assert (r.n_tokens, r.n_known) == (len(t), sum(raw[w] > 0 for w in t))
        assert r.score == pytest.approx(score, rel=1e-9) and r.base_score == pytest.approx(base, rel=1e-9)


def test_split_contexts(spark, tables, monkeypatch):
    """Contexts of common words, split over ranges, give the same scores as whole ones."""
    docs = spark.read.parquet(f"{tables['folder']}/full/documents.parquet")
    words = [f"w{i}" for i in range(300)]
    common = sorted({int(lm.BEGIN), *map(int, lm.streams([" ".join(words).encode()], 1)[0])})
    made = []
    for lay in (lm.Layout(7), lm.Layout(7, tuple(common), 5)):
        monkeypatch.setattr(lm, "layout", lambda _, lay=lay: lay)
        made.append({r.doc_id: r.score for r in lm.score(docs, lm.fit(docs, 3)).collect()})
    assert made[0] == pytest.approx(made[1], rel=1e-12)


def test_common_words_are_found(spark):
    lay = lm.layout(spark.range(20_000).selectExpr("concat('the word', id, ' the') as text"))
    assert {int(lm.BEGIN), int(lm.streams([b"the"], 1)[0][0])} < set(lay.common) and len(lay.common) < 5


def sketch(text, k=128, width=5):
    """The k least distinct hashes of the text's shingles, with the hash computed by another library."""
    signed = lambda h: h - (1 << 64) if h >> 63 else h

    def chained(hashes):
        seed = 42
        for h in hashes:
            seed = xxhash.xxh64_intdigest(h.to_bytes(8, "little", signed=True), seed=seed)
        return signed(seed)

    w = [signed(xxhash.xxh64_intdigest(x.encode(), seed=42)) for x in brute.words(text)]
    runs = [w[i : i + width] for i in range(len(w) - width + 1)] if len(w) >= width else [w] if w else []
    return sorted({chained(r) for r in runs})[:k]


def alike(a, b, k=128):
    union = sorted({*a, *b})[:k]
    return len({*union} & {*a} & {*b}) / len(union) if union else 1.0


def test_fingerprints(spark, tables):
    docs = sorted(((i, t or "") for i, t, _ in tables["full"]), reverse=True)
    shown = lambda s: ".".join(f"{v % (1 << 64):X}" for v in s)
    got = {r.doc_id: r for r in fingerprints.op2_fingerprints(spark, f"{tables['folder']}/full").collect()}
    for n, (i, t) in enumerate(docs):
        after = docs[(n + 1) % len(docs)][1]
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        own, new, next_ = sketch(t), sketch(edited), sketch(after)
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), brute.sha(edited))
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (shown(own), shown(new))
        assert got[i].near_edited == pytest.approx(alike(own, new)) and got[i].near_next == pytest.approx(alike(own, next_))


def test_odd_fingerprints(spark, tables):
    """Repeated ids and texts, null ids and texts: one row each, and equal texts have equal fingerprints."""
    got = fingerprints.op2_fingerprints(spark, f"{tables['folder']}/odd").collect()
    odd = {"a b c d e f": 1, "": 1, "same text here it is": 3, "another text of one id": 1}
    assert sorted(r.fingerprint for r in got) == sorted(f for t, n in odd.items() for f in [".".join(f"{v % (1 << 64):X}" for v in sketch(t))] * n)


def test_sketches_merge(spark):
    rng = random.Random(8)
    a, b = sentence(rng, 900, 10_000), sentence(rng, 900, 10_000)
    df = spark.createDataFrame([(a, b, f"{a} {b}")], "a string, b string, c string")
    for c in "abc":
        df = fingerprints.with_sketch(df, c, f"s{c}")
    r = df.select(fingerprints.containment(df.sa, df.sc).alias("inside"), fingerprints.resemblance(fingerprints.merge(df.sa, df.sb), df.sc).alias("same"), fingerprints.distinct_shingles(df.sc).alias("n")).first()
    assert r.inside > 0.85 and r.same > 0.9 and abs(r.n - 1800) < 400


def test_mixing_rules(spark, tables):
    got = mixing.mix(spark.read.parquet(f"{tables['folder']}/full/documents.parquet").select("doc_id", "text", "source")).collect()
    size = {i: len(brute.words(t)) for i, t, _ in tables["full"]}
    assert all(r["size"] == size[r.doc_id] and 0 <= r.copies <= 3 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    assert sum(rs[0].target for rs in by.values()) == pytest.approx(sum(size.values()))
    for rs in by.values():
        rate = rs[0].target / rs[0].source_size
        assert all(r.copies in (math.floor(rate), math.ceil(rate)) for r in rs)
        assert abs(sum(r.copies for r in rs) - rate * len(rs)) <= 1


def test_targets_of_many_sources(spark):
    """Against water filling by hand: shares by weight, what is over three times a size goes round again."""
    rng = random.Random(3)
    sizes = {f"host{i:04d}" if i else None: rng.choice([0, 3, 50, 1000, 200_000]) for i in range(700)}
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    want, free, left = {}, set(names), sum(sizes.values())
    while True:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 3 * sizes[s]}
        for s in full:
            want[s] = 3 * sizes[s]
            left -= want[s]
        free -= full
        if not full or not free:
            break
    want |= {s: level * weight[s] for s in free}
    rows = [("n" if s is None else f"s{s}", s, n) for s, n in sizes.items()]
    got = mixing.targets(spark.createDataFrame(rows, "__source string, source string, source_size long")).collect()
    assert {r.source: r.weight for r in got} == weight
    assert {r.source: r.target for r in got} == pytest.approx(want)


def test_language_of_odd_texts():
    model = langid.Model()
    assert model.predict([b"abc", b""])[0] == ["und", "und"]
    assert not langid.has_letter("12 ٣ !".encode()) and langid.has_letter("ß".encode())


def test_learned_language(spark):
    rng = random.Random(1)
    stems = {"en": ["the", "and", "ing"], "de": ["der", "und", "ung"], "fr": ["les", "des", "eau"], "es": ["los", "que", "ñez"]}
    data = [(i, " ".join(rng.choice(stems[g]) + rng.choice(stems[g]) for _ in range(30)), g) for i, g in enumerate(["en", "de", "fr", "es"] * 40)]
    docs = spark.createDataFrame([*data, (1000, None, "en"), (1001, "1 2 3", "en")], "doc_id long, text string, lang string")
    model = langid.fit(docs.filter("doc_id % 5 <> 2 or doc_id > 999"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, model).collect()}
    assert [h[0] for h in model.heads] == ["family", "pair", "pair"]
    assert got[1000] == ("und", 0.0) and got[1001] == ("und", 0.0)
    assert sum(got[i][0] == g for i, _, g in data) > 155 and all(0 <= s <= 1 for _, s in got.values())

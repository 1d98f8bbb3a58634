"""Operators on small tables."""

from quillstone.operators import answers, chunking, lines, maintenance, retrieval, vectors


def test_join_lines(spark):
    rows = [(1, i, x) for i, x in enumerate(["The regula-", "tory body meets", "• first item", "Scope:", "applies to all"])]
    got = lines.joined_lines(spark.createDataFrame(rows, "id long, line_no int, line string"), "id").orderBy("seg").collect()
    assert "\n".join(r.content for r in got) == "The regulatory body meets\n• first item\nScope:\napplies to all"


def test_repeated_headers(spark):
    pages = [("d", i, f"Page {i} of 5\nbody {i} text that is long\nmore of it") for i in range(1, 6)]
    df = spark.createDataFrame(pages, "doc_name string, page long, text string")
    assert [r.norm for r in lines.repeated_lines(df, []).collect()] == ["page 0 of 0"]
    assert lines.repeated_lines(df.filter("page < 3"), []).count() == 0


def test_packing(spark):
    df = spark.createDataFrame([(1, 0, 300), (1, 1, 300), (1, 2, 100)], "u long, b long, n int")
    assert [r.chunk_no for r in chunking.packed(df, "u", "b", "n", 500).orderBy("b").collect()] == [0, 1, 1]


def test_slices(spark):
    df = spark.createDataFrame([("x" * 1200,), ("",), ("ab",)], "text string")
    got = [(r.begin, len(r.piece)) for r in chunking.window_slices(df, "text", 500, 100, tail=True).filter("length(text) > 2").orderBy("slice_no").collect()]
    assert got == [(0, 500), (400, 500), (800, 400), (700, 500)]
    assert chunking.window_slices(df, "text", 500, 100).filter("length(text) <= 2").count() == 2


def test_manifest_and_ids(spark):
    a = spark.createDataFrame([("same", "1"), ("new", "2"), ("changed", "3")], "filename string, sha256 string")
    b = spark.createDataFrame([("same", "1"), ("gone", "2"), ("changed", "4")], "filename string, sha256 string")
    assert {r.filename: r.status for r in maintenance.manifest_diff(a, b).collect()} == {"same": "unchanged", "new": "new", "changed": "changed", "gone": "removed"}
    new = spark.createDataFrame([(f"n{i}",) for i in range(100)], "name string")
    for ids, first in (([], 1), ([1, 5], 6)):
        rows = spark.createDataFrame([(i,) for i in ids], "chunk_id long")
        assert sorted(r.chunk_id for r in maintenance.with_next_ids(new, rows, ["name"]).collect()) == list(range(first, first + 100))
    odd = spark.createDataFrame([(f"d{i % 7}" if i % 11 else None, (i * 37) % 1000) for i in range(1000)], "doc string, page long").repartition(7)
    got = sorted(maintenance.with_next_ids(odd, spark.createDataFrame([(41,)], "chunk_id long"), ["doc", "page"]).collect(), key=lambda r: r.chunk_id)
    assert [r.chunk_id for r in got] == list(range(42, 1042)) and [(r.doc or "", r.page) for r in got] == sorted((r.doc or "", r.page) for r in got)
    builds = spark.createDataFrame([(f"b{i}", i == 1) for i in range(1, 6)], "build_id string, is_active boolean")
    assert [r.build_id for r in maintenance.to_delete(builds, 3).collect()] == ["b2"]


def test_page_window(spark):
    units = spark.createDataFrame([(p, "d", p, "") for p in range(6, 15)], "chunk_id long, doc_name string, page long, text string")
    hits = spark.createDataFrame([(1, 10)], "query_id long, chunk_id long")
    assert sorted(r.chunk_id for r in retrieval.page_window(hits, units, 3, 0.14).collect()) == [7, 8, 9, 11, 12, 13]


def test_keyword_scores(spark):
    texts = [(1, "alpha beta gamma delta"), (2, "alpha beta gamma"), (3, "alpha beta"), (4, "alpha"), (5, None), (6, "alpha beta gamma xx delta")]
    units = spark.createDataFrame(texts, "chunk_id long, text string")
    asks = spark.createDataFrame([(1, ["alpha", "beta", "gamma", "delta"]), (2, ["alpha", "zzz"]), (3, ["alpha"]), (4, [])], "query_id long, toks array<string>")
    for block in (1, 100):
        got = {(r.query_id, r.chunk_id): r.score for r in retrieval.keyword_scan(units, asks, block).collect()}
        assert {c: s for (q, c), s in got.items() if q == 1} == {1: 0.75, 2: 0.60, 3: 0.55, 6: 0.65}
        assert got[2, 4] == 0.55 and got[3, 4] == 0.65 and not any(q == 4 for q, _ in got)


def test_fusion_and_threshold(spark):
    k = spark.createDataFrame([(1, 7, 0.65)], "query_id long, chunk_id long, score double")
    s = spark.createDataFrame([(1, 7, 0.40)], "query_id long, chunk_id long, score double")
    assert retrieval.fused(k, s, 0.1, 10).first().score == 0.69
    h = spark.createDataFrame([(1, 1, 0.17), (1, 2, 0.10), (1, 3, 0.05)], "query_id long, vec_id long, score double")
    assert sorted(r.vec_id for r in vectors.thresholded(h, 0.18, 0.06, 14).collect()) == [1, 2]


def test_top_k_is_nested(spark):
    e = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)], "vec_id long, embedding array<float>").repartition(4)
    q = e.filter("vec_id < 3").selectExpr("vec_id as query_id", "embedding")
    small, large = ({(r.query_id, r.vec_id) for r in vectors.top_k(e, q, k, block=2).collect()} for k in (5, 9))
    assert len(small) == 15 and small < large


def test_blend_and_budget(spark):
    h = spark.createDataFrame([(1, 1, 0.8, 6)], "query_id long, chunk_id long, score double, overlap int")
    assert abs(retrieval.blended(h, 0.75, 12).first().blend - 0.725) < 1e-9
    c = spark.createDataFrame([(1, i, n) for i, n in enumerate([10_000, 15_000, 5_000, 1_000])], "q long, i int, n int")
    assert retrieval.within_budget(c, "q", ["i"], "n", 28_000, 30).count() == 2


def test_citations(spark):
    refs = spark.createDataFrame([(q, i, "A" if i < 3 else "B", 1 if i < 3 else 2) for q in (1, 2) for i in range(1, 6)], "query_id long, ref_id int, doc_name string, page long")
    said = spark.createDataFrame([(1, "x [2] y [2] z [9]"), (2, "none")], "query_id long, answer string")
    got = answers.cited(said, refs)
    assert sorted((r.query_id, r.ref_id) for r in got.collect()) == [(1, 2), (2, 1), (2, 2), (2, 3)]
    assert sorted((r.display_id, r.source_rank) for r in answers.renumbered(refs.filter("query_id = 1 and ref_id < 4")).collect()) == [(1, 1), (2, 3)]


def test_history_and_ranges(spark):
    turns = [(1, 1, "user", "a"), (1, 2, "assistant", "no information available"), (2, 1, "user", "a"), (3, 1, "user", "a"), (3, 2, "assistant", "fine"), (3, 3, "system", "x")]
    got = answers.usable_history(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), ["no information available"]).collect()
    assert {r.conv_id for r in got} == {3} and len(got) == 2
    pages = spark.createDataFrame([("d", p) for p in (3, 1, 2, 7, 7)], "doc string, page long")
    assert answers.page_ranges(pages, ["doc"]).first().pages == "1–3, 7"


def test_evaluation(spark):
    cases = spark.createDataFrame([(1, ["whole of the town"], "Extends to the whole of Town"), (2, ["WHOLE"], "the whole")], "case_id long, keywords array<string>, answer string")
    assert {r.case_id: (r.passed, r.missing) for r in answers.checked(cases).collect()} == {1: (False, "whole of the town"), 2: (True, "")}


def test_chunks_of_a_unit(spark):
    """Blocks under role titles, packing, stitching, short chunks and context, against a plain version."""
    import random
    import re

    from pyspark.sql import functions as F

    from quillstone import lexicon
    from quillstone.plans.ingest import chunk_units

    bullet, heading = re.compile(r"^\s*([•-]|\d+[).]|[a-zA-Z][).])\s+"), re.compile(r"^\s*(schedule|annex|annexure|appendix|chapter|section)\b", re.I)
    rng = random.Random(7)
    prose = lambda n: " ".join(rng.choice(["rule", "office", "public", "order", "of", "a", "year", "within"]) for _ in range(n))
    kinds = [lambda: prose(rng.randrange(5, 40)), lambda: "• " + prose(6), lambda: "", lambda: "Chapter " + prose(2), lambda: rng.choice(["Project Manager", "Position Title: - Network Administrator", "Chief Technology Officer", "Reports to: Manager"]), lambda: prose(300)]
    texts = [(f"d{i % 3}", i, "\n".join(rng.choice(kinds)() for _ in range(rng.randrange(1, 40)))) for i in range(40)] + [("e", 1, None), ("e", 2, ""), ("e", 3, "short text stays"), ("e", 4, "word " * 3000)]

    def structured(x):
        return bool(bullet.match(x)) or (len(x) >= 18 and ("\t" in x or x.count(" | ") >= 2))

    def title(x):
        if re.match(r"\s*(reports? *to|reporting *to)\b", x, re.I):
            return None
        name = re.sub(r"^[-•:\s]+", "", re.sub(r"^\s*(position *title|job *title|role)\s*[:-]+\s*", "", x, flags=re.I)) if re.match(r"\s*(position *title|job *title|role)\s*[:-]+", x, re.I) else x
        return name if len(name) <= 80 and re.match(r"^(chief technology officer|[a-z]+ manager|[a-z][a-z &]+ (officer|manager|administrator))$", name, re.I) else None

    def clean(t):
        t = "\n".join(x.strip() for x in re.sub(r"\n{4,}", "\n\n\n", t).split("\n")).strip()
        return re.sub(r"[ \t]+", " ", t).strip()

    def tail_of(t):
        t = t[-80:].strip()
        if t and re.match(r"\w", t) and (m := re.search(r"\W", t)) and 0 < m.start() < 20:
            t = t[m.start() :].lstrip()
        return t.strip()

    def plain(text, most=500, overlap=80, least=200):
        t = clean(text or "")
        if len(t) < least:
            return [t] if t else []
        groups, role, buf = [], None, []

        def flush():
            if buf:
                if not groups or groups[-1][0] != role:
                    groups.append((role, []))
                groups[-1][1].append("\n".join(buf))
                buf.clear()

        for x in t.split("\n"):
            if not x:
                flush()
            elif title(x):
                flush()
                role = title(x)
                buf.append(x)
            elif heading.match(x):
                flush()
                buf.append(x)
            else:
                if buf and structured(buf[-1]) != structured(x):
                    flush()
                buf.append(x)
        flush()
        out = []
        for role, blocks in groups:
            cs, held, size = [], [], 0
            for b in [*blocks, None]:
                if held and (b is None or len(b) > most or size + len(b) + 2 > most):
                    cs.append("\n\n".join(held))
                    held, size = [], 0
                if b and len(b) > most:
                    at = 0
                    while at + most < len(b):
                        cs.append(b[at : at + most])
                        at += most - overlap
                    cs += [b[at : at + most], b[-most:]]
                elif b:
                    held.append(b)
                    size += len(b) + 2
            cs = [c for c in map(clean, cs) if c]
            st = [c if not i or not tail_of(cs[i - 1]) else clean(tail_of(cs[i - 1]) + "\n\n" + c) for i, c in enumerate(cs)]
            for i, c in enumerate(st):
                if len(c) >= least or len(st) == 1 or any(k in c.lower() for k in lexicon.KEEP_MARKS) or (i == len(st) - 1 and len(re.findall(r"[A-Za-z]{3,}", c)) >= 10):
                    out.append(f"[Role: {role}]\n{c}" if role and role.lower() not in c.lower() else c)
        return out

    df = spark.createDataFrame(texts, "doc_name string, page long, text string")
    got = df.select("doc_name", "page", F.explode_outer(chunking.chunked(F.col("text"), 500, 80, 200, lexicon.KEEP_MARKS)).alias("c")).groupBy("doc_name", "page").agg(F.collect_list("c").alias("cs")).collect()
    by_key = {(r.doc_name, r.page): r.cs for r in got}
    for d, p, t in texts:
        assert sorted(by_key[d, p]) == sorted(plain(t)), (d, p)
    made = chunk_units(df)
    assert made.filter("text like '%short text stays%' or length(text) > 5100").count() == 0 and made.filter("doc_name = 'e' and page = 4").count() == 5
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()

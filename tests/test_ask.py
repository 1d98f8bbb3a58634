"""The whole path: units to chunks to answers."""

import json

from pyspark.sql import functions as F

from quillstone.functions.embed import char_batches, embedded, hashed_ngrams
from quillstone.operators import replies
from quillstone.plans.ask import ask, prepared
from quillstone.plans.ingest import ingest
from quillstone.sources.scratch import kept

PAGES = [
    ("rules.pdf", 1, "The Director General heads the office and signs every contract of the authority. " * 3),
    ("rules.pdf", 2, "Salary of the Enforcement Officer follows the table. Minimum Pay and Maximum Pay are listed here. " * 3),
    ("rules.pdf", 3, "Leave is granted by the Manager on a written request made two weeks before. " * 3),
    ("acts.pdf", 1, "A hearing takes place within thirty days of the complaint, under section 12 of the act. " * 3),
]


def index(spark):
    units = spark.createDataFrame(PAGES, "doc_name string, page long, text string")
    files = spark.createDataFrame([("rules.pdf", "1"), ("acts.pdf", "2")], "filename string, sha256 string")
    chunks = kept(ingest(units, files, None, None, 0)[0])
    return chunks, chunks.select("chunk_id", embedded(F.col("text")).alias("embedding"))


def test_answers(spark):
    chunks, v = index(spark)
    asks = [(1, "who is the dg"), (2, "salery of enforcment offcer"), (3, "hello"), (4, "hearing after a complaint"), (5, "zzz qqq xxx")]
    out, refs = ask(spark.createDataFrame(asks, "query_id long, question string"), chunks, v)
    got = {r.query_id: r for r in out.collect()}
    assert set(got) == {1, 2, 3, 4, 5} and got[3].route == "A"
    top = {r.query_id: (r.doc_name, r.page) for r in refs.filter("display_id = 1").collect()}
    assert top[1] == ("rules.pdf", 1) and top[2] == ("rules.pdf", 2) and top[4] == ("acts.pdf", 1)
    assert got[4].decision == "answer" and got[5].decision == "refuse"
    reply = json.loads(replies.as_json(out, refs.withColumnRenamed("display_id", "ref_id")).filter("query_id = 4").first().response)
    assert reply["references"][0]["doc_name"] == "acts.pdf"


def test_follow_ups_names_and_citations(spark):
    from quillstone.plans.ask import prepared

    pages = [*PAGES, ("staff.pdf", 1, "The office is headed by Dr. Amina Khan since the spring of last year, and reports yearly. " * 2)]
    files = spark.createDataFrame([("rules.pdf", "1"), ("acts.pdf", "2"), ("staff.pdf", "3")], "filename string, sha256 string")
    chunks = kept(ingest(spark.createDataFrame(pages, "doc_name string, page long, text string"), files, None, None, 0)[0])
    v = chunks.select("chunk_id", embedded(F.col("text")).alias("embedding"))
    asks = spark.createDataFrame([(1, "what is its salary"), (2, "ok"), (3, "what is its salary"), (4, "leave granted by the manager"), (5, "naam batao zzz")], "query_id long, question string")
    turns = [(1, 1, "user", "enforcement officer"), (1, 2, "assistant", "**The officer** [1] works"), (2, 1, "user", "x"), (2, 2, "assistant", "fine"), (3, 1, "user", "enforcement officer"), (3, 2, "assistant", "not mentioned in the context")]
    history = spark.createDataFrame(turns, "query_id long, turn long, role string, text string")
    got = {r.query_id: r.asked for r in prepared(asks, None, history).collect()}
    assert got[1] == "what is its salary enforcement officer pay schedule" and got[2] == "ok" and got[3] == "what is its salary"
    failing = {r.query_id: r.asked for r in prepared(asks, lambda q, a, b: F.lit(None).cast("string"), history).collect()}
    assert failing[1] == "what is its salary pay schedule"
    said = lambda refs: refs.select("query_id").distinct().select("query_id", F.lit("as [1] says").alias("answer"))
    out, refs = ask(asks, chunks, v, answerer=said, history=history)
    found = {(r.query_id, r.display_id): r.doc_name for r in refs.collect()}
    assert {i for _, i in found} == {1} and found[1, 1] == "rules.pdf" and out.count() == 5
    from quillstone.plans.ask import evidence

    hits = evidence(prepared(asks), chunks, v).filter("query_id = 5").join(chunks.select("chunk_id", "doc_name"), "chunk_id")
    assert hits.filter("doc_name = 'staff.pdf'").first().score >= 0.6


def test_several_wordings(spark):
    from quillstone.plans.variants import retrieve, wordings

    chunks, v = index(spark)
    asks = spark.createDataFrame([(1, "who is the dg"), (2, "Enforcement Officer"), (3, "hearing after a complaint"), (4, "zzz qqq xxx")], "query_id long, question string")
    w = {(r.query_id, r.no): r.wording for r in wordings(asks, 3).collect()}
    assert w[1, 1] == "who is the dg" and w[1, 2] == "who is the Director General" and w[2, 2] == "officer enforcement" and w[3, 2].startswith("hearing after a complaint complaint complaints")
    got = retrieve(asks, chunks, v).collect()
    top = {r.query_id: (r.doc_name, r.page) for r in sorted(got, key=lambda r: r.blend) if r.doc_rank == 1 and not r.is_context}
    assert top[2] == ("rules.pdf", 2) and top[3] == ("acts.pdf", 1)
    assert len({(r.query_id, r.chunk_id) for r in got}) == len(got)
    # neighbouring pages come along only where a question is about pay or asks for details
    assert not any(r.is_context for r in got)
    wide = retrieve(spark.createDataFrame([(5, "Enforcement Officer full details please of this role here")], asks.schema), chunks, v).collect()
    assert any(r.is_context for r in wide) and len({r.chunk_id for r in wide}) == len(wide)


def test_embedder(spark):
    v = hashed_ngrams(["abc abc", "abc abd", "zzzz"])
    assert abs(float(v[0] @ v[0]) - 1) < 1e-5 and v[0] @ v[1] > v[0] @ v[2]
    assert [len(b) for b in char_batches(["a" * 30, "b" * 15, "c" * 5, "d" * 90], 50)] == [3, 1]
    df = spark.createDataFrame([("x y z",), (None,)], "t string")
    assert all(len(r.e) == 64 for r in df.select(embedded(F.col("t")).alias("e")).collect())


def test_wordings_of_a_model(spark):
    from quillstone.plans.variants import wordings

    asks = spark.createDataFrame([(1, "who is the dg"), (2, "who leads papers now"), (3, "same")], "query_id long, question string")
    said = spark.createDataFrame([(1, '{"queries": ["Director General", "WHO IS THE DG", "head", "chief"]}'), (2, "no JSON"), (3, None)], "query_id long, reply string")
    w = {}
    for r in sorted(wordings(asks, 3, said, 5).collect(), key=lambda r: r.no):
        w.setdefault(r.query_id, []).append(r.wording)
    assert w == {1: ["who is the dg", "who is the Director General", "Director General", "head"], 2: ["who leads papers now"], 3: ["same"]}


def test_canned_replies_and_spelling_in_ask(spark):
    chunks, v = index(spark)
    asks = spark.createDataFrame([(1, "who created you"), (2, "what is your name"), (3, "hello, hearing after a complaint"), (4, "hearng after a complaint")], "query_id long, question string")
    vocabulary = spark.createDataFrame([("hearing", 5), ("after", 2), ("complaint", 9)], "word string, n long")
    out, refs = ask(asks, chunks, v, vocabulary=vocabulary, canned={"greeting": "Hi!", "identity": "The assistant.", "creator": "Its makers."})
    got = {r.query_id: r.answer for r in out.collect()}
    assert got[1] == "Its makers." and got[2] == "The assistant." and got[3].startswith("Hello! ") and {r.query_id for r in refs.collect()} == {3, 4}
    asked = {r.query_id: r.asked for r in prepared(asks, vocabulary=vocabulary).collect()}
    assert asked[4] == "hearing after a complaint"


def test_posting_lists_in_ask(spark):
    from quillstone.operators import postings
    from quillstone.sources.scratch import new_folder

    chunks, v = index(spark)
    path = new_folder(spark, "postings")
    postings.add(chunks, path)
    asks = spark.createDataFrame([(1, "hearing after a complaint"), (2, "Enforcement Officer")], "query_id long, question string")
    plain, by_list = (ask(asks, chunks, v, index=i) for i in (None, postings.opened(spark, path)))
    assert [sorted(map(tuple, x.collect())) for x in plain] == [sorted(map(tuple, x.collect())) for x in by_list]

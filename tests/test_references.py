"""References, canned replies, spelling and upkeep on literal rows: nulls, blanks, ties and what SQL does not state."""

from pyspark.sql import functions as F

from quillstone import lexicon
from quillstone.config import CONFIG as C
from quillstone.operators import answers, maintenance, references, replies, retrieval
from quillstone.plans import ingest
from quillstone.sources.snapshots import Builds


def rows(spark, data, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(data, schema).select(*columns).collect()]


def test_pages_and_places(spark):
    got = rows(spark, [(3, 1), (2, None), (None, 4)], "a int, b int", references.page_list(F.col("a"), F.col("b")))
    assert got == [([1, 2, 3],), ([2],), ([],)]
    assert rows(spark, [(" b ", None), (None, None), ("a", "b"), ("", "a")], "x string, y string", references.place_list(F.col("x"), F.col("y"))) == [(["b"],), ([],), (["a", "b"],), (["a"],)]


def test_addresses(spark):
    data = [(None, None, None, None, []), ("http://x/#a", "p", None, "d", [2]), ("", "sub\\f.pdf", "?v", "d", [5, 3]), (None, "https://y/z", None, "d", [])]
    url = references.open_url(F.lit("http://b"), *[F.col(c) for c in ("given", "path", "hint", "document", "pages")])
    got = rows(spark, data, "given string, path string, hint string, document string, pages array<bigint>", url)
    assert [r[0] for r in got] == ["http://b/assets/data/Unknown%20document", "http://x/#a", "http://b/sub/f.pdf?v#page=3", "https://y/z"]
    assert rows(spark, [("/a/b/../../etc",), ("/a/b/./c",), (None,), ("a/b",), ("/a/bc",), ("/a/b",)], "p string", references.is_contained(F.col("p"), "/a/b")) == [(False,), (True,), (False,), (False,), (False,), (True,)]


def test_groups_of_no_references(spark):
    schema = "query_id long, ref_id long, document string, path string, url string, snippet string, page_start long, page_end long, place string"
    assert references.grouped(spark.createDataFrame([], schema)).collect() == []
    got = references.grouped(spark.createDataFrame([(1, 2, "d", None, "u2", None, None, None, None), (1, 1, "d", "", None, "", 2, 1, "x")], schema)).collect()
    assert [tuple(r) for r in got] == [(1, "d", "", "u2", "", [1, 2], ["x"])]


def test_greetings_and_intents(spark):
    said = [None, "", "hi", "History of it", "Salam, kya hai", "assalamu question", "سلام سوال"]
    got = rows(spark, [(t,) for t in said], "t string", answers.acknowledged(F.col("t")).alias("x"))
    assert [tuple(r[0]) for r in got] == [("", ""), ("", ""), (lexicon.ACK, ""), ("", "History of it"), (lexicon.ACK_SALAM, "kya hai"), (lexicon.ACK_SALAM, "question"), (lexicon.ACK_URDU, "سوال")]
    asked = [("hello bot", False), ("hello bot", True), ("dg ka naam kya hai", False), ("what is your name", False), ("who built you", True), (None, False), ("hello this is a long question", False)]
    assert [r[0] for r in rows(spark, asked, "q string, h boolean", answers.canned_intent(F.col("q"), F.col("h")))] == ["greeting", None, None, "identity", "creator", None, None]


def test_refusal_cases(spark):
    data = [("Unfortunately no.", ["a"], True, "answer"), ("It is a", ["A"], False, "answer"), ("yeh available nahi hai, a", ["a"], False, "answer"), (None, None, False, None), (None, None, True, None)]
    got = rows(spark, data, "a string, k array<string>, r boolean, d string", answers.passed(F.col("a"), F.col("k"), F.col("r"), F.col("d")).alias("x"))
    assert [r[0]["passed"] for r in got] == [True, True, False, True, False]


def test_corrected_questions(spark):
    v = spark.createDataFrame([("minimum", 3), ("salary", 9), ("grades", 1), ("policy", 2)], "word string, n long")
    q = spark.createDataFrame([(1, "minimun salery of the gradez"), (2, "salary policies"), (3, None), (4, ""), (5, "minimun " * 25)], "query_id long, question string")
    assert {r.query_id: r.corrected for r in retrieval.corrected(q, v, lexicon.OVERLAP_STOP, lexicon.KEEP_SHORT).collect()} == {1: "minimum salary of the gradez"}


def test_sessions(spark):
    old = spark.createDataFrame([("o", 1, "a", 1, 0), ("o", 2, "b", 1, 1)], "owner string, conv_id long, title string, n_turns long, place long")
    new = spark.createDataFrame([("o", 2, "b2", 3, 5), ("o", 7, "n7", 1, 4), ("o", 8, "n8", 1, 6), ("p", 1, None, 1, 1)], "owner string, conv_id long, title string, n_turns long, saved_at long")
    got = sorted((r.owner, r.place, r.conv_id, r.title) for r in replies.upserted(old, new).collect())
    assert got == [("o", 0, 8, "n8"), ("o", 1, 7, "n7"), ("o", 2, 1, "a"), ("o", 3, 2, "b2"), ("p", 0, 1, None)]
    assert rows(spark, [("x" * 38,), ("short",), (None,)], "t string", replies.session_title(F.col("t"))) == [("x" * 38 + "...",), ("short",), (None,)]


def test_stale_rows_are_made_anew(spark):
    schema = "chunk_id long, doc_name string, loc_label string, tags array<string>, text string, active boolean, embed_version int, search_version int, embed_sha256 string, search_sha256 string, public_path string, extra string"
    t = spark.createDataFrame([(1, "d x", "Page 1", ["a"], "one", True, 1, 2, None, None, None, "e"), (2, "d", "Page 1", [], "two", False, 1, 1, None, None, None, "f")], schema)
    table, vectors = ingest.reindexed(t)
    by_id = {r.chunk_id: r for r in table.collect()}
    assert by_id[1].embed_version == C.embed_version and by_id[1].public_path == "/assets/data/d%20x" and by_id[1].extra == "e"
    assert by_id[2].embed_version == 1 and not by_id[2].active
    assert [r.chunk_id for r in vectors.collect()] == [1]
    again = maintenance.refreshed(table.drop("embed_text", "search_text")).collect()
    assert [r.refreshed for r in again] == [False]


def test_vocabulary_is_kept_with_its_build(spark, tmp_path):
    chunks = spark.createDataFrame([("alpha beta alpha",), (None,)], "text string")
    builds = Builds(str(tmp_path))
    assert {tuple(r) for r in ingest.vocabulary(builds, chunks).collect()} == {("alpha", 2), ("beta", 1)}
    assert builds.publish(spark, "build_1", {"chunks": chunks.withColumn("active", F.lit(True))})
    assert ingest.vocabulary(builds, chunks).count() == 2
    assert ingest.vocabulary(builds, chunks.limit(0)).count() == 2


def test_blocks_of_answers(spark):
    from quillstone.operators import replies

    rows = [(1, "# no\n## Yes **b**\n- a\n- b *c*\n1. x\n- d\n\n\nend [12]"), (2, ""), (3, None), (4, "\n\n"), (5, "- only"), (6, "2) n\n3. m\n \n4. o")]
    got = {r.id: [(b.kind, list(b["items"])) for b in r.b] for r in spark.createDataFrame(rows, "id long, t string").select("id", replies.answer_blocks(F.col("t")).alias("b")).collect()}
    assert got[1] == [("para", ["# no"]), ("heading", ["Yes <strong>b</strong>"]), ("ul", ["a", "b <em>c</em>"]), ("ol", ["x"]), ("ul", ["d"]), ("space", []), ("para", ['end <span class="cite-badge">[12]</span>'])]
    assert got[2] == got[3] == got[4] == [] and got[5] == [("ul", ["only"])] and got[6] == [("ol", ["n", "m"]), ("space", []), ("ol", ["o"])]

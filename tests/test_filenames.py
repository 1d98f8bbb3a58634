"""File names, links, marks, scans and retries on literal rows: nulls, blanks, ties and what SQL does not state."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.config import Config
from quillstone.functions import text as T
from quillstone.functions.embed import embedded, hashed_ngrams, retried
from quillstone.operators import answers, filenames, maintenance, references, replies
from quillstone.plans import ingest
from quillstone.plans.variants import retrieve
from tests.test_ask import index


def test_names_in_six_tiers(spark):
    names = spark.createDataFrame([("A – b.pdf",), ("A - b.pdf",), ("c-d",), ("e-f.pdf",), ("G (1).pdf",), ("g 1.pdf",), ("سوال.pdf",), ("x%y+z.pdf",), (None,), ("",)], "name string")
    asked = {
        "A – b.pdf": ("A – b.pdf", 1), "A%20%E2%80%93%20b.pdf": ("A – b.pdf", 1), "c—d": ("c-d", 2), "A – b": ("A – b.pdf", 3), "e–f": ("e-f.pdf", 4),
        "a −  B.PDF": ("A - b.pdf", 5), "g [1]": ("G (1).pdf", 6), "سوال": ("سوال.pdf", 3), "x%y+z.pdf": ("x%y+z.pdf", 1),
        "جواب": None, "": None, "  ": None, None: None, "nothing": None,
    }
    wanted = spark.createDataFrame([(w,) for w in [*asked, "e–f"]], "wanted string")
    got = filenames.resolved(wanted, names).collect()
    assert {r.wanted: (r.name, r.tier) for r in got} == {w: a for w, a in asked.items() if a} and len(got) == sum(a is not None for a in asked.values())
    assert filenames.resolved(wanted, names.limit(0)).collect() == []


def test_documents_whose_file_is_gone(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a.pdf"), (3, "b"), (4, None), (5, ""), (6, "a")], "i long, doc_name string")
    names = spark.createDataFrame([("a.pdf",), ("a.pdf",), ("b.txt",), (None,), (".pdf",)], "name string")
    assert sorted(r.i for r in filenames.existing(rows, names).collect()) == [1, 2, 6]


def test_retrieve_leaves_out_documents_without_a_file(spark):
    chunks, v = index(spark)
    asks = spark.createDataFrame([(2, "Enforcement Officer"), (3, "hearing after a complaint")], "query_id long, question string")
    files = spark.createDataFrame([("acts.pdf",)], "name string")
    assert {r.doc_name for r in retrieve(asks, chunks, v, files=files).collect()} == {"acts.pdf"}


def test_highlights_and_marks(spark):
    rows = [("First line here.\nsecond • A longer third one", "What is the Pay-scale of it?"), (None, None), ("ab", "who"), (" \n ", "l'été")]
    made = spark.createDataFrame(rows, "s string, q string").select(references.highlights(F.col("s"), F.col("q")).alias("p"))
    assert [r.p for r in made.collect()] == [["First line here. second • A longer third one", "First line here", "A longer third one", "pay", "scale"], [], [], ["été"]]
    page = [("FIRST LINE HERE and scale", ["first line here", "First line here and more", "pay", "scale", "scale"]), (None, ["x"]), ("a", [])]
    marked = spark.createDataFrame(page, "t string, p array<string>").select(references.marks(F.col("t"), F.col("p")).alias("m"))
    # 20 characters of the second phrase are on the page: "First line here and "
    assert [r.m for r in marked.collect()] == [["first line here", "First line here and ", "scale"], [], []]


def test_links_and_places(spark):
    data = [("/p/a.pdf", "d", 3), (None, "d e", None), ("", None, 1)]
    urls = spark.createDataFrame(data, "path string, doc string, page long").select(references.page_url(F.lit("http://h"), F.col("path"), F.col("doc"), F.col("page")).alias("u"))
    assert [r.u for r in urls.collect()] == ["http://h/p/a.pdf#page=3", "http://h/assets/data/d e", "http://h/assets/data/#page=1"]
    places = spark.createDataFrame([([str(i) for i in range(8)],), (["a"],), ([],)], "p array<string>").select(references.shown_places(F.col("p")).alias("s"))
    assert [r.s for r in places.collect()] == ["0; 1; 2; 3; 4; 5; +2 more", "a", ""]


def test_references_without_a_page_stay(spark):
    refs = spark.createDataFrame([(1, 1, "d", None, "s"), (1, 2, "e", 4, "t")], "query_id long, ref_id int, doc_name string, page long, snippet string")
    r = replies.html(refs).first()
    assert r["keys"] == "d,e#4" and "<li>1. d: s</li><li>2. e p.4: t</li>" in r["html"]


def test_the_last_pair(spark):
    turns = [(1, 1, "user", "a", "c"), (1, 2, "assistant", "b", "c"), (1, 3, "user", "c", "c"), (1, 4, "assistant", "", "c"), (2, 1, "system", "x", None), (3, 1, "user", "q", None), (3, 2, "user", None, None)]
    t = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, question string")
    assert sorted(map(tuple, answers.last_pair(t).collect())) == [(1, "a", "b"), (2, None, None), (3, "q", None)]
    assert sorted(map(tuple, answers.last_pair(t.drop("question")).collect())) == [(1, "c", "b"), (2, None, None), (3, "q", None)]


def test_summaries(spark):
    cases = spark.createDataFrame([("x", True), ("x", False), ("x", None), ("y", True)], "kind string, passed boolean")
    assert sorted(map(tuple, answers.summary(cases, "kind").collect())) == [("x", 3, 1, 2, 0.333333), ("y", 1, 1, 0, 1.0)]
    assert answers.summary(cases.limit(0)).first().n == 0


def test_scans(spark):
    schema = "filename string, path string, ext string, mtime long, size long, rank int, sha256 string"
    found = spark.createDataFrame([("a", "/a", "txt", 9, 1, 0, "1"), ("b", "/b", "txt", 9, 1, 0, "2"), ("c", "/c", "txt", 9, 1, 0, "3")], schema)
    known = maintenance.manifest(spark.createDataFrame([("a", "/a", "txt", 5, 1, 0, "1"), ("b", "/b", "txt", 5, 1, 0, "0"), ("z", "/z", "txt", 5, 1, 0, "9")], schema))
    rows, status, counts = maintenance.scanned(found, known)
    assert {r.filename: (r.mtime, r.sha256) for r in rows.collect()} == {"a": (5, "1"), "b": (9, "2"), "c": (9, "3")} and rows.columns == known.columns
    assert dict(map(tuple, status.collect())) == {"a": "unchanged", "b": "changed", "c": "new", "z": "removed"} and tuple(counts.first()) == (3, 2, 1, 1)
    # a second scan of what was saved finds nothing new
    assert tuple(maintenance.scanned(found, rows)[2].first()) == (3, 0, 3, 0)


def test_written_out(spark):
    said = ["The CTO's PIRA", None, "", "dg_x édg dg", "سوال، DG", "a-b HR/IT"]
    got = spark.createDataFrame([(s,) for s in said], "s string").select(T.expanded_text(F.col("s"), {"cto": "chief officer", "dg": "director general", "hr": "human resource", "it": "technology"}, {"pira": "pera"}).alias("t"))
    assert [r.t for r in got.collect()] == ["the chief officer s pera", "", "", "dg x dg director general", "سوال، director general", "a b human resource technology"]


def test_an_embedder_is_tried_again():
    calls, waits = [], []

    def flaky(texts):
        calls.append(len(texts))
        if len(calls) < 3:
            raise OSError("busy")
        return np.ones((len(texts), 2))

    assert retried(flaky, 4, 0.8, waits.append)(["a", "b"]).shape == (2, 2) and waits == [0.8, 1.6] and calls == [2, 2, 2]
    for bad in (lambda t: 1 / 0, lambda t: np.ones((len(t) + 1, 2))):
        waits.clear()
        with pytest.raises(RuntimeError, match="failed 4 times"):
            retried(bad, 4, 0.8, waits.append)(["a"])
        assert waits == [0.8, 1.6, 3.2]


def test_texts_that_fail_for_good_are_marked(spark):
    def picky(texts):
        if any("bad" in t for t in texts):
            raise ValueError("refused")
        return hashed_ngrams(texts, 8)

    long = "x" * 11_000  # so that batches hold three texts
    rows = spark.createDataFrame([(i, ("bad" if i == 4 else "good") + long) for i in range(9)], "chunk_id long, embed_text string").coalesce(1)
    config = Config(embed_tries=2, embed_wait=0.0)
    vectors, failed = ingest.embedded_rows(rows, picky, config)
    assert {r.chunk_id for r in failed.collect()} == {3, 4, 5}
    assert {r.chunk_id for r in vectors.collect()} == {0, 1, 2, 6, 7, 8} and all(len(r.embedding) == 8 for r in vectors.collect())
    with pytest.raises(Exception, match="refused"):
        rows.select(embedded(F.col("embed_text"), picky)).collect()


def test_hashed_ngrams_do_not_depend_on_the_batch():
    texts = ["", "a", "Grüße 😀", "long " * 50, "a"]
    together = hashed_ngrams(texts)
    assert np.array_equal(together, np.concatenate([hashed_ngrams([t]) for t in texts])) and together.shape == (5, 64)
    assert not together[0].any() and hashed_ngrams([]).shape == (0, 64)

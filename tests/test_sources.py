"""Files, snapshots, and the stream: incremental builds equal one cold build."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quillstone.config import Config, from_environment
from quillstone.functions import audio
from quillstone.operators import maintenance, replies
from quillstone.sources import readers
from quillstone.sources.snapshots import Builds
from quillstone.streaming import indexer


def docx(path, paragraphs):
    ns = readers.WORD_NS.strip("{}")
    body = "".join(f'<w:p>{f"""<w:pPr><w:pStyle w:val="{s}"/></w:pPr>""" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>' for s, t in paragraphs)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body>{body}</w:body></w:document>')


def test_units_of_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ftwo\f \fthree")
    docx(tmp_path / "b.docx", [("", "before"), ("Heading1", "Scope"), ("", "first"), ("", "second")])
    (tmp_path / "c.docx").write_text("broken")
    got = [(r.doc_name, r.loc_page, r.loc_anchor, r.text) for r in readers.read_units(spark, str(tmp_path)).orderBy("doc_name", "seq").collect()]
    assert got == [("a.txt", 1, None, "one"), ("a.txt", 2, None, "two"), ("a.txt", 4, None, "three"), ("b.docx", None, 'Section: "Untitled" (Paragraphs 1–1)', "before"), ("b.docx", None, 'Section: "Scope" (Paragraphs 3–4)', "first\nsecond")]


def test_scan_and_jsonl(spark, tmp_path):
    for n in ("book2 x.pdf", "Z.pdf", "note.txt"):
        (tmp_path / n).write_bytes(n.encode())
    assert [(r.filename, r["rank"], r.ext) for r in readers.scan_files(spark, str(tmp_path)).collect()] == [("book2 x.pdf", 2, ".pdf"), ("Z.pdf", 0, ".pdf")]
    (tmp_path / "rows.jsonl").write_text('{"id": 1}\n\nnot json\n{"id": 2}\n')
    assert sorted(r.id for r in readers.read_jsonl(spark, str(tmp_path / "rows.jsonl"), "id long").collect()) == [1, 2]


def test_discovery_and_json_manifest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in ("b.PDF", "a.docx", "c.txt"):
        (tmp_path / "in" / n).write_bytes(b"x")
    assert [r.path.rsplit("/", 1)[1] for r in readers.discovered(spark, str(tmp_path / "in")).collect()] == ["a.docx", "b.PDF"]
    entry = {"filename": "b.pdf", "path": "in/b.pdf", "ext": ".pdf", "mtime": 5, "size": 1, "rank": 2, "sha256": "ab"}
    (tmp_path / "m.json").write_text(json.dumps({"version": 1, "files": {"b.pdf": entry}}, indent=2))
    (tmp_path / "broken.json").write_text('{"version": 1, "files": {')
    assert [r.asDict() for r in readers.read_manifest(spark, str(tmp_path / "m.json")).collect()] == [entry]
    for name in ("broken.json", "missing.json"):
        got = readers.read_manifest(spark, str(tmp_path / name))
        assert got.collect() == [] and got.columns == list(entry)


def test_which_build_is_read(spark, tmp_path):
    b = Builds(str(tmp_path))
    rows = lambda n: spark.createDataFrame([(True, n)], "active boolean, text string")
    assert b.resolve() is None and b.read(spark, "chunks") is None
    assert b.publish(spark, "one", {"chunks": rows("1")}) and b.publish(spark, "two", {"chunks": rows("2")})
    assert (b.resolve(), b.resolve("one"), b.resolve("none"), b.resolve("none", "one")) == ("two", "one", "two", "two")
    assert b.read(spark, "chunks", wanted="one").first().text == "1"
    b.activate("gone")
    assert b.resolve(default="one") == "one" and b.resolve() is None


def test_settings_from_the_environment():
    got = from_environment({"QUILLSTONE_TOP_K": "7", "QUILLSTONE_SIMILARITY": "0.5", "QUILLSTONE_MAX_DOCS": " ", "TOP_K": "9"})
    assert (got.top_k, got.similarity, got.max_docs) == (7, 0.5, Config().max_docs)
    with pytest.raises(ValueError):
        from_environment({"QUILLSTONE_TOP_K": "many"})


def test_written_report(spark, tmp_path):
    cases = spark.createDataFrame([("b", True, ""), ("c", False, "x"), ("a", True, "y")], "id string, passed boolean, note string")
    replies.write_report(cases, str(tmp_path / "r"))
    (part,) = (tmp_path / "r").glob("part-*.txt")
    assert part.read_text().splitlines() == ["FAIL c x", "PASS a y", "PASS b "]


def test_transcriber(spark):
    wav = b"RIFF0000WAVE" + b"\0" * 800
    rows = spark.createDataFrame([(1, wav), (2, b"RIFF"), (3, None), (4, b"x" * 900)], "id long, content binary").coalesce(1)
    heard = lambda contents, kinds: [f"{k} {len(c)}" for c, k in zip(contents, kinds, strict=True)]
    got = {r.id: r.t for r in rows.select("id", audio.transcribed(F.col("content"), heard).alias("t")).collect()}
    assert got == {1: "wav 812", 2: audio.TOO_SHORT, 3: audio.TOO_SHORT, 4: "bin 900"}

    def broken(contents, kinds):
        raise RuntimeError("no model")

    got = {r.id: r.t for r in rows.select("id", audio.transcribed(F.col("content"), broken).alias("t")).collect()}
    assert got[1] == got[4] == audio.FAILED and got[2] == audio.TOO_SHORT


def test_a_large_file_is_read_by_several_tasks(spark, tmp_path, monkeypatch):
    pages = [f"GOVERNMENT authority\nbody of page {i} " + "x" * (i % 700) + f"\nanother line {i}\n" + ("é" * (i % 5)) + f"\n{i}" for i in range(1, 5001)]
    pages[99], pages[2499] = "", "  "
    (tmp_path / "big.txt").write_text("\f".join(pages))
    (tmp_path / "small.txt").write_text("one\ftwo\f")
    (tmp_path / "empty.txt").write_text("")
    units = readers.read_units(spark, str(tmp_path))
    got = {(r.doc_name, r.loc_page): r.text for r in units.collect()}
    assert got == {("big.txt", i): p for i, p in enumerate(pages, 1) if p.strip()} | {("small.txt", 1): "one", ("small.txt", 2): "two"}
    tasks = units.filter("doc_name = 'big.txt'").groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 1 and sum(r["count"] for r in tasks) == 4998
    one = units.filter("doc_name = 'small.txt' and loc_page > 1")
    assert [r.text for r in one.collect()] == ["two"] and one.rdd.getNumPartitions() == 1
    for size in (1, 7, 64):  # borders anywhere: on a form feed, in a letter, between pages
        monkeypatch.setattr(readers, "SPLIT_BYTES", size)
        (tmp_path / "odd").mkdir(exist_ok=True)
        (tmp_path / "odd" / "o.txt").write_text("\fab\f\fééé\fz")
        length = (tmp_path / "odd" / "o.txt").stat().st_size
        cut = [x for a in range(0, length, size) for x in readers.text_range(str(tmp_path / "odd" / "o.txt"), a, min(a + size, length))]
        assert [(n, t) for n, t in cut if t] == [(2, "ab"), (4, "ééé"), (5, "z")]


def test_stripped_units(spark, tmp_path):
    from quillstone.plans.ingest import stripped_units

    body = lambda i: "\n".join(f"line {k} of page {i} tells something of its own" for k in range(6))
    (tmp_path / "a.txt").write_text("\f".join(f"Government of Somewhere\n{body(i)}\nPage {i}" for i in range(1, 6)) + "\fGovernment of Somewhere\nshort")
    got = {r.page: r.text for r in stripped_units(spark, str(tmp_path)).collect()}
    assert {i: got[i] for i in range(1, 6)} == {i: body(i) for i in range(1, 6)}
    assert got[6] == "Government of Somewhere\nshort"  # one line of two would be left: the page stays as it was


def test_chunks_keep_what_their_source_knows(spark, tmp_path):
    from quillstone.plans.ingest import ingest

    (tmp_path / "book3 notes.txt").write_text("first page " * 20 + "\f" + "second page " * 20)
    docx(tmp_path / "b.docx", [("Heading1", "Scope"), ("", "what it covers " * 20), ("Heading1", "Terms"), ("", "what words mean " * 20)])
    units = readers.read_units(spark, str(tmp_path))
    files = units.select(F.col("doc_name").alias("filename")).distinct().withColumn("sha256", F.lit("x"))
    rows = sorted(ingest(units, files, None, None, 0)[0].collect(), key=lambda r: r.chunk_id)
    got = [(r.chunk_id, r.doc_name, r.loc_label, r.source_type, r.doc_rank) for r in rows]
    assert got == [(1, "b.docx", 'Section: "Scope" (Paragraphs 2–2)', "docx", 0), (2, "b.docx", 'Section: "Terms" (Paragraphs 4–4)', "docx", 0), (3, "book3 notes.txt", "Page 1", "txt", 3), (4, "book3 notes.txt", "Page 2", "txt", 3)]
    assert rows[0].embed_text.startswith('DOCUMENT: b.docx\nRANK: 0\nTYPE: docx\nLOCATION: Section: "Scope" (Paragraphs 2–2)\nTAGS:')
    assert not maintenance.refreshed(spark.createDataFrame(rows, ingest(units, files, None, None, 0)[0].schema).withColumn("public_path", F.lit(None).cast("string"))).filter("embed_text is null").count()


def content(builds, spark):
    return sorted((r.doc_name, r.page, r.slice_no, r.text) for r in builds.read(spark, "chunks").filter("active").collect())


def test_incremental_equals_cold(spark, tmp_path):
    text = lambda f, v, p: f"{f} version {v} page {p} " + "holds enough words to be a signal of its own " * 3
    batches = [[(f, 1, p, text(f, 1, p), False) for f in "abc" for p in (1, 2)], [("a", 2, 1, text("a", 2, 1), False), ("b", 2, 1, "", True)], [("d", 1, 1, text("d", 1, 1), False)]]
    keys = ["filename", "version", "page", "text", "removed"]
    warm = Builds(str(tmp_path / "warm"))
    (tmp_path / "in").mkdir()
    for i, batch in enumerate(batches):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(keys, r, strict=True))) for r in batch))
        indexer.run(spark, str(tmp_path / "in"), warm, str(tmp_path / "cp")).awaitTermination()
    final = [r for r in batches[0] if r[0] == "c"] + [batches[1][0]] + batches[2]
    cold = Builds(str(tmp_path / "cold"))
    indexer.publish_batch(cold, spark.createDataFrame(final, indexer.ARRIVAL), 0)
    assert content(warm, spark) == content(cold, spark)
    ids = [r.chunk_id for r in warm.read(spark, "chunks").collect()]
    assert len(ids) == len(set(ids)) and warm.active() == "build_000000000002"


def test_invalid_build_is_not_activated(spark, tmp_path):
    b = Builds(str(tmp_path))
    assert not b.publish(spark, "x", {"chunks": spark.createDataFrame([(True, " ")], "active boolean, text string")})
    assert b.active() is None


def test_windowed_stream(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    df.select("ts", "event_type").repartition(1).write.parquet(str(tmp_path / "e"))
    stream = indexer.windowed_counts(spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "e")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("counts").selectExpr("sum(n)").first()[0] == df.count()

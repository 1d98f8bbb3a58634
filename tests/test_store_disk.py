"""What the chunk store takes of the disk: texts lie once, nothing outlives its use, and rows come out as they went in."""

import os
import threading

from pyspark.sql import functions as F

from quillstone.operators import maintenance
from quillstone.plans import queries_store
from quillstone.sources import hadoop, scratch, segments
from quillstone.sources.scratch import new_folder, shared_root, written
from quillstone.sources.segments import Store, lean, whole
from tests.test_segments import BATCHES, add, content


def size(folder):
    total = 0
    for at, _, names in os.walk(folder):
        for n in names:
            try:
                total += os.path.getsize(f"{at}/{n}")
            except OSError:  # gone meanwhile
                pass
    return total


def test_stored_files_peak_and_leftovers(spark):
    root, data = hadoop.local(spark, shared_root(spark)), "/root/testdata/sf0.01"
    before, folders, most, done = size(root), set(os.listdir(root)), [0], threading.Event()

    def watch():
        while not done.wait(0.05):
            most[0] = max(most[0], size(root) - before)

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        assert queries_store.stored_files(spark, data).count() > 0
    finally:
        done.set()
        watcher.join()
    assert 0 < most[0] < 4 * os.path.getsize(f"{data}/documents.parquet")
    (made,) = set(os.listdir(root)) - folders
    store = Store(spark, f"{root}/{made}")
    assert made.startswith("store-") and set(os.listdir(f"{root}/{made}/segments")) == {s.id for s in store.current().segments}


def test_a_text_lies_once(spark):
    store = Store(spark, new_folder(spark, "store"))
    (made,) = add(spark, store, BATCHES[0], 0).segments
    there = spark.read.parquet(store.path(made.id, "chunks"))
    assert there.filter("text is null or coalesce(embed_text, search_text, preview) is not null").isEmpty()
    rows = store.chunks().collect()
    assert len(rows) == 8 and not [c for c in store.chunks().columns if c.startswith("__")]
    for r in rows:
        assert r.embed_text.startswith(f"DOCUMENT: {r.doc_name}\n") and r.search_text.startswith(f"DOC: {r.doc_name}\n") and r.preview == r.text[:300]
    assert store.chunks().filter("sha2(embed_text, 256) != embed_sha256 or sha2(search_text, 256) != search_sha256").isEmpty()


def test_columns_come_back_as_they_were(spark):
    odd = [None, "", "a", "text", "text ", "é\U0001f600 end", "x\n\ntext"]
    rows = spark.createDataFrame([(i, t, e, s, p) for i, t in enumerate(odd) for e in odd for s in odd for p in odd], "chunk_id long, text string, embed_text string, search_text string, preview string")
    for some in (rows, rows.select("chunk_id", "embed_text", "text"), rows.drop("text"), rows.select("chunk_id")):
        again = whole(lean(some))
        assert again.columns == some.columns
        assert again.exceptAll(some).isEmpty() and some.exceptAll(again).isEmpty()


def test_ids_by_place(spark):
    order = ["name", "page", "text"]
    rows = spark.createDataFrame([(n, p, t) for n in ("b", None, "a", "cc", "c") for p in (2, None, 1) for t in ("y", "x", None)], "name string, page long, text string")
    for parts in (1, 4, 40):
        with scratch.brief(maintenance.placed(rows.repartitionByRange(parts, "name", "page"), order)) as made:
            assert sorted(maintenance.numbered_by_place(made, 7).collect(), key=lambda r: r.chunk_id) == sorted(maintenance.numbered(rows, 7, order).collect(), key=lambda r: r.chunk_id)
            path = made.inputFiles()[0]
        assert not os.path.exists(path.removeprefix("file://"))
    assert maintenance.numbered_by_place(maintenance.placed(rows.limit(0), order), 7).isEmpty()


def test_merged_in_spans(spark, monkeypatch):
    whole_, parts = Store(spark, new_folder(spark, "whole")), Store(spark, new_folder(spark, "parts"))
    for i, batch in enumerate(BATCHES[:4]):
        add(spark, whole_, batch, i)
        add(spark, parts, batch, i)
    whole_.compact()
    monkeypatch.setattr(segments, "SPAN", 3)
    assert len(parts.merged("chunks", parts.current().segments, segments.with_retired)) == 4  # ids 1 to 12
    parts.compact()
    (a,), (b,) = whole_.current().segments, parts.current().segments
    assert (a.rows, a.retired, a.vectors, a.files) == (b.rows, b.retired, b.vectors, b.files) == (12, 0, 7, 5)
    assert content(whole_) == content(parts)
    of = lambda s: sorted((r.chunk_id, r.active, r.deactivated_at, r.embed_text) for r in s.chunks().collect())
    assert of(whole_) == of(parts) and {x[2] for x in of(parts)} == {None, 1, 3}
    assert sorted(r.chunk_id for r in parts.vectors().collect()) == sorted(x[0] for x in of(parts) if x[1])


def test_shuffle_files_go_with_their_query(spark):
    dirs = list(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString())
    held = lambda: {f for d in dirs for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}
    before, setting = held(), spark.conf.get(scratch.CLEANUP, None)
    path = new_folder(spark, "shuffled")
    written(spark.range(1000).repartition(4, "id").groupBy(F.col("id") % 7).count(), path)
    written(spark.range(1).select(F.col("id").alias("(id % 7)"), F.col("id").alias("count")), path, more=True)
    assert held() <= before and spark.conf.get(scratch.CLEANUP, None) == setting
    assert spark.read.parquet(path).count() == 8

"""The chunk store that batches add to, its generations, and the manifest as stream state."""

import json
import os
import random

import pytest

from quillstone.sources import hadoop
from quillstone.sources.scratch import new_folder
from quillstone.sources.segments import Conflict, Generation, Store
from quillstone.streaming import upkeep
from quillstone.streaming.indexer import ARRIVAL

WORDS = "holds enough words to be a signal of its own and more of them than a heading has "


def page(f, v, p):
    return f, v, p, f"{f} version {v} page {p} " + WORDS * 3, False


def gone(f, v):
    return f, v, None, None, True


def add(spark, store, rows, batch):
    return upkeep.publish(store, upkeep.batch_changes(spark.createDataFrame(rows, ARRIVAL), store.files(removed=True)), batch)


def content(store):
    return sorted((r.doc_name, r.page, r.slice_no, r.text) for r in store.chunks().filter("active").collect())


BATCHES = [
    [page(f, 1, p) for f in "abcd" for p in (1, 2)],
    [page("a", 2, 1), gone("b", 2), page("c", 1, 1), ("d", 2, 1, page("d", 1, 1)[3], False), ("d", 2, 2, page("d", 1, 2)[3], False)],
    [page("e", 1, 1), page("b", 1, 1), gone("nobody", 1)],  # a late version of a removed file, and a removal of none
    [page("a", 3, 1), page("b", 3, 1)],
    [page("f", 1, 1)],
]
FINAL = [page("a", 3, 1), page("b", 3, 1), page("c", 1, 1), page("c", 1, 2), page("d", 1, 1), page("d", 1, 2), page("e", 1, 1), page("f", 1, 1)]


def test_segments_read_together_equal_a_cold_build(spark):
    warm, cold = Store(spark, new_folder(spark, "warm")), Store(spark, new_folder(spark, "cold"))
    sizes = []
    for i, rows in enumerate(BATCHES):
        made = add(spark, warm, rows, i)
        sizes.append((made.segments[-1].rows, made.segments[-1].retired, made.segments[-1].files))
        before = content(warm)
        warm.compact()
        assert content(warm) == before
    # a batch writes what it changes: one file's rows, not the store's
    assert sizes == [(8, 0, 4), (1, 4, 2), (1, 0, 1), (2, 1, 2), (1, 0, 1)]
    add(spark, cold, FINAL, 0)
    assert content(warm) == content(cold)
    ids = [r.chunk_id for r in warm.chunks().collect()]
    assert sorted(ids) == list(range(1, 14)) and len(warm.current().segments) == 2
    live = {r.chunk_id for r in warm.chunks().filter("active").collect()}
    assert {r.chunk_id for r in warm.vectors().collect()} == live
    assert {r.filename: r.version for r in warm.files().collect()} == {"a": 3, "b": 3, "c": 1, "d": 1, "e": 1, "f": 1}
    assert {r.deactivated_at for r in warm.chunks().filter("not active").collect()} == {1, 3}


def test_replayed_batches_add_nothing(spark):
    store = Store(spark, new_folder(spark, "store"))
    for i in (0, 1):
        add(spark, store, BATCHES[i], i)
    before, number = content(store), store.current().number
    for i in (0, 1):
        add(spark, store, BATCHES[i], i)
    assert content(store) == before and store.current().number == number


def test_lost_and_torn_pointers(spark):
    store = Store(spark, new_folder(spark, "store"))
    add(spark, store, BATCHES[0], 0)
    first = content(store)
    add(spark, store, BATCHES[1], 1)
    second = content(store)
    file = hadoop.local(spark, f"{store.root}/generations/{2:012d}.json")
    text = open(file).read()
    open(file, "w").write(text[: len(text) // 2])  # a publisher died while it wrote
    assert content(store) == first
    add(spark, store, BATCHES[1], 1)
    assert content(store) == second and store.current().number == 3
    os.remove(hadoop.local(spark, f"{store.root}/generations/{3:012d}.json"))
    assert content(store) == first
    assert store.expire(keep=2) and content(store) == first  # segments that no generation names go


def test_one_of_two_publishers_wins(spark):
    root = new_folder(spark, "store")
    a, b = Store(spark, root), Store(spark, root)
    base = add(spark, a, BATCHES[0], 0)
    a.commit(base, base.segments, base.next_id)
    with pytest.raises(Conflict):
        b.commit(base, base.segments, base.next_id)
    # a publisher that loses makes its batch again, after the other one's
    tried = []

    def make(after: Generation):
        tried.append(after.number)
        if len(tried) == 1:
            add(spark, a, [page("x", 1, 1)], 7)
        made, upto = spark.createDataFrame([(after.next_id, "y", True, None)], "chunk_id long, doc_name string, active boolean, deactivated_at long"), after.next_id + 1
        return {"chunks": made}, upto

    b.publish(8, make)
    assert tried == [2, 3] and b.current().batches == {0, 7, 8}
    ids = [r.chunk_id for r in b.chunks().collect()]
    assert len(ids) == len(set(ids))
    assert not hadoop.create_new(spark, f"{root}/generations/{1:012d}.json", "") and hadoop.read_text(spark, f"{root}/none") is None


def arrive(folder, i, rows):
    keys = ["filename", "version", "page", "text", "removed"]
    with open(f"{folder}/{i}.json", "w") as f:
        f.write("\n".join(json.dumps(dict(zip(keys, r, strict=True))) for r in rows))


def test_stream_equals_batches(spark, tmp_path):
    streamed, batched = Store(spark, new_folder(spark, "streamed")), Store(spark, new_folder(spark, "batched"))
    rows = [*BATCHES[:3], [*BATCHES[1], *BATCHES[3]], BATCHES[4], BATCHES[0]]  # arrivals come again, and late
    (tmp_path / "in").mkdir()
    for i, batch in enumerate(rows):
        arrive(tmp_path / "in", i, batch)
        q = upkeep.run(spark, str(tmp_path / "in"), streamed, str(tmp_path / "cp"))
        q.awaitTermination()
        add(spark, batched, batch, i)
        assert content(streamed) == content(batched)
    cold = Store(spark, new_folder(spark, "cold"))
    add(spark, cold, FINAL, 0)
    assert content(streamed) == content(cold)
    assert {tuple(r) for r in streamed.files().collect()} == {tuple(r) for r in batched.files().collect()}


def test_steps_of_a_file():
    rng = random.Random(0)
    for _ in range(300):
        known, there, top = None, None, 0
        for _ in range(8):
            version, removed, sha = rng.randrange(1, 6), rng.random() < 0.3, rng.choice("xy")
            got = upkeep.step(known, version, removed, sha)
            want = None
            if version > top:
                want = ("removed" if there else None) if removed else "new" if there is None else "changed" if there != sha else None
                top, there = version, None if removed else sha
                known = (version, sha, removed)
            assert got == want


def test_removed_files_are_forgotten_in_time(spark, tmp_path):
    (tmp_path / "in").mkdir()
    upkeep.prepare(spark)
    seen = []
    stream = upkeep.changes(spark.readStream.schema(ARRIVAL).json(str(tmp_path / "in")), keep_removed=1)
    for i, rows in enumerate([[page("a", 5, 1)], [gone("a", 6)], [page("z", 1, 1)], [page("a", 2, 1)]]):
        arrive(tmp_path / "in", i, rows)
        q = stream.writeStream.option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, i: seen.extend((r.filename, r.version, r.status) for r in df.collect())).trigger(availableNow=True).start()
        q.awaitTermination()
        spark.sql("select java_method('java.lang.Thread', 'sleep', 1500L)").collect()
    assert seen[:3] == [("a", 5, "new"), ("a", 6, "removed"), ("z", 1, "new")]
    assert seen[3] == ("a", 2, "new")  # nothing is known of it any more


def test_digests_agree(spark):
    rows = [("a", 1, 2, "two", False), ("a", 1, 1, "one", False), ("a", 1, None, None, None), ("a", 1, 1, "one", False), (None, 1, 1, "x", False), ("b", None, 1, "x", False)]
    (r,) = upkeep.batch_changes(spark.createDataFrame(rows, ARRIVAL), None).collect()
    assert r.sha256 == upkeep.digest([(2, "two"), (1, "one"), (None, None)]) and len(r.units) == 3


def test_served_tables_join_without_an_exchange(spark):
    from pyspark.sql import functions as F

    from quillstone.plans.ask import ask

    store = Store(spark, new_folder(spark, "store"))
    for i in (0, 1):
        add(spark, store, BATCHES[i], i)
    chunks, vectors = store.serve(8)
    assert content(store) == sorted((r.doc_name, r.page, r.slice_no, r.text) for r in chunks.filter("active").collect())
    again, _ = Store(spark, store.root).serve(8)
    assert again.count() == chunks.count()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shown = lambda df: df._jdf.queryExecution().executedPlan().toString()
        live = chunks.filter("active").select("chunk_id", "doc_name", "page", "text")
        assert "Exchange" not in shown(vectors.join(live.select("chunk_id"), "chunk_id", "left_semi"))
        hits = spark.range(5).select(F.col("id").alias("query_id"), F.col("id").alias("chunk_id"))
        assert shown(hits.join(live, "chunk_id")).count("Exchange hashpartitioning") == 1  # the hits' own
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    asks = spark.createDataFrame([(1, "version of page with signal words")], "query_id long, question string")
    answers, refs = ask(asks, chunks, vectors)
    assert answers.count() == 1 and refs.count() > 0

"""What the tasks of queries over vector hits hold at a time does not grow with the vectors and the queries."""

import tracemalloc

import pytest

from quillstone.plans import catalog

NAMED = ["keyword_semantic_fusion", "page_window_expand", "context_budget", "page_marks", "page_expand_sorted", "answer_thresholds", "citation_filter", "weak_documents", "name_injection"]
#: One product of 800 queries and an Arrow batch of 10,000 vectors is 64 MB.
MOST = 48e6


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    for part, documents in (("few", 400), ("many", 40_000)):
        spark.range(0, 40_000, 1, 1).selectExpr("id as vec_id", "transform(sequence(0, 3), i -> cast(cos(id * (i + 1)) as float)) as embedding").write.parquet(f"{d}/{part}/embeddings.parquet")
        text = "case id % 8 when 0 then concat('old house stone ', id) when 1 then 'Mr Reed keeps a long road that goes to some mill far away' else 'old stone house' end"
        spark.range(0, documents, 1, 1).selectExpr("id as doc_id", f"{text} as text", "concat('src', id % 8) as source").write.parquet(f"{d}/{part}/documents.parquet")
        spark.range(0, 30, 1, 1).selectExpr("id as item_id", "concat('the old house stone ', id) as text").write.parquet(f"{d}/{part}/benchmark.parquet")
    return str(d)


@pytest.mark.parametrize("name", NAMED)
def test_a_task_holds_little(spark, tables, monkeypatch, name):
    frame, tasks = type(spark.range(1)), []
    plain = frame.mapInArrow

    def watched(self, task, *args, **kw):
        def watch(batches, most=MOST):
            tracemalloc.start()
            try:
                yield from task(batches)
                peak = tracemalloc.get_traced_memory()[1]
            finally:
                tracemalloc.stop()
            assert peak < most, f"a task of {name} held {peak / 1e6:.0f} MB"

        tasks.append(task)
        return plain(self, watch, *args, **kw)

    monkeypatch.setattr(frame, "mapInArrow", watched)
    # page_window_expand searches only vectors that have a text
    rows = catalog.QUERIES[name](spark, f"{tables}/{'many' if name == 'page_window_expand' else 'few'}").count()
    assert tasks and rows

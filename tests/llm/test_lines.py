"""Line dedup against brute force; runs, levels and joins of the index."""

import random

import pytest
from pyspark.sql import functions as F

from quillstone.llm import lines as L
from quillstone.llm._shared import new_shared_path
from tests.llm import brute

BLANK = " \t\n\x0b\f\r"


def plain(rows, least=10):
    """[(doc_id, n_lines, n_dropped, kept text)]"""
    key = lambda line: brute.lower(line.strip(BLANK))
    first = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None:
                first[key(line)] = min(i, first.get(key(line), i))
    out = []
    for i, t in rows:
        every = (t or "").split("\n")
        left = [x for x in every if i is None or len(key(x)) < least or first[key(x)] == i]
        out.append((i, len(every), len(every) - len(left), "\n".join(left)))
    return out


def texts():
    rng = random.Random(5)
    pool = [" ".join(rng.choices(["alpha", "Beta", "gamma", "éß", "日本", "x"], k=4)) for _ in range(60)]
    rows = [(i, "\n".join(rng.choice([" ", "", "\t", "\x0b"]) + rng.choice([str.upper, str.lower, str])(rng.choice(pool)) for _ in range(rng.randrange(12)))) for i in range(80)]
    rows += [(80, None), (81, ""), (82, "\n\n"), (83, "short\nshort"), (84, "same line here\nsame line here\n"), (85, "Same Line Here"), (86, "İstanbul line"), (87, "i̇stanbul line"), (88, "ÉCOLE ÉCOLE"), (89, "école école")]
    rows += [(5, "Same Line Here\nonly in five, twice"), (5, "only in five, twice"), (None, "same line here"), (None, "same line here"), (None, None), (-3, "SAME LINE HERE"), (90, "\n".join(f"line number {i % 7000}" for i in range(20_000))), (91, "line number 12\nline number 9999")]
    return rows


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_lines", "n_dropped", "kept_text").collect()), key=repr)


@pytest.mark.parametrize("batches,fanout", [(1, 2), (4, 3), (9, 2)])
def test_lines(spark, monkeypatch, batches, fanout):
    monkeypatch.setattr(L.LineRuns.__init__, "__defaults__", (fanout,))
    docs = spark.createDataFrame(texts(), "doc_id long, text string").repartition(3)
    assert got(L.without_repeated_lines(docs, batches)) == sorted(plain(texts()), key=repr)


def test_clashing_columns_pass(spark):
    rows = [(1, "a line of text", 7, "k", "b", 3), (2, "a line of text", 8, "m", "c", 4)]
    made = L.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string, n_lines int, kept_text string, batch string, pos int"))
    assert sorted(map(tuple, made.collect())) == [(1, "a line of text", 7, "k", "b", 3, 1, 0, "a line of text"), (2, "a line of text", 8, "m", "c", 4, 1, 1, "")]
    assert made.columns == ["doc_id", "text", "n_lines_given", "kept_text_given", "batch", "pos", "n_lines", "n_dropped", "kept_text"]


def test_no_rows(spark):
    assert L.without_repeated_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_runs_stay_unique_and_survive_sessions(spark):
    docs = spark.createDataFrame(texts(), "doc_id long, text string").filter("doc_id is not null")
    keys = L.line_keys(docs).persist()
    root = new_shared_path(spark, "line-runs")
    index = L.LineRuns(spark, root, 8, fanout=2)
    for i in range(5):
        index.add(keys.filter(F.pmod("doc_id", F.lit(7)) == i))
    assert [len(x) for x in index.levels] == [1, 0, 1]  # five batches: 4 + 1
    state = index.state
    index.close()
    index = L.LineRuns.opened(spark, root, 8, state, fanout=2)
    for i in (5, 6):
        index.add(keys.filter(F.pmod("doc_id", F.lit(7)) == i))
    held = [tuple(r) for run in index.runs() for r in run.select(*L.KEY).collect()]
    assert len(held) == len(set(held)) == keys.select(*L.KEY).distinct().count()
    # the batch meets the runs as they lie: one exchange, that of its own keys
    own = keys.groupBy(*L.KEY).agg(F.min("doc_id"))
    with L.settings(spark, {"spark.sql.shuffle.partitions": "8", "spark.sql.legacy.bucketedTableScan.outputOrdering": "true"}):
        for run in index.runs():
            own = own.join(run.hint("merge"), L.KEY, "left_anti")
        plan = own._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in plan and "Python" not in plan
    index.close()

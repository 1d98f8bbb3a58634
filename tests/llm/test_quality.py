"""Statistics against a brute-force count; the learned list on planted junk; odd rows."""

import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
texts = st.lists(st.sampled_from(["a", "b", "c", " ", "\n", "\t", "é", "#", "|", "a b c d e ", "\na b\n", "日", "\x00", "\x0b", "9", "Z.", "\xa0"]), max_size=40).map("".join)


def brute(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {j for i, r in enumerate(runs) if runs.count(r) > 1 for j in range(i, i + 5)}
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines), "n_distinct_words": len(set(words)), "n_echoes": sum(a == b for a, b in zip(words, words[1:]))}


@settings(max_examples=200, deadline=None)
@given(st.lists(texts, max_size=6))
def test_stats_match_brute_force(batch):
    got = quality.text_stats([t.encode() for t in batch])
    for i, t in enumerate(batch):
        assert {k: int(got[k][i]) for k in brute(t)} == brute(t)


def test_learned_list_finds_a_planted_conjunction():
    rng = np.random.default_rng(5)
    x = {"a": rng.random(3000), "b": rng.random(3000)}
    bad = (x["a"] > 0.7) & (x["b"] <= 0.4)
    rules = quality.learn_decision_list(x, bad)
    got = np.any([r.covers(x) for r in rules], axis=0)
    assert rules and (got & bad).sum() > 0.9 * bad.sum() and (got & ~bad).sum() < 0.03 * bad.sum()


def test_no_labels_keeps_all_but_base_failures(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, " ".join(f"w{i}" for i in range(12))), (3, " ".join(f"w{i}" for i in range(12))), (None, "a b c d e " * 9)]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as quality", "'k' as kept").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = sorted([(str(r.doc_id), r.n_words, r.base_failed, r.kept) for r in quality.op8_quality(spark, str(tmp_path)).collect()])
    assert got == [("1", 0, True, False), ("2", 0, True, False), ("3", 12, False, True), ("3", 12, False, True), ("None", 45, True, False)]


def junk_table(spark, folder, n=900):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        bad = i % 3 == 0
        words = [("#" * rng.randrange(3, 9) if bad and rng.random() < 0.6 else "word%d" % rng.randrange(5000)) for _ in range(rng.randrange(20, 60))]
        rows.append((i, " ".join(words), "k"))
        if i % 2 == 0:
            labels.append((i, int(not bad)))
    rows += [(0, "again # # # and something else for the id that repeats here", "k")] * 50 + [(None, "no id but quite a few words in this text of good words", "k"), (n, "longword " * 40_000 + "end", "k")]
    labels += [(0, 0), (2, None), (None, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, kept string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_verdicts_by_brute_force(spark, tmp_path):
    """kept of every row, from the rules applied one by one in plain Python."""
    rows = junk_table(spark, str(tmp_path))
    docs, labels = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels"))
    rules = quality.fit_rules(docs, labels)
    assert rules

    def kept(text):
        got = {k: int(v[0]) for k, v in quality.text_stats([text.encode()]).items()}
        if got["n_words"] < 10 or 100 * got["n_repeat_words"] > 20 * got["n_words"]:
            return False
        share = lambda a, b: got[a] / max(got[b], 1)
        x = {"n_words": got["n_words"], "word_length": share("word_chars", "n_words"), "symbol_share": share("n_symbols", "word_chars"), "dup_line_share": share("n_dup_lines", "n_lines"), "repeat_share": share("n_repeat_words", "n_words"), "distinct_share": share("n_distinct_words", "n_words"), "echo_share": share("n_echoes", "n_words"), "digit_share": share("n_digits", "word_chars"), "upper_share": share("n_upper", "word_chars"), "line_words": share("n_words", "n_lines"), "stops_per_word": share("n_stops", "n_words")}
        for r in rules:
            if all(x[f] <= t if op == "<=" else x[f] > t for f, op, t in r.conditions):
                return False
        return True

    got = sorted((repr(r.doc_id), r.n_words, r.kept) for r in quality.op8_quality(spark, str(tmp_path)).collect())
    assert got == sorted((repr(i), len(WORD.findall(t)), kept(t)) for i, t, _ in rows)
    assert 50 < sum(not k for *_, k in got) < 700


def test_sample_is_bounded_and_ids_count_once(spark, tmp_path, monkeypatch):
    junk_table(spark, str(tmp_path))
    docs, labels = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels"))
    held = []
    monkeypatch.setattr(quality, "learn_decision_list", lambda x, bad: held.append(len(bad)) or [])
    quality.fit_rules(docs, labels, most=100)
    quality.fit_rules(docs, labels)
    assert held == [100, 450]


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert quality.op8_quality(spark, str(tmp_path)).collect() == []

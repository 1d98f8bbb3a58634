"""Jobs done whole: results that a cut would lose."""

import corpus_pipeline as P
from quillstone.llm import langid, neardup


def made(i: int, words: str, lang: str):
    return i, " ".join(words.split() * 6), lang


def test_every_language_is_learned(spark):
    code = lambda i: f"{chr(97 + i // 11)}{chr(97 + i % 11)}"
    rows = [(10 * i + k, f"{code(i) * 3} {code(i)}{code(k)} {code(i) * 2}", f"x-{code(i)}") for i in range(110) for k in range(2 + (i < 100))]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2))
    assert set(model.langs) == {r[2] for r in rows}


def test_total_sample_is_divided(spark, monkeypatch):
    rows = [(i, f"word {i} here", f"x-{i % 10}") for i in range(2000)]
    held = []
    monkeypatch.setattr(langid, "svm", lambda x, y: held.append(len(x)) or (x[0], 0.0, 1.0))
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_rows=500)
    assert len(model.langs) == 10 and all(400 < n < 600 for n in held)


def test_language_not_learned_is_kept(spark, monkeypatch):
    rows = [made(i, f"the thing and the other with {i}", "en") for i in range(20)] + [made(100 + i, f"les eaux dans une ville pour {i}", "fr") for i in range(20)]
    rows += [made(200, "the thing and the other with", "x-new"), made(201, "les eaux dans une ville pour", "en")]
    whole = langid.fit
    monkeypatch.setattr(langid, "fit", lambda docs: whole(docs.filter("doc_id < 200")))
    kept = {r.doc_id for r in P.language(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "").collect()}
    assert 200 in kept and 201 not in kept


def test_texts_of_one_id_and_of_none_are_documents(spark):
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcde")
    rows = [(1, a), (1, b), (1, a + " end"), (2, a), (3, b), (4, e), (4, e), (None, c), (None, c), (None, c + " end"), (None, d), (None, e), (None, ""), (None, "")]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, at int").repartition(3)
    kept = neardup.deduplicate(docs)
    assert kept.columns == docs.columns
    groups = sorted(r.text.removesuffix(" end") for r in kept.collect())
    assert groups == ["", "", a, b, c, d, e]
    assert {r.doc_id for r in kept.collect() if r.text in (c, c + " end", d)} == {None}

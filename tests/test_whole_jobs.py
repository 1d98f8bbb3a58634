"""Jobs done whole: results that a cut would lose."""

from quillstone.plans import queries


def test_lexical_fallback_counts_over_all_tokens(spark, monkeypatch):
    texts = [(1, "d", 0, "Alpha and beta"), (2, "d", 0, "alpha only"), (3, "d", 0, "beta kappa sigma"), (4, "e", 0, "alpha beta gamma delta kappa lambda sigma omega")]
    asks = [(7, "?", ["alpha", "beta", "gamma", "delta", "kappa", "lambda", "sigma", "omega"])]
    monkeypatch.setattr(queries, "units", lambda s, d: spark.createDataFrame(texts, "chunk_id long, doc_name string, page long, text string"))
    monkeypatch.setattr(queries, "tokens", lambda s, d: spark.createDataFrame(asks, "query_id long, question string, toks array<string>"))
    got = {r.chunk_id: r.score for r in queries.lexical_fallback(spark, "").collect()}
    assert got == {1: 0.5, 3: 0.55, 4: 0.68}

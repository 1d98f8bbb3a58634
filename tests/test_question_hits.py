"""Vectors that stand for no question are not searched for; the questions' hits are the same."""

from quillstone.operators import vectors
from quillstone.plans import queries


def test_only_vectors_that_stand_for_a_question_are_searched_for(spark, tmp_path, monkeypatch):
    spark.range(1000).selectExpr("id as vec_id", "array(cast(cos(id) as float), cast(sin(id) as float)) as embedding").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(0, "a"), (3, "b"), (23, "c"), (5, "d")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    searched, top_k = [], vectors.top_k

    def seen(v, q, *args, **kw):
        searched.extend(r.query_id for r in q.select("query_id").collect())
        return top_k(v, q, *args, **kw)

    monkeypatch.setattr(vectors, "top_k", seen)
    got = {(r.query_id, r.chunk_id, r.score) for r in queries.question_hits(spark, str(tmp_path), 4).collect()}
    # 20 vectors are divisible by 50: questions 3 and 23 share one
    assert sorted(searched) == [0, 150, 250]
    every = [(r.query_id, r.vec_id, r.score) for r in queries.hits(spark, str(tmp_path), 4).collect()]
    assert got == {(q, v, s) for q, vec in ((0, 0), (3, 150), (23, 150), (5, 250)) for w, v, s in every if w == vec} and len(got) == 16

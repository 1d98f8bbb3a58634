"""The semantic route with the questions' own vectors: SQL cannot state the embedder, so the test compares a plain version."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.config import CONFIG as C
from quillstone.functions.embed import embedded
from quillstone.operators import vectors
from quillstone.plans.queries import asked, query, read
from quillstone.sources.scratch import kept, spread

#: More characters than a text has: whole texts are embedded.
WHOLE = 2**31 - 1


@query()
def semantic_route(spark, d):
    """(query_id, chunk_id, score): for every question the chunks whose text is most like it, by vectors of both. Null texts embed as empty, and are like nothing."""
    texts = spread(read(spark, d, "documents").select("doc_id", "text"))
    v = kept(texts.select(F.col("doc_id").alias("vec_id"), embedded(F.col("text"), most_chars=WHOLE).alias("embedding")))
    # ids of queries and chunks are apart: a query is never its own hit
    q = asked(spark, d).select((-F.col("query_id") - 1).alias("query_id"), embedded(F.col("question"), most_chars=WHOLE).alias("embedding"))
    found = vectors.top_k(v, q, C.top_k, C.similarity, C.query_block)
    return found.select((-F.col("query_id") - 1).alias("query_id"), F.col("vec_id").alias("chunk_id"), "score")

"""Hybrid retrieval: keyword scan, neighbouring pages, fusion, gates and ranks. Queries are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import keywords
from quillstone.operators import spelling as spell
from quillstone.sources.scratch import if_small


def keyword_scan(units: DataFrame, queries: DataFrame, block: int = 5_000, least: int | None = None) -> DataFrame:
    """Every hit: see ``keywords.scan``."""
    return keywords.scan(units, queries, block, least)


def ranked(hits: DataFrame, per: tuple[str, ...], *order) -> DataFrame:
    return hits.withColumn("rn", F.row_number().over(W.partitionBy(*per).orderBy(*order)))


def page_window(hits: DataFrame, units: DataFrame, radius: int, score: float) -> DataFrame:
    """(query_id, chunk_id, score): chunks of the same document within ``radius`` pages of a hit that are no hits themselves.

    The range becomes an equi-join: each hit names its 2 * radius neighbouring pages.
    """
    at = hits.join(units.select("chunk_id", "doc_name", "page"), "chunk_id")
    wanted = at.select("query_id", "doc_name", F.explode(F.sequence(F.col("page") - radius, F.col("page") + radius)).alias("near"), "page").filter("near <> page")
    wanted = wanted.select("query_id", "doc_name", F.col("near").alias("page")).distinct()
    found = wanted.join(units.select("chunk_id", "doc_name", "page"), ["doc_name", "page"])
    return found.join(hits.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti").select("query_id", "chunk_id", F.lit(score).alias("score")).distinct()


def fused(keyword: DataFrame, semantic: DataFrame, weight: float, k: int) -> DataFrame:
    """Keyword hits, raised by a share of the semantic score where there is one; the k best per query."""
    s = semantic.select("query_id", "chunk_id", F.col("score").alias("sem"))
    both = keyword.join(s, ["query_id", "chunk_id"], "left").select("query_id", "chunk_id", F.round(F.col("score") + F.coalesce(weight * F.col("sem"), F.lit(0.0)), 6).alias("score"))
    return ranked(both, ("query_id",), F.desc("score"), "chunk_id").filter(F.col("rn") <= k).drop("rn")


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of two routes with the better score."""
    return a.select("query_id", "chunk_id", "score").unionByName(b.select("query_id", "chunk_id", "score")).groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))


def by_document(hits: DataFrame) -> DataFrame:
    """(query_id, doc_name, n_hits, max_score, hits, doc_rank): grouped and ordered by the best score that is not context."""
    g = hits.groupBy("query_id", "doc_name").agg(F.count(F.lit(1)).alias("n_hits"), F.max(F.when(~F.col("is_context"), F.col("score"))).alias("best"), F.max("score").alias("any"), F.min("chunk_id").alias("first"), F.sort_array(F.collect_list("chunk_id")).alias("chunks"))
    g = g.withColumn("max_score", F.coalesce("best", "any"))
    return ranked(g, ("query_id",), F.desc("max_score"), "first").select("query_id", "doc_name", "n_hits", "max_score", F.array_join(F.transform("chunks", lambda c: c.cast("string")), ",").alias("chunks"), F.col("rn").cast("long").alias("doc_rank"))


def injected(hits: DataFrame, asks: DataFrame, units: DataFrame, marks: list[str], score: float, most: int | None = None) -> DataFrame:
    """(query_id, chunk_id, score): for queries that ask and have no hit with all marks, the chunks that have them.

    ``most`` keeps the first ones by id, where only so many are wanted.
    """
    marked = units.select("chunk_id", "text")
    for m in marks:
        marked = marked.filter(F.contains("text", F.lit(m)))
    return given(hits, asks, marked.select("chunk_id"), score, most)


def given(hits: DataFrame, asks: DataFrame, marked: DataFrame, score: float, most: int | None = None) -> DataFrame:
    """(query_id, chunk_id, score): the ``marked`` chunks for the queries of ``asks`` that have none of them among their hits."""
    has = hits.join(marked, "chunk_id", "left_semi").select("query_id").distinct()
    need = asks.select("query_id").join(has, "query_id", "left_anti")
    chosen = marked if most is None else marked.orderBy("chunk_id").limit(most)
    # every query takes every marked chunk: the result has that many rows by definition
    return chosen.join(if_small(need)).select("query_id", "chunk_id", F.lit(score).alias("score"))


def with_overlap(hits: DataFrame, keys: DataFrame, units: DataFrame, stop: list[str], short: list[str]) -> DataFrame:
    """Hits with what else ``units`` holds and ``overlap``: how many of the question's keywords are tokens of the text. Only texts of hits are tokenised."""
    wanted = hits.select("chunk_id").distinct()
    texts = units.join(wanted, "chunk_id", "left_semi").withColumn("__toks", T.overlap_tokens(F.col("text"), stop, short)).drop("text")
    near = hits.join(if_small(keys), "query_id").join(texts, "chunk_id")
    return near.withColumn("overlap", F.size(F.array_intersect("keys", "__toks")).cast("long")).drop("keys", "__toks")


def criteria_first(hits: DataFrame, lead: int = 2) -> DataFrame:
    """(query_id, doc_name, doc_rank): the ``lead`` documents with most phrases and overlap come first, the others stay in the order of their best score."""
    g = hits.groupBy("query_id", "doc_name").agg(F.max("blend").alias("score"), F.sum("overlap").alias("overlap"), F.sum("phrases").alias("phrases"))
    every = W.partitionBy("query_id")
    s = g.withColumn("signal", F.round(10 * F.col("phrases") + 1.5 * F.col("overlap") + F.col("score"), 6)).withColumn("base", F.row_number().over(every.orderBy(F.desc("score"), "doc_name")))
    led = s.withColumn("lead", F.row_number().over(every.orderBy(F.desc("signal"), "doc_name")) <= lead)
    key = F.when(F.col("lead"), -F.col("signal")).otherwise(F.col("base").cast("double"))
    return ranked(led, ("query_id",), F.desc("lead"), key, "doc_name").select("query_id", "doc_name", F.col("rn").cast("long").alias("doc_rank"))


def spelling(vocabulary: DataFrame, queries: DataFrame, distance: int = 2, most: int = 3, index: DataFrame | None = None) -> DataFrame:
    """(tok, word, dist): the nearest known words of each question token of letters. ``index``: the vocabulary's deletion keys, if they are kept."""
    index = spell.keyed(vocabulary, "word", distance) if index is None else index
    return spell.neighbours(index, queries.select(F.explode("toks").alias("tok")), distance, most)


def corrected(questions: DataFrame, vocabulary: DataFrame, stop: list[str], short: list[str], distance: int = 2, most_fixes: int = 2, most_words: int = 24, index: DataFrame | None = None) -> DataFrame:
    """(query_id, corrected) of the questions that spelling changes: unknown words become the nearest known one.

    Words of fewer than four letters, numbers and stop words stay; so do words known as they are or by their stem. Nearest
    is least distance, then first by letters. The first ``most_fixes`` words that can be fixed are; questions of more than
    ``most_words`` words are left alone, as are null and empty ones.
    """
    ws = questions.select("query_id", T.words_of(T.normal_text(F.col("question"))).alias("ws")).filter(F.size("ws") <= most_words)
    each = ws.select("query_id", F.posexplode("ws").alias("pos", "tok"))
    open_ = (F.length("tok") >= 4) & ~F.rlike("tok", F.lit("^[0-9]+$")) & ~F.col("tok").isin(stop) & ~F.col("tok").isin(short)
    toks = each.filter(open_).select("tok").distinct()
    known = vocabulary.select("word").distinct()
    strange = toks.join(known, F.col("tok") == F.col("word"), "left_anti").join(known, T.stem(F.col("tok")) == F.col("word"), "left_anti")
    best = spelling(vocabulary, strange.select(F.array("tok").alias("toks")), distance, 1, index).select("tok", F.col("word").alias("fix"))
    fixable = each.join(best, "tok", "left").withColumn("n_fix", F.count("fix").over(W.partitionBy("query_id").orderBy("pos")))
    word = F.when(F.col("n_fix") <= most_fixes, F.coalesce("fix", "tok")).otherwise(F.col("tok"))
    made = fixable.groupBy("query_id").agg(F.max("n_fix").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", word.alias("w")))), lambda x: x["w"]), " ").alias("corrected"))
    return made.filter("n > 0").select("query_id", "corrected")


def blended(hits: DataFrame, weight: float, cap: int) -> DataFrame:
    """Adds blend: semantic score and capped overlap."""
    return hits.withColumn("blend", F.round(weight * F.col("score") + (1 - weight) * F.least(F.col("overlap"), F.lit(cap)) / F.lit(cap), 8))


def soft_gate(hits: DataFrame, per_doc: int, score: float, soft: float) -> DataFrame:
    """The best of each document, and any hit with score or overlap to speak for it."""
    r = ranked(hits, ("query_id", "doc_name"), F.desc("blend"), "chunk_id")
    return r.filter((F.col("rn") <= per_doc) | (F.col("score") >= score) | (F.col("score") >= soft) | (F.col("overlap") >= 1)).drop("rn")


def relative_keep(docs: DataFrame, share: float, most: int) -> DataFrame:
    """Documents of at least ``share`` of the best score, at most ``most`` per query, with the primary one named."""
    every = W.partitionBy("query_id")
    rn = F.row_number().over(every.orderBy(F.desc("score"), "doc_name"))
    r = docs.withColumns({"rn": rn, "top": F.max("score").over(every), "primary_doc": F.first("doc_name").over(every.orderBy(F.desc("score"), "doc_name"))})
    return r.filter((F.col("score") >= share * F.col("top")) & (F.col("rn") <= most)).select("query_id", "doc_name", "score", "primary_doc", F.col("rn").cast("long").alias("doc_rank"))


def within_budget(chunks: DataFrame, per: str, order: list, size: str, budget: int, most: int) -> DataFrame:
    """The longest prefix of at most ``most`` chunks whose sizes sum to at most ``budget``."""
    w = W.partitionBy(per).orderBy(*order)
    r = chunks.withColumns({"rn": F.row_number().over(w), "upto": F.sum(size).over(w.rowsBetween(W.unboundedPreceding, 0))})
    return r.filter((F.col("rn") <= most) & (F.col("upto") <= budget))

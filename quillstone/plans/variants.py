"""Retrieval over several wordings of a question, as one plan over a batch of questions.

Wordings are searched together; the best score of each chunk counts. Where vectors find too
little, words do. Hits are reranked by real overlap, gated, capped by document, widened to
neighbouring pages, and put in the order of their documents.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone import lexicon
from quillstone.config import CONFIG, Config
from quillstone.functions import text as T
from quillstone.functions.embed import Embedder, embedded, hashed_ngrams
from quillstone.operators import filenames, gates, keywords, postings, retrieval, vectors
from quillstone.sources.scratch import kept


def intent_terms(question: Column) -> Column:
    """The terms that a question's intents add, in the order of lexicon.INTENTS, joined by spaces."""
    found = [F.when(T.has_word(question, p), F.lit(extra)) for _, p, extra in lexicon.INTENTS]
    return F.array_join(F.array_compact(F.array(*found)), " ")


def swapped_title(question: Column) -> Column:
    """The two words of a two-word question the other way round, else null."""
    w = T.overlap_tokens(question, lexicon.OVERLAP_STOP, lexicon.KEEP_SHORT)
    return F.when(F.size(w) == 2, F.concat_ws(" ", w[1], w[0]))


def wordings(questions: DataFrame, most: int, replies: DataFrame | None = None, most_in_all: int | None = None) -> DataFrame:
    """(query_id, no, wording): the question, its expansion, its title swapped, its intents' terms added, and what rules make of it; distinct without regard to case, at most ``most``.

    ``replies`` (query_id, reply) of a model that words questions anew add theirs, up to ``most_in_all``; one that failed adds nothing.
    """
    q = F.col("question")
    wide = T.schedule_number(T.expand_words(T.fix_words(q, lexicon.TYPOS), lexicon.ABBREVIATIONS), lexicon.ROMAN)
    terms = intent_terms(q)
    made = F.concat(F.array_compact(F.array(q, wide, swapped_title(q), F.when(terms != "", F.concat(wide, F.lit(" "), terms)))), gates.rule_wordings(q))
    own = distinct_wordings(questions.select("query_id", F.posexplode(made).alias("at", "wording")), most)
    if replies is None:
        return own
    anew = replies.select("query_id", F.posexplode(gates.rewrites(F.col("reply"))).alias("at", "wording")).withColumn("at", F.col("at") + most + 1)
    return distinct_wordings(own.withColumnRenamed("no", "at").unionByName(anew), most_in_all or most)


def distinct_wordings(v: DataFrame, most: int) -> DataFrame:
    """(query_id, no, wording) of (query_id, at, wording): the first of those that differ in case only, in order."""
    first = retrieval.ranked(v.withColumn("__k", F.lower(F.trim("wording"))), ("query_id", "__k"), "at").filter("rn = 1").drop("rn", "__k")
    return retrieval.ranked(first, ("query_id",), "at").filter(F.col("rn") <= most).select("query_id", F.col("rn").alias("no"), "wording")


def retrieve(questions: DataFrame, chunks: DataFrame, chunk_vectors: DataFrame, embedder: Embedder = hashed_ngrams, config: Config = CONFIG, index: DataFrame | None = None, replies: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_rank, doc_name, page, chunk_id, score, blend, is_context) of (query_id, question), best documents first. ``replies``: see ``wordings``. ``index``: posting lists of the chunks, so that only candidates are read. ``files`` (name): those that are still there; documents without a file are left out at the end."""
    live = chunks.filter("active").select("chunk_id", "doc_name", "page", "text")
    worded = wordings(questions, config.max_variants, replies, config.max_queries).withColumn("__v", -(F.col("query_id") * config.max_queries + F.col("no")) - 1)
    q = worded.select(F.col("__v").alias("query_id"), embedded(F.col("wording"), embedder).alias("embedding"))
    v = chunk_vectors.join(live.select("chunk_id"), "chunk_id", "left_semi").select(F.col("chunk_id").alias("vec_id"), "embedding")
    found = vectors.top_k(v, q, config.top_k, config.fallback_similarity, config.query_block).withColumnRenamed("query_id", "__v")
    best = kept(vectors.best_of_variants(found.join(retrieval.if_small(worded.select("query_id", "__v")), "__v")))
    semantic = vectors.thresholded(best, config.variant_similarity, config.fallback_similarity, config.fallback_hits).withColumnRenamed("vec_id", "chunk_id")
    tokens = questions.select("query_id", T.query_words(F.col("question"), lexicon.QUERY_STOP).alias("toks"))
    find = keywords.scan if index is None else partial(postings.search, index)
    intended = gates.by_intent(questions, live, per_doc=config.fallback_per_doc, most=config.fallback_most, block=config.query_block)
    merged = kept(retrieval.merged(retrieval.merged(semantic, intended), keywords.lexical(live, tokens, config.fallback_per_doc, config.fallback_most, config.query_block, find)))
    terms = [p for phrases in lexicon.PHRASES.values() for p in phrases]
    has = sum((F.contains(F.lower("text"), F.lit(p)).cast("int") for p in terms), F.lit(0))
    written = lambda c: T.expanded_text(F.col(c), lexicon.SHORT_FORMS, lexicon.OWN_MISSPELLINGS)
    keys = questions.select("query_id", T.keywords(written("question"), lexicon.OVERLAP_STOP, lexicon.KEEP_SHORT, 12).alias("keys"))
    marked = retrieval.with_overlap(merged, keys, live.withColumn("phrases", has).withColumn("text", written("text")), lexicon.OVERLAP_STOP, lexicon.KEEP_SHORT)
    ranked = retrieval.blended(marked, config.semantic_weight, config.overlap_cap)
    gated = gates.gated(ranked, questions, config.gate_per_doc, config.gate_score, config.gate_soft)
    capped = retrieval.ranked(gated, ("query_id", "doc_name"), F.desc("blend"), "chunk_id").filter(F.col("rn") <= config.hits_per_doc).drop("rn")
    capped = kept(capped)
    first = gates.kept_documents(capped, config.gate_score, config.relative_keep, config.max_docs)
    if files is not None:
        first = filenames.existing(first, files)
    order = retrieval.criteria_first(capped.join(first.select("query_id", "doc_name"), ["query_id", "doc_name"], "left_semi"))
    order = kept(order)
    direct = capped.join(order, ["query_id", "doc_name"]).select("query_id", "doc_rank", "doc_name", "page", "chunk_id", "score", "blend", F.lit(False).alias("is_context"))
    near = gates.context_pages(direct, questions, live, wide=config.neighbour_radius).join(live.select("chunk_id", "doc_name", "page"), "chunk_id")
    wide = near.join(order, ["query_id", "doc_name"]).select("query_id", "doc_rank", "doc_name", "page", "chunk_id", "score", F.lit(0.0).alias("blend"), F.lit(True).alias("is_context"))
    return direct.unionByName(wide)

"""Questions in, grounded answers out: the whole path as one plan over a batch of questions.

Routing and rewriting come first, so that greetings never reach the joins; candidates come
from vectors, keywords and neighbouring pages; texts join last, within the budget.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone import lexicon
from quillstone.config import CONFIG, Config
from quillstone.functions import text as T
from quillstone.functions.embed import Embedder, embedded, hashed_ngrams
from quillstone.operators import answers, keywords, postings, references, replies, retrieval, vectors
from quillstone.sources.scratch import kept


#: Replies that need no evidence, by ``answers.canned_intent``. Give your own.
CANNED = {"greeting": "Hello! What would you like to know?", "identity": "I answer questions about the documents of this collection.", "creator": "I answer questions about the documents of this collection."}
#: question, last question and last answer to a standalone question; null where it fails.
Rewrite = Callable[[Column, Column, Column], Column]


def last_pairs(turns: DataFrame, config: Config = CONFIG) -> DataFrame:
    """(query_id, last_question, last_answer) of (query_id, turn, role, text): from the usable history only, the answer without marks and cut to what a rewriter is shown."""
    usable = answers.usable_history(turns.withColumnRenamed("query_id", "conv_id"), lexicon.REFUSALS, config.history_turns)
    said = lambda role: F.max_by(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.col("turn")))
    pairs = usable.groupBy(F.col("conv_id").alias("query_id")).agg(said("user").alias("last_question"), said("assistant").alias("last_answer"))
    bare = T.stripped(F.regexp_replace(F.regexp_replace(F.coalesce("last_answer", F.lit("")), r"\*\*|\[\d+\]", ""), r"(?m)^[-•]\s*", ""))
    return pairs.withColumn("last_answer", F.left(bare, F.lit(config.rewrite_chars)))


def followed_up(question: Column, last_question: Column, last_answer: Column) -> Column:
    """The default rewriter: a question that points back takes the words of the last one along."""
    back = F.rlike(F.lower(question), F.lit("(^|[^a-z])(it|its|they|them|their|this|that|these|those|he|she|his|her|uska|unka|iska)($|[^a-z])"))
    return F.when(back, F.concat(question, F.lit(" "), last_question)).otherwise(question)


def prepared(questions: DataFrame, rewrite: Rewrite | None = None, history: DataFrame | None = None, config: Config = CONFIG, vocabulary: DataFrame | None = None) -> DataFrame:
    """(query_id, question) with route, language, canned intent, reply to a greeting at the start, the corrected and expanded question and its keyword tokens.

    With a ``vocabulary`` (word, n), words that it does not know become the nearest one that it does.

    With ``history`` (query_id, turn, role, text), follow-up questions are rewritten and those about pay name its table;
    thanks are left alone, and so is a question whose rewriting fails.
    """
    split = questions.withColumn("__g", answers.greeting_split(F.col("question"), lexicon.GREETINGS))
    fixed = T.fix_words(F.col("__g.rest"), lexicon.TYPOS)
    if history is not None:
        split = split.join(last_pairs(history, config), "query_id", "left")
        thanks = (F.length("question") < 4) | F.lower("question").isin("ok", "thanks", "theek", "sahi")
        made = replies.with_pay_terms(F.coalesce((rewrite or followed_up)(fixed, F.col("last_question"), F.col("last_answer")), fixed))
        fixed = F.when(F.col("last_question").isNull() | thanks, fixed).otherwise(made)
    asked = T.schedule_number(T.expand_words(fixed, lexicon.ABBREVIATIONS), lexicon.ROMAN)
    known = F.lit(False) if history is None else F.col("last_question").isNotNull()
    canned = answers.canned_intent(F.col("question"), known)
    named = split.select("query_id", "question", F.col("__g.decision").alias("route"), answers.language(F.col("question")).alias("language"), canned.alias("canned"), answers.acknowledged(F.col("question"))["ack"].alias("ack"), asked.alias("asked"))
    if vocabulary is not None:
        fixes = retrieval.corrected(named.select("query_id", F.col("asked").alias("question")), vocabulary, lexicon.OVERLAP_STOP, lexicon.KEEP_SHORT)
        named = named.join(retrieval.if_small(fixes), "query_id", "left").withColumn("asked", F.coalesce("corrected", "asked")).drop("corrected")
    return named.withColumn("toks", T.query_words(F.col("asked"), lexicon.QUERY_STOP))


def injected(asked: DataFrame, hits: DataFrame, live: DataFrame, config: Config) -> DataFrame:
    """(query_id, chunk_id, score): chunks that rules call for, and chunks that name a person where a question wants a name and no hit has one."""
    parts = [retrieval.injected(hits, asked.filter(answers.any_of(F.lower("question"), words)), live, marks, config.keyword_floor) for words, marks in lexicon.RULES]
    person = live.filter(F.rlike("text", F.lit(lexicon.PERSON)) & (F.length("text") > 50)).select("chunk_id")
    wants = asked.filter(F.rlike(F.lower("question"), F.lit(lexicon.NAME_WORDS)))
    out = retrieval.given(hits, wants, person, config.name_score, config.named_chunks)
    for p in parts:
        out = out.unionByName(p)
    return out.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))


def evidence(questions: DataFrame, chunks: DataFrame, chunk_vectors: DataFrame, embedder: Embedder = hashed_ngrams, config: Config = CONFIG, index: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, score, is_context) for prepared questions; only active chunks take part. ``index``: posting lists of the chunks, so that only candidates are read."""
    live = chunks.filter("active").select("chunk_id", "doc_name", "page", "text")
    real = questions.filter("route <> 'A' and canned is null")
    v = chunk_vectors.join(live.select("chunk_id"), "chunk_id", "left_semi").select(F.col("chunk_id").alias("vec_id"), "embedding")
    q = real.select("query_id", embedded(F.col("asked"), embedder).alias("embedding"))
    # ids of queries and chunks are apart: a query is never its own hit
    shifted = q.withColumn("query_id", -F.col("query_id") - 1)
    semantic = vectors.top_k(v, shifted, config.top_k, config.similarity, config.query_block).select((-F.col("query_id") - 1).alias("query_id"), F.col("vec_id").alias("chunk_id"), "score")
    semantic = kept(semantic)
    find = keywords.scan if index is None else partial(postings.search, index)
    keyword = keywords.fused(live, real, semantic, config.fusion_weight, config.keyword_hits, config.query_block, find)
    direct = kept(retrieval.merged(semantic, keyword))
    wide = real.filter(answers.any_of(F.lower("question"), lexicon.EXPANSION_TRIGGERS)).select("query_id")
    first = retrieval.ranked(direct, ("query_id",), F.desc("score"), "chunk_id").filter(F.col("rn") <= config.expanded_hits).drop("rn")
    near = retrieval.page_window(first.join(wide, "query_id", "left_semi"), live, config.page_radius, config.similarity)
    added = injected(real, direct, live, config).join(direct.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    direct = kept(direct.unionByName(added))
    near = near.join(direct.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    return direct.withColumn("is_context", F.lit(False)).unionByName(near.withColumn("is_context", F.lit(True)))


def ask(questions: DataFrame, chunks: DataFrame, chunk_vectors: DataFrame, embedder: Embedder = hashed_ngrams, answerer: Callable[[DataFrame], DataFrame] = replies.extractive, config: Config = CONFIG, rewrite: Rewrite | None = None, history: DataFrame | None = None, index: DataFrame | None = None, vocabulary: DataFrame | None = None, canned: dict[str, str] = CANNED) -> tuple[DataFrame, DataFrame]:
    """(answers, references): query_id, route, language, answer, decision; and the references in order.

    ``answerer`` turns (query_id, ref_id, snippet, …) into (query_id, answer); without
    evidence the decision is to refuse; greetings and questions about the assistant itself get the ``canned`` reply and never reach the joins,
    and a greeting before a question is returned before its answer. References are those that
    the answer cites, the first three where it cites none; each has the ``url`` of its page.
    """
    asked = kept(prepared(questions, rewrite, history, config, vocabulary))
    hits = evidence(asked, chunks, chunk_vectors, embedder, config, index)
    path = F.col("public_path") if "public_path" in chunks.columns else F.lit(None).cast("string")
    url = references.page_url(F.lit(config.base_url.rstrip("/")), path, F.col("doc_name"), F.col("page"))
    texts = chunks.select("chunk_id", "doc_name", "page", "text", url.alias("url"))
    j = hits.join(texts, "chunk_id").join(retrieval.if_small(asked.select("query_id", "question", "toks"), config.query_block), "query_id")
    good = answers.good_hits(j, config)
    subject = answers.subject_matches(F.lower("text"), F.filter("toks", lambda w: ~w.isin(lexicon.SUBJECT_STOP) & (F.length(w) > 2))) + answers.boosts(F.col("question"), F.col("text"))
    sized = good.withColumns({"subject": subject, "size": F.length("text")})
    fit = retrieval.within_budget(sized, "query_id", [F.desc("subject"), F.desc("score"), "chunk_id"], "size", config.evidence_chars, config.evidence_parts)
    refs = answers.renumbered(fit.select("query_id", F.col("rn").alias("ref_id"), "doc_name", "page", F.left("text", F.lit(config.snippet_chars)).alias("snippet"), "url"))
    shown = kept(refs.withColumn("ref_id", F.col("display_id")))
    made = kept(answerer(shown))
    refs = answers.cited(made, shown).drop("ref_id")
    out = asked.select("query_id", "route", "language", "canned", "ack").join(made, "query_id", "left")
    fixed = F.coalesce(*[F.when(F.col("canned") == k, F.lit(v)) for k, v in canned.items()])
    found = F.concat(F.when(F.col("route") == "B", F.col("ack")).otherwise(F.lit("")), F.coalesce("answer", F.lit("This is not mentioned in the context.")))
    said = F.coalesce(F.when(F.col("route") == "A", F.lit(canned["greeting"])), fixed, found)
    out = out.withColumn("answer", said).drop("canned", "ack").withColumn("decision", replies.decision(F.col("answer"), lexicon.REFUSALS))
    return out, refs

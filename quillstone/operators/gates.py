"""Rules of the multi-variant path: fallbacks by intent, gates and their exceptions, context, primary documents, rewrites."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstone import lexicon
from quillstone.functions import text as T
from quillstone.operators import intents, replies, retrieval
from quillstone.operators.answers import any_of
from quillstone.sources.scratch import if_small, kept, spread

#: The order in which a question's intents are tried.
INTENT_ORDER = ["definition", "schedule", "composition", "criteria", "complaint", "vision", "role"]


def wanted_intent(question: Column) -> Column:
    """The first intent of INTENT_ORDER that a question shows, else null."""
    pattern = {name: p for name, p, _ in lexicon.INTENTS}
    plain = T.normal_text(question)
    kinds = replies.question_types(question, lexicon.OVERLAP_STOP, lexicon.KEEP_SHORT)
    shows = lambda name: kinds[name] if name in kinds else T.has_word(plain, pattern[name])
    return F.coalesce(*[F.when(shows(name), F.lit(name)) for name in INTENT_ORDER])


def recall_first(question: Column) -> Column:
    """Short, schedule, yes-no and definition questions: gates let all their hits through."""
    kinds = replies.question_types(question, lexicon.OVERLAP_STOP, lexicon.KEEP_SHORT)
    return reduce(lambda a, b: a | b, kinds.values())


def context_radius(question: Column, wide: int = 2) -> Column:
    """Pages around a hit that belong to it: ``wide`` for questions about pay or for details, else its own page only."""
    return F.when(any_of(F.lower(question), lexicon.CONTEXT_WORDS), F.lit(wide)).otherwise(F.lit(0))


def by_intent(questions: DataFrame, units: DataFrame, phrases: dict[str, list[str]] | None = None, per_doc: int = 3, most: int = 80, definitions: int = 60, block: int = 5_000) -> DataFrame:
    """(query_id, chunk_id, score): chunks that speak of what a question wants, by its phrases and its keywords.

    ``units`` (chunk_id, doc_name, text; search_text if it counts). Definitions take chunks with a phrase (.70). Others score .40 and .05 a
    keyword up to .28, .62 at least with a phrase, and need: schedules, complaints, purposes and roles a phrase or a keyword; composition and criteria a phrase, or two keywords and one
    of the question's entities where it has any. Of a document the first ``per_doc`` chunks count, of a question the first ``most``. Questions without an
    intent have none. Every text is read once for all questions of a block (``intents``).
    """
    phrases = lexicon.PHRASES | {"schedule": lexicon.SCHEDULE_PHRASES, "definition": []} | (phrases or {})
    q = questions.select("query_id", wanted_intent(F.col("question")).alias("intent"), T.keywords(F.col("question"), lexicon.OVERLAP_STOP, lexicon.KEEP_SHORT, 12).alias("keys")).filter("intent is not null")
    # the intents of a question are many patterns, and are used three times
    q = kept(q.withColumn("entities", F.slice(F.filter("keys", lambda w: ~w.isin(lexicon.INTENT_WORDS)), 1, 10)))
    text = T.matching_text(F.col("text"), F.col("search_text") if "search_text" in units.columns else F.lit(None))
    # few bytes a text, much work: the tokens of a text are made once, for keywords and phrases
    rows = spread(units).select("chunk_id", "doc_name", T.normal_text(text).alias("__n"))
    has = [F.when(any_of(F.col("__n"), p), F.lit(name)) for name, p in phrases.items() if p]
    tokens = F.array_distinct(T.stems(F.array_distinct(T.words_of(F.col("__n"))), lexicon.OVERLAP_STOP, lexicon.KEEP_SHORT))
    rows = rows.select("chunk_id", "doc_name", tokens.alias("tokens"), F.array_compact(F.array(*has)).alias("said"))
    found = intents.found(rows, q, per_doc, max(most, definitions), block).join(if_small(q.select("query_id", "intent")), "query_id")
    plain = F.lit(0.4) + F.least(F.lit(0.28), F.lit(0.05) * F.col("n_all"))
    score = F.when(F.col("intent") == "definition", F.lit(0.7)).when(F.col("phrase"), F.greatest(F.lit(0.62), plain)).otherwise(plain)
    few = retrieval.ranked(found.withColumn("score", F.round(score, 6)), ("query_id", "doc_name"), "chunk_id").filter(F.col("rn") <= per_doc).drop("rn")
    return retrieval.ranked(few, ("query_id",), "chunk_id").filter(F.col("rn") <= F.when(F.col("intent") == "definition", definitions).otherwise(most)).select("query_id", "chunk_id", "score")


def gated(hits: DataFrame, questions: DataFrame, per_doc: int, score: float, soft: float) -> DataFrame:
    """``retrieval.soft_gate`` for ordinary questions; questions that want recall keep all their hits."""
    open_ = questions.filter(recall_first(F.col("question"))).select("query_id").distinct()
    free = hits.join(if_small(open_), "query_id", "left_semi")
    bound = hits.join(if_small(open_), "query_id", "left_anti")
    return free.unionByName(retrieval.soft_gate(bound, per_doc, score, soft).select(*hits.columns))


def context_pages(hits: DataFrame, questions: DataFrame, units: DataFrame, score: float = 0.01, wide: int = 2) -> DataFrame:
    """(query_id, chunk_id, score): other chunks of the pages of a hit, and of the pages around it where the question calls for them. An equi-join on page numbers."""
    places = units.select("chunk_id", "doc_name", "page")
    radius = if_small(questions.select("query_id", context_radius(F.col("question"), wide).alias("__r")))
    at = hits.select("query_id", "chunk_id").join(places, "chunk_id").join(radius, "query_id").filter("page is not null")
    wanted = at.select("query_id", "doc_name", F.explode(F.sequence(F.col("page") - F.col("__r"), F.col("page") + F.col("__r"))).alias("page")).distinct()
    found = wanted.join(places, ["doc_name", "page"]).select("query_id", "chunk_id")
    return found.join(hits.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti").withColumn("score", F.lit(score))


def kept_documents(hits: DataFrame, strong: float, share: float, most: int) -> DataFrame:
    """(query_id, doc_name, best, is_primary, doc_rank) of hits with doc_name, blend, overlap and score.

    A document stands for its best hit by blend, then overlap. The primary one is the first whose best hit scores ``strong`` or more,
    or the first of all; documents of at least ``share`` of its blend stay, ``most`` of them; none where it is not above 0.
    """
    top = F.max_by(F.struct("blend", "overlap", "score"), F.struct("blend", "overlap", -F.col("chunk_id")))
    docs = hits.groupBy("query_id", "doc_name").agg(top.alias("t")).select("query_id", "doc_name", F.col("t.blend").alias("best"), F.col("t.overlap").alias("overlap"), F.col("t.score").alias("score"))
    r = retrieval.ranked(docs, ("query_id",), F.desc("best"), F.desc("overlap"), "doc_name")
    every = W.partitionBy("query_id")
    first = F.coalesce(F.min(F.when(F.col("score") >= strong, F.col("rn"))).over(every), F.lit(1))
    r = r.withColumn("is_primary", F.col("rn") == first).withColumn("bar", F.max(F.when(F.col("is_primary"), F.col("best"))).over(every))
    left = r.filter((F.col("bar") > 0) & (F.col("best") >= share * F.col("bar"))).drop("rn")
    return retrieval.ranked(left, ("query_id",), F.desc("best"), F.desc("overlap"), "doc_name").filter(F.col("rn") <= most).select("query_id", "doc_name", "best", "is_primary", F.col("rn").cast("long").alias("doc_rank"))


def rewrites(reply: Column, most: int = 3) -> Column:
    """The wordings in a model's reply, {"queries": [...]}: trimmed, distinct without regard to case, at most ``most``; none where the reply is missing or no such JSON."""
    found = F.from_json(reply, "queries array<string>")["queries"]
    clean = F.filter(F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda x: T.stripped(x)), lambda x: x.isNotNull() & (x != ""))
    first = F.filter(clean, lambda x, i: F.array_position(F.transform(clean, F.lower), F.lower(x)) == i + 1)
    return F.slice(first, 1, most)


def rule_wordings(question: Column) -> Column:
    """What rules make of a question: its plain form, a manager's department in brackets and after 'of', and for each intent how papers put it."""
    plain = T.normal_text(question)
    department = F.regexp_extract(plain, "(?:^| )manager +([a-z]+)", 1)
    manager = [F.when(department != "", F.concat(F.lit("Manager ("), department, F.lit(")"))), F.when(department != "", F.concat(F.lit("Manager of "), department))]
    pattern = {name: p for name, p, _ in lexicon.INTENTS}
    said = [F.when(T.has_word(plain, pattern[name]), F.replace(F.lit(w), F.lit("{}"), question)) for name, ws in lexicon.INTENT_WORDINGS.items() for w in ws]
    return F.array_compact(F.array(F.when(plain != F.lower(question), plain), *said, *manager))

"""Answer side: boosts, citations, references, history, page ranges, routing, evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstone import lexicon
from quillstone.config import CONFIG, Config
from quillstone.functions import text as T


def any_of(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, w: a | F.contains(c, F.lit(w)), words, F.lit(False))


def subject_matches(text: Column, words: Column) -> Column:
    """How many of the words the text contains."""
    return F.size(F.filter(words, lambda w: F.contains(text, w))).cast("long")


def boosts(question: Column, text: Column) -> Column:
    """Additive adjustments by class of question; questions and texts are compared in lower case."""
    q, t = F.lower(question), F.lower(text)
    number = F.regexp_extract(q, "(schedule-[ivx]+)", 1)
    title = F.when((number != "") & F.contains(F.left(t, F.lit(80)), number), 3).otherwise(0)
    pay = any_of(q, ["salary", "pay", "allowance", "benefit", "tankhwah", "scale", "compensation", "kitni", "maash", "number", "amount"])
    table = F.when(pay & F.contains(t, F.lit("minimum pay")) & F.contains(t, F.lit("maximum pay")), 5).otherwise(0)
    named = F.rlike(q, F.lit("(^|[^a-z])(name|nam|naam|kon|kaun|who)($|[^a-z])"))
    person = F.when(named & F.rlike(text, F.lit("(Capt|Mr|Dr|Mrs|Ms|Col|Brig|Gen)\\.? +[A-Z][a-z]")), 3).otherwise(0)
    procedure = any_of(q, ["arrest", "happen", "procedure", "warrant", "penalty", "offence", "comply", "hearing", "appeal", "notice", "search"])
    job = F.when(procedure & (F.startswith(text, F.lit("Position Title:")) | F.contains(text, F.lit("Purpose of the Position:"))), -2).otherwise(0)
    section = F.when(procedure & F.rlike(t, F.lit("(section|sect\\.|s\\.) ?[0-9]+")), 2).otherwise(0)
    return title + table + person + job + section


def cited(answers: DataFrame, refs: DataFrame, fallback: int = 3) -> DataFrame:
    """References that the answer cites as [n]; the first ones where it cites none."""
    ids = answers.select("query_id", F.expr("regexp_extract_all(answer, '\\\\[([0-9]{1,6})\\\\]', 1)").alias("marks"))
    marked = ids.select("query_id", F.explode("marks").alias("m")).select("query_id", F.col("m").cast("int").alias("ref_id")).distinct()
    bare = ids.filter(F.size("marks") == 0).select("query_id")
    some = refs.join(marked, ["query_id", "ref_id"], "left_semi")
    return some.unionByName(refs.join(bare, "query_id", "left_semi").filter(F.col("ref_id") <= fallback))


def renumbered(refs: DataFrame) -> DataFrame:
    """The first reference of each page, numbered anew; ``source_rank`` keeps the old number."""
    first = F.row_number().over(W.partitionBy("query_id", "doc_name", "page").orderBy("ref_id"))
    kept = refs.withColumn("rn", first).filter("rn = 1").drop("rn")
    shown = F.row_number().over(W.partitionBy("query_id").orderBy("ref_id")).cast("long")
    return kept.withColumn("display_id", shown).withColumnRenamed("ref_id", "source_rank")


def usable_history(turns: DataFrame, refusals: list[str], last: int = 4) -> DataFrame:
    """The last turns of valid roles; none where every assistant turn among them refuses."""
    every = W.partitionBy("conv_id")
    recent = turns.filter(F.col("role").isin("user", "assistant")).withColumn("rn", F.row_number().over(every.orderBy(F.desc("turn")))).filter(F.col("rn") <= last)
    said = F.col("role") == "assistant"
    refused = said & any_of(F.lower("text"), refusals)
    counted = recent.withColumns({"a": F.count_if(said).over(every), "r": F.count_if(refused).over(every)})
    return counted.filter("r < a").select("conv_id", "turn", "role", "text")


def last_pair(turns: DataFrame) -> DataFrame:
    """(conv_id, last_question, last_answer) of (conv_id, turn, role, text): the latest turn of each role that has text.

    With a column ``question`` (the one that is asked now), user turns that repeat it do not count. Every conversation has a row; null where a role said nothing.
    """
    text = F.when(F.coalesce("text", F.lit("")) != "", F.col("text"))
    now = F.coalesce(F.col("text") == F.col("question"), F.lit(False)) if "question" in turns.columns else F.lit(False)
    counts = {"question": text.isNotNull() & (F.col("role") == "user") & ~now, "answer": text.isNotNull() & (F.col("role") == "assistant")}
    return turns.groupBy("conv_id").agg(*[F.max_by(F.when(ok, text), F.when(ok, F.col("turn"))).alias(f"last_{k}") for k, ok in counts.items()])


def page_ranges(pages: DataFrame, per: list[str]) -> DataFrame:
    """Pages as '1–3, 7'."""
    distinct = pages.select(*per, "page").distinct()
    islands = distinct.withColumn("island", F.col("page") - F.row_number().over(W.partitionBy(*per).orderBy("page")))
    spans = islands.groupBy(*per, "island").agg(F.min("page").alias("lo"), F.max("page").alias("hi"))
    shown = F.when(F.col("lo") == F.col("hi"), F.col("lo").cast("string")).otherwise(F.concat(F.col("lo").cast("string"), F.lit("–"), F.col("hi").cast("string")))
    return spans.groupBy(*per).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("lo", shown.alias("s")))), lambda x: x["s"]), ", ").alias("pages"))


def language(c: Column) -> Column:
    """unsupported (Devanagari), urdu (Arabic script), roman_urdu (marker words) or english."""
    marks = "kya|hai|hain|kaun|kon|kaise|kahan|mujhe|batao|nahi|aap"
    roman = F.rlike(F.lower(c), F.lit(f"(^|[^a-z])({marks})($|[^a-z])"))
    return F.when(F.rlike(c, F.lit("[\\x{0900}-\\x{097F}]")), "unsupported").when(F.rlike(c, F.lit("[\\x{0600}-\\x{06FF}]")), "urdu").when(roman, "roman_urdu").otherwise("english")


def greeting_split(c: Column, greetings: str) -> Column:
    """struct(decision, rest): A greeting alone, B greeting and question, C neither."""
    low = F.lower(F.btrim(c))
    has = F.rlike(low, F.lit(f"^({greetings})([^a-z]|$)"))
    rest = F.btrim(F.regexp_replace(F.btrim(c), F.lit(f"(?i)^({greetings})[ ,.!-]*"), F.lit("")))
    empty = F.btrim(F.coalesce(c, F.lit(""))) == ""
    decision = F.when(empty | (has & (rest == "")), "A").when(has, "B").otherwise("C")
    return F.struct(decision.alias("decision"), F.when(decision == "B", rest).when(decision == "C", F.btrim(c)).otherwise(F.lit("")).alias("rest"))


def checked(cases: DataFrame) -> DataFrame:
    """(case_id, passed, missing): every keyword must occur in the answer, without regard to case."""
    missing = F.filter("keywords", lambda k: ~F.contains(F.lower("answer"), F.lower(k)))
    return cases.select("case_id", (F.size(missing) == 0).alias("passed"), F.array_join(missing, "|").alias("missing"))


def summary(cases: DataFrame, *by: str) -> DataFrame:
    """(by, n, passed, failed, pass_rate) of cases with ``passed``; one that has no verdict has failed."""
    ok = F.coalesce("passed", F.lit(False))
    rate = F.round(F.avg(ok.cast("double")), 6).alias("pass_rate")
    return cases.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"), rate)


def passed(answer: Column, keywords: Column, is_refusal: Column, decision: Column) -> Column:
    """struct(passed, missing): a refusal case must be refused; any other must not be, and must hold every keyword."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    missing = F.filter(F.coalesce(keywords, F.array().cast("array<string>")), lambda k: ~F.contains(low, F.lower(k)))
    refused = F.coalesce(decision == "refuse", F.lit(False)) | any_of(low, lexicon.REFUSED)
    ok = F.when(is_refusal, refused).otherwise(~any_of(low, lexicon.REFUSED_PLAINLY) & (F.size(missing) == 0))
    return F.struct(ok.alias("passed"), F.when(is_refusal, "").otherwise(F.array_join(missing, "|")).alias("missing"))


def acknowledged(c: Column) -> Column:
    """struct(ack, rest): the reply to a greeting at the start, and what follows it; without one, no reply and the whole."""
    raw = T.stripped(F.coalesce(c, F.lit("")))
    arabic = F.rlike(raw, F.lit("[\\x{0600}-\\x{06FF}]"))
    urdu = F.regexp_extract(raw, f"^({lexicon.GREETINGS_URDU})(?![\\p{{L}}\\p{{N}}_])", 1)
    latin = F.regexp_extract(raw, f"(?i)^({lexicon.GREETINGS_LATIN})(?![\\p{{L}}\\p{{N}}_])", 1)
    hello = F.when(arabic, urdu).otherwise(latin)
    ack = F.when(hello == "", "").when(arabic, lexicon.ACK_URDU).when(F.rlike(F.lower(hello), F.lit(lexicon.SALAM)), lexicon.ACK_SALAM).otherwise(lexicon.ACK)
    rest = F.regexp_replace(F.substr(raw, F.length(hello) + 1), F.lit("^[ ,:\\-—–\\n\\t]+"), F.lit(""))
    return F.struct(ack.alias("ack"), F.when(hello == "", raw).otherwise(rest).alias("rest"))


def canned_intent(question: Column, has_history: Column) -> Column:
    """greeting, identity or creator where a fixed reply is due, else null; the first two only without history.

    A question that names a role is about that role; the own organisation's words are the lexicon's.
    """
    q = T.stripped(F.lower(F.coalesce(question, F.lit(""))))
    ws = T.words_of(q)
    short = F.size(ws) <= 4
    greeting = q.isin(lexicon.GREETED) | (short & any_start(q, [g + " " for g in lexicon.GREETED]))
    about_role = F.arrays_overlap(ws, F.array(*[F.lit(w) for w in lexicon.ROLE_WORDS]))
    identity = ~about_role & (any_of(q, lexicon.IDENTITY) | (short & any_of(q, lexicon.IDENTITY_SHORT)))
    creator = any_of(q, lexicon.MAKERS)
    if lexicon.OWN_NAMES:
        creator = creator & (~any_of(q, lexicon.OWN_NAMES) | any_of(q, [f"{n} {b}" for n in lexicon.OWN_NAMES for b in lexicon.BOT_WORDS]))
    return F.when(~has_history & greeting, "greeting").when(~has_history & identity, "identity").when(creator, "creator")


def any_start(c: Column, starts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.startswith(c, F.lit(s)) for s in starts])


def good_hits(hits: DataFrame, config: Config = CONFIG) -> DataFrame:
    """Hits (with doc_name, score, is_context) that an answer may rest on, with ``best``: of documents whose best direct hit is good enough, direct hits that are so themselves and their context."""
    best = F.max(F.when(~F.col("is_context"), F.col("score"))).over(W.partitionBy("query_id", "doc_name"))
    return hits.withColumn("best", best).filter((F.col("best") >= config.answer_doc_score) & (F.col("is_context") | (F.col("score") >= config.answer_hit_score)))

"""Further queries: question classes, fallbacks, injections, decisions, replies and reports."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstone import lexicon
from quillstone.config import CONFIG as C
from quillstone.functions import text as T
from quillstone.operators import answers, filenames, replies, retrieval
from quillstone.plans.queries import ASKED, ASKED_HITS, BLEND, FUSED, NOT_PLAIN, REFS, SCAN, SEM, STOP, UNITS, WS, asked, blended, fused, in_list, query, question_hits, read, references, stems, strip, units

PLAIN = strip(f"regexp_replace(regexp_replace(lower(question), '{NOT_PLAIN}', ' ', 'g'), '{WS}+', ' ', 'g')")
def plain(x: str) -> str:
    return PLAIN.replace("question", x)


def distinct(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


KEYS = f"{ASKED}, st as (select query_id, question, {stems(plain('question'))} as s from asked), keys as (select query_id, question, ({distinct('s')})[1:12] as keys from st)"


@query(f"with {KEYS} select query_id, array_to_string(keys, ' ') as keywords, array_to_string(list_filter(keys, lambda w: w not in {in_list(STOP)})[1:10], ' ') as entities from keys")
def keyword_sets(spark, d):
    k = T.keywords(F.col("question"), lexicon.OVERLAP_STOP, lexicon.KEEP_SHORT, 12)
    return asked(spark, d).select("query_id", F.array_join(k, " ").alias("keywords"), F.array_join(F.slice(F.filter(k, lambda w: ~w.isin(STOP)), 1, 10), " ").alias("entities"))


@query(f"with {KEYS}, {UNITS}, {ASKED_HITS(20)} select h.query_id, h.chunk_id, h.score, len(list_intersect(keys, {stems(plain('u.text'))})) as overlap from qhits h join keys using (query_id) join units u using (chunk_id)")
def token_overlap(spark, d):
    k = asked(spark, d).select("query_id", T.keywords(F.col("question"), lexicon.OVERLAP_STOP, lexicon.KEEP_SHORT, 12).alias("keys"))
    return retrieval.with_overlap(question_hits(spark, d, 20), k, units(spark, d).select("chunk_id", "text"), lexicon.OVERLAP_STOP, lexicon.KEEP_SHORT)


WRAP = "w as (select query_id, case query_id % 5 when 0 then 'Is ' when 1 then 'what is ' when 2 then 'Annexure of ' when 3 then '' else 'tell me the salary detail ' end || question as question from asked union all select query_id, 'define pay' from asked)"


def wrapped(spark, d):
    """Whole questions of several kinds, and a short one for each."""
    i = F.col("query_id") % 5
    before = F.when(i == 0, "Is ").when(i == 1, "what is ").when(i == 2, "Annexure of ").when(i == 3, "").otherwise("tell me the salary detail ")
    q = asked(spark, d)
    return q.select("query_id", F.explode(F.array(F.concat(before, "question"), F.lit("define pay"))).alias("question"))


@query(f"""with {ASKED}, {WRAP} select query_id, len({stems(plain('question'))}) <= 4 as short, regexp_matches(lower(question), '(^|[^a-z0-9_])(schedule|scheduled +laws|annex(ure)?|appendix)($|[^a-z0-9_])') as schedule,
regexp_matches(lower(trim(question)), '^(is|are|was|were|do|does|did|can|could|should|will|would|has|have|had)($|[^a-z0-9_])') as yes_no, regexp_matches(lower(trim(question)), '^(what +is|define|meaning +of)($|[^a-z0-9_])') as definition from w""")
def query_types(spark, d):
    q = F.col("question")
    return wrapped(spark, d).select("query_id", *[e.alias(k) for k, e in replies.question_types(q, lexicon.OVERLAP_STOP, lexicon.KEEP_SHORT).items()])


@query(f"with {ASKED}, {WRAP} select query_id, " + " or ".join(f"contains(lower(question), '{k}')" for k in lexicon.EXPANSION_TRIGGERS) + " as expand from w")
def expansion_trigger(spark, d):
    return wrapped(spark, d).select("query_id", answers.any_of(F.lower("question"), lexicon.EXPANSION_TRIGGERS).alias("expand"))


@query(f"""with {ASKED}, {WRAP}, p as (select *, {" or ".join(f"contains(lower(question), '{k}')" for k in replies.PAY)} as pay, {" or ".join(f"contains(lower(question), '{k}')" for k in replies.NUMBERS)} as num from w)
select query_id, question || case when pay and not contains(lower(question), 'schedule') then ' pay schedule' else '' end || case when pay and num and not contains(lower(question), 'minimum') then ' minimum pay maximum pay' else '' end as rewritten from p""")
def contextual_rewrite(spark, d):
    return wrapped(spark, d).select("query_id", replies.with_pay_terms(F.col("question")).alias("rewritten"))


@query(f"with {UNITS}, p as (select 'the of' as phrase union all select 'of the' union all select 'in der'), h as (select phrase, chunk_id, doc_name from p, units where contains(lower(text), phrase) qualify row_number() over (partition by phrase, doc_name order by chunk_id) <= 3) select phrase, chunk_id, 0.7::double as score from h qualify row_number() over (partition by phrase order by chunk_id) <= 60")
def definition_fallback(spark, d):
    phrases = spark.createDataFrame([("the of",), ("of the",), ("in der",)], "phrase string")
    low = units(spark, d).select("chunk_id", "doc_name", F.lower("text").alias("t"))
    found = low.join(F.broadcast(phrases), F.contains("t", "phrase")).drop("t")
    per_doc = retrieval.ranked(found, ("phrase", "doc_name"), "chunk_id").filter("rn <= 3").drop("rn")
    return retrieval.ranked(per_doc, ("phrase",), "chunk_id").filter("rn <= 60").select("phrase", "chunk_id", F.lit(0.7).alias("score"))


@query(f"""with {SCAN}, {SEM}, {FUSED}, near as (select distinct f.query_id, u2.chunk_id from fu f join units u using (chunk_id) join units u2 on u2.doc_name = u.doc_name and abs(u2.page - u.page) <= 2),
a as (select query_id, chunk_id, coalesce(f.score, 0.01::double) as score from near left join fu f using (query_id, chunk_id)) select query_id, chunk_id, score, row_number() over (partition by query_id order by page, chunk_id) as page_order from a join units using (chunk_id)""")
def page_expand_sorted(spark, d):
    first, u = fused(spark, d), units(spark, d)
    same = retrieval.page_window(first, u, C.neighbour_radius, 0.01)
    at = first.join(u.select("chunk_id", "doc_name", "page"), "chunk_id").select("query_id", "doc_name", "page").distinct()
    own = at.join(u.select("chunk_id", "doc_name", "page"), ["doc_name", "page"]).select("query_id", "chunk_id", F.lit(0.01).alias("score"))
    every = first.unionByName(same).unionByName(own).groupBy("query_id", "chunk_id").agg(F.max("score").alias("score")).join(u.select("chunk_id", "page"), "chunk_id")
    return retrieval.ranked(every, ("query_id",), "page", "chunk_id").select("query_id", "chunk_id", "score", F.col("rn").cast("long").alias("page_order"))


@query(f"""with {BLEND}, g as (select query_id, doc_name, max(blend) as score, sum(overlap) as overlap, sum(phrases) as phrases from bl2 group by all),
s as (select *, round(10 * phrases + 1.5::double * overlap + score, 6) as signal, row_number() over (partition by query_id order by score desc, doc_name) as base from g),
t as (select *, row_number() over (partition by query_id order by signal desc, doc_name) <= 2 as lead from s) select query_id, doc_name, row_number() over (partition by query_id order by lead desc, case when lead then -signal else base end, doc_name) as doc_rank from t""")
def criteria_priority(spark, d):
    return retrieval.criteria_first(blended(spark, d))


@query(f"with {SCAN}, {SEM}, {FUSED}, files as (select distinct case when doc_id % 2 = 0 then source else source || '.pdf' end as name from documents where doc_id % 13 = 0) select query_id, chunk_id, score from fu join units using (chunk_id) where doc_name in (select name from files) or doc_name || '.pdf' in (select name from files)")
def existing_files(spark, d):
    i = F.col("doc_id")
    files = read(spark, d, "documents").filter(i % 13 == 0).select(F.when(i % 2 == 0, F.col("source")).otherwise(F.concat("source", F.lit(".pdf"))).alias("name"))
    return filenames.existing(fused(spark, d).join(units(spark, d).select("chunk_id", "doc_name"), "chunk_id"), files).select("query_id", "chunk_id", "score")


PERSON = r"(Mr|Dr|Mrs|Ms)\.? +[A-Z][a-z]|Licensed"


@query(f"""with {SCAN}, {SEM}, {FUSED}, persons as (select chunk_id from units where regexp_matches(text, '{PERSON}') and length(text) > 50), named as (select chunk_id from persons order by chunk_id limit 3),
has as (select distinct query_id from fu join persons using (chunk_id)) select query_id, chunk_id, 0.6::double as score from asked, named where contains(lower(question), 'the') and query_id not in (select query_id from has)""")
def name_injection(spark, d):
    person = units(spark, d).filter(F.rlike("text", F.lit(PERSON)) & (F.length("text") > 50)).select("chunk_id")
    wants = asked(spark, d).filter(F.contains(F.lower("question"), F.lit("the")))
    return retrieval.given(fused(spark, d), wants, person, C.name_score, C.named_chunks)


@query("""with a as (select conv_id, turn, 0 as variant, text as answer from conversations union all select conv_id, turn, 1, 'It is Not Mentioned in the context.' from conversations union all select conv_id, turn, 2, '' from conversations)
select conv_id, turn, variant, case when answer = '' then 'error' when """ + " or ".join(f"contains(lower(answer), '{p.replace(chr(39), chr(39) * 2)}')" for p in lexicon.REFUSALS) + """ then 'refuse' else 'answer' end as decision from a""")
def decision_class(spark, d):
    said = F.posexplode(F.array(F.col("text"), F.lit("It is Not Mentioned in the context."), F.lit(""))).alias("variant", "answer")
    return read(spark, d, "conversations").select("conv_id", "turn", said).select("conv_id", "turn", "variant", replies.decision(F.col("answer"), lexicon.REFUSALS).alias("decision"))


@query(f"with {SCAN}, {SEM}, {FUSED}, g as (select query_id, doc_name, max(score) as top from fu join units using (chunk_id) group by all) select f.query_id, f.chunk_id, f.score from fu f join units u using (chunk_id) join g on g.query_id = f.query_id and g.doc_name = u.doc_name where g.top >= 0.66 and f.score >= 0.26")
def answer_thresholds(spark, d):
    named = fused(spark, d).join(units(spark, d).select("chunk_id", "doc_name"), "chunk_id")
    return named.withColumn("top", F.max("score").over(W.partitionBy("query_id", "doc_name"))).filter((F.col("top") >= 0.66) & (F.col("score") >= C.answer_hit_score)).select("query_id", "chunk_id", "score")


@query(f"""with {REFS}, r as (select query_id, string_agg('<li>' || ref_id || '. ' || doc_name || ' p.' || page || ': ' || replace(replace(replace(left(snippet, 40), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</li>', '' order by ref_id) as items, string_agg(doc_name || '#' || page, ',' order by ref_id) as keys, arg_min(snippet, ref_id) as top from refs where ref_id <= 5 group by query_id)
select query_id, '<p>' || replace(replace(replace(top, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || ' [1]</p><ol>' || items || '</ol>' as html, keys from r""")
def answer_html(spark, d):
    return replies.html(references(spark, d).filter("ref_id <= 5"))


@query("with m as (select source, avg(quality::double) as rate, count(*) as n from documents join labels using (doc_id) group by source), c as (select source, rate >= 0.85 as passed, n from m) select row_number() over (order by passed, source) as line_no, case when passed then 'PASS ' else 'FAIL ' end || source || ' (' || n || ')' as line from c")
def eval_report(spark, d):
    j = read(spark, d, "documents").select("doc_id", "source").join(read(spark, d, "labels"), "doc_id")
    m = j.groupBy("source").agg((F.avg(F.col("quality").cast("double")) >= 0.85).alias("passed"), F.count(F.lit(1)).alias("n"))
    return replies.report(m.select(F.col("source").alias("id"), "passed", F.concat(F.lit("("), F.col("n").cast("string"), F.lit(")")).alias("note")))


@query(r"select doc_id, length(left(regexp_replace(text, '^[\x09-\x0D ]+|[\x09-\x0D ]+$', '', 'g'), 12000)) as n, md5(left(regexp_replace(text, '^[\x09-\x0D ]+|[\x09-\x0D ]+$', '', 'g'), 12000)) as digest from documents")
def embed_truncate(spark, d):
    cut = F.left(T.stripped(F.col("text")), F.lit(C.embed_chars))
    return read(spark, d, "documents").select("doc_id", F.length(cut).cast("long").alias("n"), F.md5(cut).alias("digest"))


@query("""with o as (select doc_id as chunk_id, source as doc_name, text, doc_id % 9 <> 0 as active, case when doc_id % 2 = 0 then 2 else 1 end as embed_version from documents)
select chunk_id, sha256('DOC: ' || doc_name || chr(10) || text) as search_sha256, 2 as embed_version, embed_version <> 2 as refreshed from o where active""")
def rebuild_stale(spark, d):
    o = read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_name"), "text", (F.col("doc_id") % 9 != 0).alias("active"), F.when(F.col("doc_id") % 2 == 0, 2).otherwise(1).alias("embed_version"))
    return o.filter("active").select("chunk_id", F.sha2(F.concat(F.lit("DOC: "), "doc_name", F.lit("\n"), "text"), 256).alias("search_sha256"), F.lit(C.embed_version).alias("embed_version"), (F.col("embed_version") != C.embed_version).alias("refreshed"))


@query("with s as (select event_id, date_diff('second', ts, timestamp '2024-02-01') as age from events) select event_id, case when age < 60 then 'just now' when age < 3600 then age // 60 || ' m ago' when age < 86400 then age // 3600 || ' h ago' else age // 86400 || ' d ago' end as ago from s")
def time_ago(spark, d):
    age = F.unix_timestamp(F.lit("2024-02-01 00:00:00").cast("timestamp")) - F.unix_timestamp("ts")
    return read(spark, d, "events").select("event_id", replies.time_ago(age).alias("ago"))


@query("""with e as (select user_id, ts, value from events where event_type = (select min(event_type) from events)), f as (select user_id, ts, event_id from events where event_type = (select max(event_type) from events))
select f.event_id, e.value as last_value from f asof left join e on f.user_id = e.user_id and e.ts <= f.ts""")
def as_of_events(spark, d):
    e = read(spark, d, "events")
    ends = e.agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi"))
    both = e.join(F.broadcast(ends), (F.col("event_type") == F.col("lo")) | (F.col("event_type") == F.col("hi")))
    side = F.col("event_type") == F.col("lo")
    upto = W.partitionBy("user_id").orderBy("ts", F.desc(side)).rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("last_value", F.last(F.when(side, F.col("value")), True).over(upto)).filter(~side).select("event_id", "last_value")


@query("select n_name, count(distinct c_custkey) as customers, count(distinct o_orderkey) as orders, round(sum(l_extendedprice), 2) as volume from nation join customer on c_nationkey = n_nationkey join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey group by n_name")
def nation_volume(spark, d):
    n, c, o, li = (read(spark, d, t) for t in ("nation", "customer", "orders", "lineitem"))
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
    return j.groupBy("n_name").agg(F.countDistinct("c_custkey").alias("customers"), F.countDistinct("o_orderkey").alias("orders"), F.round(F.sum("l_extendedprice"), 2).alias("volume"))


@query("with s as (select user_id, ts, event_id, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 30 minute then 0 else 1 end as new from events), g as (select *, sum(new) over (partition by user_id order by ts, event_id) as k from s) select user_id, min(ts) as start, count(*) as n from g group by user_id, k")
def session_events(spark, d):
    by = W.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = at - F.lag(at).over(by)
    g = read(spark, d, "events").withColumn("new", F.when(gap <= 1_800_000_000, 0).otherwise(1)).withColumn("k", F.sum("new").over(by))
    return g.groupBy("user_id", "k").agg(F.min("ts").alias("start"), F.count(F.lit(1)).alias("n")).drop("k")

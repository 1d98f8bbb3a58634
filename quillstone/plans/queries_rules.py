"""Queries of the rules in ``operators.gates`` and of the spelling index, over whole questions and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone import lexicon
from quillstone.config import CONFIG as C
from quillstone.functions import text as T
from quillstone.operators import answers, gates, replies
from quillstone.plans.queries import ASKED, BLEND, FUSED, SCAN, SEM, UNITS, asked, blended, fused, in_list, query, read, stems, units
from quillstone.plans.queries_more import distinct, plain

ENDS = (r"(^|[^\p{L}\p{N}_])(", r")($|[^\p{L}\p{N}_])")
SAID = ["", " members and required experience", " annexure of the schedule", " complaint procedure and hearing in the file", " purpose of the vision", " salary detail of a manager legal"]
KINDS = f"kinds as (select query_id * 8 + v as query_id, s || question || t as question from asked, (values {', '.join(f'({i}, {chr(39)}tell us of {chr(39)}, {chr(39)}{t}{chr(39)})' for i, t in enumerate(SAID))}, (6, 'what is ', ''), (7, 'role and duties in ', '')) x(v, s, t))"


def kinds(spark, d):
    """Every question in eight forms, so that every intent is asked for."""
    every = [F.concat(F.lit("tell us of "), "question", F.lit(t)) for t in SAID] + [F.concat(F.lit("what is "), "question"), F.concat(F.lit("role and duties in "), "question")]
    return asked(spark, d).select("query_id", F.posexplode(F.array(*every)).alias("v", "question")).select((F.col("query_id") * 8 + F.col("v")).alias("query_id"), "question")


TYPES = f"""len({stems(plain('question'))}) <= 4 as short, regexp_matches(lower(question), '(^|[^a-z0-9_])(schedule|scheduled +laws|annex(ure)?|appendix)($|[^a-z0-9_])') as schedule,
regexp_matches(lower(trim(question)), '^(is|are|was|were|do|does|did|can|could|should|will|would|has|have|had)($|[^a-z0-9_])') as yes_no, regexp_matches(lower(trim(question)), '^(what +is|define|meaning +of)($|[^a-z0-9_])') as definition"""
PATTERNS = {name: p for name, p, _ in lexicon.INTENTS}
INTENT = "case when definition then 'definition' when schedule then 'schedule' " + " ".join(f"when regexp_matches({plain('question')}, '{ENDS[0]}{PATTERNS[n]}{ENDS[1]}') then '{n}'" for n in gates.INTENT_ORDER[2:]) + " end"
WANTED = f"{ASKED}, {KINDS}, types as (select query_id, question, {TYPES} from kinds), wanted as (select query_id, question, {INTENT} as intent from types)"


@query(f"with {WANTED} select query_id, intent from wanted")
def wanted_intents(spark, d):
    return kinds(spark, d).select("query_id", gates.wanted_intent(F.col("question")).alias("intent"))


SAYS = {"criteria": ["of the", "education"], "role": ["in der"], "definition": ["the of", "license"]}
PHRASES = lexicon.PHRASES | {"schedule": lexicon.SCHEDULE_PHRASES} | SAYS
PHRASE = "case intent " + " ".join(f"when '{k}' then " + " or ".join(f"contains(norm, '{p}')" for p in ps) for k, ps in PHRASES.items()) + " end"


@query(f"""with {WANTED}, {UNITS}, ks as (select query_id, intent, ({distinct('s')})[1:12] as keys from (select query_id, intent, {stems(plain('question'))} as s from wanted where intent is not null)),
q as (select *, list_filter(keys, lambda w: w not in {in_list(lexicon.INTENT_WORDS)})[1:10] as entities from ks), tx as (select chunk_id, doc_name, norm, {stems('norm')} as toks from (select chunk_id, doc_name, {plain('text')} as norm from units)),
m as (select query_id, intent, chunk_id, doc_name, {PHRASE} as phrase, len(list_intersect(keys, toks)) as n, len(list_intersect(entities, toks)) as e, len(entities) as named from q, tx),
f as (select *, round(case when intent = 'definition' then 0.7::double when phrase then greatest(0.62::double, 0.4::double + least(0.28::double, 0.05::double * n)) else 0.4::double + least(0.28::double, 0.05::double * n) end, 6) as score from m
 where case when intent = 'definition' then phrase when intent in ('composition', 'criteria') then phrase or (n >= 2 and (named = 0 or e >= 1)) else phrase or n >= 1 end),
p as (select * from f qualify row_number() over (partition by query_id, doc_name order by chunk_id) <= 3) select query_id, chunk_id, score from p qualify row_number() over (partition by query_id order by chunk_id) <= case when intent = 'definition' then 60 else 80 end""")
def intent_fallback(spark, d):
    return gates.by_intent(kinds(spark, d), units(spark, d).select("chunk_id", "doc_name", "text"), SAYS)


MIXED = "mixed as (select query_id, case query_id % 3 when 0 then question else 'tell us everything of the ' || question || ' and its benefits for all' end as question from asked)"


def mixed(spark, d):
    """Short questions as they are, two thirds as longer ones that no exception holds for."""
    q = asked(spark, d)
    return q.select("query_id", F.when(F.col("query_id") % 3 == 0, F.col("question")).otherwise(F.concat(F.lit("tell us everything of the "), "question", F.lit(" and its benefits for all"))).alias("question"))


@query(f"""with {BLEND}, {MIXED}, ty as (select query_id, {TYPES} from mixed), g as (select b.*, short or schedule or yes_no or definition as open from bl2 b join ty using (query_id)),
r as (select *, row_number() over (partition by query_id, doc_name order by blend desc, chunk_id) as rn from g) select query_id, chunk_id from r where open or rn <= 2 or score >= 0.26 or score >= 0.22 or overlap >= 1""")
def open_gate(spark, d):
    return gates.gated(blended(spark, d), mixed(spark, d), C.gate_per_doc, C.gate_score, C.gate_soft).select("query_id", "chunk_id")


@query(f"""with {SCAN}, {SEM}, {FUSED}, {MIXED}, rad as (select query_id, case when {" or ".join(f"contains(lower(question), '{w}')" for w in lexicon.CONTEXT_WORDS)} then 2 else 0 end as r from mixed),
n as (select distinct f.query_id, u2.chunk_id from fu f join rad using (query_id) join units u using (chunk_id) join units u2 on u2.doc_name = u.doc_name and abs(u2.page - u.page) <= r) select query_id, chunk_id, 0.01::double as score from n where (query_id, chunk_id) not in (select (query_id, chunk_id) from fu)""")
def context_pages(spark, d):
    return gates.context_pages(fused(spark, d), mixed(spark, d), units(spark, d))


@query(f"""with {BLEND}, t as (select * from bl2 qualify row_number() over (partition by query_id, doc_name order by blend desc, overlap desc, chunk_id) = 1),
r as (select *, row_number() over w as rn from t window w as (partition by query_id order by blend desc, overlap desc, doc_name)), f as (select *, coalesce(min(rn) filter (score >= 0.55) over (partition by query_id), 1) as first from r),
b as (select *, max(blend) filter (rn = first) over (partition by query_id) as bar from f), k as (select *, row_number() over (partition by query_id order by rn) as doc_rank from b where bar > 0 and blend >= 0.8::double * bar)
select query_id, doc_name, blend as best, rn = first as is_primary, doc_rank from k where doc_rank <= 8""")
def kept_documents(spark, d):
    return gates.kept_documents(blended(spark, d), 0.55, C.relative_keep, C.max_docs)


@query("""with r as (select conv_id, turn, case turn % 4 when 0 then text when 1 then '{"queries": "' || turn || '"}' when 2 then '{"queries": ["One ' || conv_id || '", " one ' || conv_id || ' ", "", null, "b", "B", "c", "d"]}' end as reply from conversations)
select conv_id, turn, case when turn % 4 = 2 then 'One ' || conv_id || '|b|c' else '' end as wordings from r""")
def model_rewrites(spark, d):
    """Replies that are no JSON, JSON of another shape, lists with blanks and repeats, and none at all."""
    i, who = F.col("turn") % 4, F.col("conv_id").cast("string")
    listed = F.concat(F.lit('{"queries": ["One '), who, F.lit('", " one '), who, F.lit(' ", "", null, "b", "B", "c", "d"]}'))
    reply = F.when(i == 0, F.col("text")).when(i == 1, F.concat(F.lit('{"queries": "'), F.col("turn").cast("string"), F.lit('"}'))).when(i == 2, listed)
    return read(spark, d, "conversations").select("conv_id", "turn", F.array_join(gates.rewrites(reply), "|").alias("wordings"))


RULED = "list_filter([case when p <> lower(question) then p end, " + ", ".join(f"case when regexp_matches(p, '{ENDS[0]}{PATTERNS[n]}{ENDS[1]}') then replace('{w}', '{{}}', question) end" for n, ws in lexicon.INTENT_WORDINGS.items() for w in ws) + ", case when dep <> '' then 'Manager (' || dep || ')' end, case when dep <> '' then 'Manager of ' || dep end], lambda x: x is not null)"


@query(rf"with {ASKED}, {KINDS}, n as (select query_id, question, {plain('question')} as p from kinds), m as (select *, regexp_extract(p, '(?:^| )manager +([a-z]+)', 1) as dep from n) select query_id, array_to_string({RULED}, '|') as wordings from m")
def rule_wordings(spark, d):
    return kinds(spark, d).select("query_id", F.array_join(gates.rule_wordings(F.col("question")), "|").alias("wordings"))


@query(f"with {ASKED}, {KINDS} select query_id, " + "case when " + " or ".join(f"contains(lower(question), '{w}')" for w in lexicon.CONTEXT_WORDS) + " then 2 else 0 end as radius from kinds")
def context_radius(spark, d):
    return kinds(spark, d).select("query_id", gates.context_radius(F.col("question")).alias("radius"))




TAGGED = "case when doc_id % 3 = 0 then text || ' Schedule of the disciplinary hearing: how to file Complaints, vice chairperson, FAQ.' else text end"
LISTED = "list_filter([" + ", ".join(rf"case when regexp_matches(lower(body), '{ENDS[0]}{p}{ENDS[1]}') then '{t}' end" for p, t in lexicon.TAGS) + "], lambda v: v is not null)"
TAGS = f"list_filter({LISTED}, lambda v, i: list_position({LISTED}, v) = i)"


def tagged(spark, d):
    """Whole texts; a third of them with words that the lexicon's own tags are for."""
    i = F.col("doc_id")
    body = F.when(i % 3 == 0, F.concat("text", F.lit(" Schedule of the disciplinary hearing: how to file Complaints, vice chairperson, FAQ."))).otherwise(F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.when(i % 7 != 0, F.concat(F.lit("book "), i, F.lit(".pdf"))).alias("doc"), F.when(i % 5 != 0, F.lit(" pdf ")).alias("kind"), body.alias("body"))


@query(f"with b as (select doc_id, {TAGGED} as body from documents) select doc_id, array_to_string({TAGS}, ',') as tags from b")
def lexicon_tags(spark, d):
    return tagged(spark, d).select("doc_id", F.array_join(T.tags(F.col("body"), lexicon.TAGS), ",").alias("tags"))


TRIM = r"regexp_replace({0}, '^[\x09-\x0D ]+|[\x09-\x0D ]+$', '', 'g')"


@query(rf"""with b as (select doc_id, case when doc_id % 7 <> 0 then 'book ' || doc_id || '.pdf' end as doc, case when doc_id % 5 <> 0 then 'pdf' else '' end as kind, {TAGGED} as body from documents), t as (select *, {TAGS} as tags, {TRIM.format('body')} as txt from b),
h as (select *, case when len(tags) > 0 then 'TAGS: ' || array_to_string(tags, ', ') else 'TAGS:' end as line, coalesce(doc, 'Unknown document') as named, case when doc is null then 0 else doc_id end as rank from t)
select doc_id, md5({TRIM.format("'DOCUMENT: ' || named || chr(10) || 'RANK: ' || rank || chr(10) || 'TYPE: ' || kind || chr(10) || 'LOCATION: Page ' || doc_id || chr(10) || line || chr(10) || 'All papers' || chr(10) || chr(10) || txt")}) as embed, md5({TRIM.format("'DOC: ' || named || chr(10) || 'TYPE: ' || kind || chr(10) || 'LOC: Page ' || doc_id || chr(10) || line || chr(10) || chr(10) || txt")}) as search from h""")
def full_headers(spark, d):
    t = tagged(spark, d).withColumn("tags", T.tags(F.col("body"), lexicon.TAGS))
    loc, rank = F.concat(F.lit("Page "), "doc_id"), F.when(F.col("doc").isNotNull(), T.book_rank(F.col("doc")))
    return t.select("doc_id", F.md5(T.full_embed_text(F.col("doc"), rank, F.col("kind"), loc, F.col("tags"), F.col("body"), "All papers")).alias("embed"), F.md5(T.full_search_text(F.col("doc"), F.col("kind"), loc, F.col("tags"), F.col("body"))).alias("search"))


FIXED = f"map {{{', '.join(f'{chr(39)}{k}{chr(39)}: {chr(39)}{v}{chr(39)}' for k, v in lexicon.TYPOS.items())}}}"
SHORT = f"map {{{', '.join(f'{chr(39)}{k}{chr(39)}: {chr(39)}{v}{chr(39)}' for k, v in lexicon.ABBREVIATIONS.items())}}}"
ODD = "o as (select query_id, 'Salery of the genral offcer; CTO, dg. (hr) scedule: ' || question || ' Moniter benifits tor' as q from asked), w as (select query_id, list_filter(regexp_split_to_array(q, '[\x09-\x0D ]+'), lambda w: w <> '') as ws from o)"


def misspelt(spark, d):
    return asked(spark, d).select("query_id", F.concat(F.lit("Salery of the genral offcer; CTO, dg. (hr) scedule: "), "question", F.lit(" Moniter benifits tor")).alias("q"))


@query(rf"with {ASKED}, {ODD}, f as (select query_id, list_transform(ws, lambda w: case when {FIXED}[lower(w)] is null then w when regexp_matches(left(w, 1), '\p{{Lu}}') then upper(left({FIXED}[lower(w)], 1)) || substr({FIXED}[lower(w)], 2) else {FIXED}[lower(w)] end) as ws from w) select query_id, array_to_string(ws, ' ') as fixed from f")
def lexicon_typos(spark, d):
    return misspelt(spark, d).select("query_id", T.fix_words(F.col("q"), lexicon.TYPOS).alias("fixed"))


@query(f"with {ASKED}, {ODD} select query_id, array_to_string(list_transform(ws, lambda w: coalesce({SHORT}[lower(regexp_replace(w, '[^a-zA-Z]', '', 'g'))], w)), ' ') as expanded from w")
def lexicon_abbreviations(spark, d):
    return misspelt(spark, d).select("query_id", T.expand_words(F.col("q"), lexicon.ABBREVIATIONS).alias("expanded"))


@query(f"""with {SCAN}, {SEM}, {FUSED}, g as (select query_id, doc_name, max(score) as top from fu join units using (chunk_id) group by all)
select f.query_id, f.chunk_id, f.score from fu f join units u using (chunk_id) join g on g.query_id = f.query_id and g.doc_name = u.doc_name where g.top >= 0.28 and f.score >= 0.26 and g.top < 0.66""")
def weak_documents(spark, d):
    """Hits that pass the thresholds of an answer, of documents that a bar of .66 would refuse."""
    named = fused(spark, d).join(units(spark, d).select("chunk_id", "doc_name"), "chunk_id")
    return answers.good_hits(named.withColumn("is_context", F.lit(False)), C).filter("best < 0.66").select("query_id", "chunk_id", "score")


SPACE = r"[\x09-\x0D ]"
HTML = r"""regexp_replace(regexp_replace(regexp_replace({0}, '\*\*(.*?)\*\*', '<strong>\1</strong>', 'g'), '\*(.*?)\*', '<em>\1</em>', 'g'), '\[([0-9]+)\]', '<span class="cite-badge">[\1]</span>', 'g')"""


@query(rf"""with a as (select conv_id, turn, '## The **head** [1]' || chr(10) || '- one *point*' || chr(10) || '  • two [2]' || chr(10) || '1. first' || chr(10) || '2) second' || chr(10) || chr(10) || chr(10) || text || chr(10) || '-none' || chr(10) || ' ' || chr(10) || '- last' as t from conversations),
l as (select conv_id, turn, i, {TRIM.format('ls[i]')} as x from (select conv_id, turn, string_split(t, chr(10)) as ls, unnest(range(1, len(string_split(t, chr(10))) + 1)) as i from a)),
k as (select *, case when x = '' then 'space' when starts_with(x, '## ') then 'heading' when regexp_matches(x, '^[-•]{SPACE}') then 'ul' when regexp_matches(x, '^[0-9]+[.)]{SPACE}') then 'ol' else 'para' end as kind from l),
b as (select *, lag(kind) over (partition by conv_id, turn order by i) as last, {HTML.format(f"case kind when 'heading' then substr(x, 4) when 'ul' then regexp_replace(x, '^[-•]{SPACE}*', '') when 'ol' then regexp_replace(x, '^[0-9]+[.)]{SPACE}*', '') else x end")} as html from k),
g as (select *, sum((kind not in ('ul', 'ol') or kind is distinct from last)::int) over (partition by conv_id, turn order by i) as grp from b),
m as (select conv_id, turn, grp, min(i) as i, first(kind) as kind, string_agg(html, '|' order by i) as items, first(last order by i) as last from g group by conv_id, turn, grp)
select conv_id, turn, string_agg(kind || ':' || items, chr(10) order by i) as blocks from m where kind <> 'space' or (last is not null and last <> 'space') group by conv_id, turn""")
def answer_blocks(spark, d):
    """Turns with Markdown before and after them."""
    text = F.concat(F.lit("## The **head** [1]\n- one *point*\n  • two [2]\n1. first\n2) second\n\n\n"), "text", F.lit("\n-none\n \n- last"))
    shown = F.array_join(F.transform("b", lambda b: F.concat(b["kind"], F.lit(":"), F.array_join(b["items"], "|"))), "\n")
    return read(spark, d, "conversations").select("conv_id", "turn", replies.answer_blocks(text).alias("b")).select("conv_id", "turn", shown.alias("blocks"))

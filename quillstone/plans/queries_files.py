"""Queries of file names, links and marks of references, scans and their counts, written-out texts, and headers that repeat."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone import lexicon
from quillstone.config import CONFIG as C
from quillstone.functions import text as T
from quillstone.operators import filenames, lines, maintenance, references, retrieval
from quillstone.plans.queries import ASKED, FUSED, MARKS, NOT_PLAIN, ORACLES, SCAN, SEM, UNITS, VERSIONS, WS, asked, fused, in_list, query, read, snapshot, strip, tokens, units

SAID = [
    "'Rules – ' || s || ' (v1).pdf'", "'Rules%20%E2%80%93%20' || s || '%20(v1).pdf'", "' Rules – ' || s || ' (v1)'", "s || '—list.pdf'", "s || '–list'",
    "'RULES - ' || upper(s) || ' (V1).PDF'", "'rules  −  ' || s || ' (v1)'", "'Rules * ' || s || ' v1!'", "'no ' || s",
]
BEST = rf"regexp_replace(lower({strip(f'regexp_replace(translate(x, {chr(39)}–—−{chr(39)}, {chr(39)}---{chr(39)}), {chr(39)}{WS}+{chr(39)}, {chr(39)} {chr(39)}, {chr(39)}g{chr(39)})')}), '\.pdf$', '')"


def normal(x: str) -> str:
    return BEST.replace("(x,", f"({x},")


def bare(x: str) -> str:
    return f"regexp_replace({normal(x)}, '[^a-z0-9 ]', '', 'g')"


@query(f"""with d as (select source || ' ' || doc_id as s from documents), n as (select 'Rules – ' || s || ' (v1).pdf' as name from d union select s || '-list.pdf' from d), w as (select distinct unnest([{", ".join(SAID)}]) as wanted from d),
q as (select wanted, {strip('url_decode(wanted)')} as said, replace(replace({strip('url_decode(wanted)')}, '–', '-'), '—', '-') as flat from w), nn as (select name, {normal('name')} as k, {bare('name')} as b from n), qq as (select *, {normal('said')} as k, {bare('said')} as b from q),
c as (select wanted, name, 1 as tier from qq join nn on name = said union all select wanted, name, 2 from qq join nn on name = flat union all select wanted, name, 3 from qq join nn on name = said || '.pdf' union all select wanted, name, 4 from qq join nn on name = flat || '.pdf'
union all select wanted, name, 5 from qq join nn using (k) union all select wanted, name, 6 from qq join nn using (b) where b <> '') select wanted, name, tier from c qualify row_number() over (partition by wanted order by tier, name) = 1""")
def filename_resolve(spark, d):
    """Two files for each document, asked for in nine ways, one of which fits none."""
    docs = read(spark, d, "documents").select(F.concat("source", F.lit(" "), F.col("doc_id").cast("string")).alias("s"))
    names = docs.select(F.expr("explode(array('Rules – ' || s || ' (v1).pdf', s || '-list.pdf'))").alias("name"))
    wanted = docs.select(F.expr(f"explode(array({', '.join(SAID)}))").alias("wanted"))
    return filenames.resolved(wanted, names)


BODY = strip("snippet")
PHRASES = rf"""list_concat(list_concat(list_filter([replace({BODY}, chr(10), ' ')], lambda p: length(p) > 2), list_filter(list_transform(regexp_split_to_array({BODY}, '[\n.•]+'), lambda l: {strip('l')}), lambda p: length(p) > 10)),
list_filter(regexp_split_to_array(lower(question), '[^\p{{L}}\p{{N}}_]+'), lambda w: length(w) > 2 and w not in {in_list(lexicon.HIGHLIGHT_STOP)}))"""
SHOWN = f"{SCAN}, {SEM}, {FUSED}, sh as (select query_id, chunk_id, left(text, 200) as snippet, text, question from fu join units using (chunk_id) join asked using (query_id)), ph as (select *, {PHRASES} as phrases from sh)"


def shown(spark, d):
    u = units(spark, d).select("chunk_id", "text")
    j = fused(spark, d).join(u, "chunk_id").join(retrieval.if_small(tokens(spark, d).select("query_id", "question")), "query_id")
    return j.select("query_id", "chunk_id", "text", references.highlights(F.left("text", F.lit(C.snippet_chars)), F.col("question")).alias("phrases"))


@query(f"with {SHOWN} select query_id, chunk_id, array_to_string(phrases, '|') as phrases from ph")
def highlight_phrases(spark, d):
    return shown(spark, d).select("query_id", "chunk_id", F.array_join("phrases", "|").alias("phrases"))


@query(f"""with {SHOWN}, m as (select query_id, chunk_id, list_filter(list_transform(phrases, lambda p: case when contains(lower(text), lower(p)) then p when length(p) > 20 and contains(lower(text), lower(left(p, 20))) then left(p, 20) end), lambda p: p is not null) as f from ph)
select query_id, chunk_id, array_to_string(list_filter(f, lambda p, i: list_position(f, p) = i), '|') as marks from m""")
def page_marks(spark, d):
    return shown(spark, d).select("query_id", "chunk_id", F.array_join(references.marks(F.col("text"), F.col("phrases")), "|").alias("marks"))


@query("select doc_id, 'https://h' || case when doc_id % 3 = 0 then '/assets/data/' || source else '/files/' || doc_id end || case when doc_id % 7 = 0 then '' else '#page=' || doc_id // 20 end as url from documents")
def reference_urls(spark, d):
    i = F.col("doc_id")
    path = F.when(i % 6 == 0, "").when(i % 3 != 0, F.concat(F.lit("/files/"), i.cast("string")))
    page = F.when(i % 7 != 0, F.floor(i / 20).cast("long"))
    return read(spark, d, "documents").select("doc_id", references.page_url(F.lit("https://h"), path, F.col("source"), page).alias("url"))


@query(f"with {UNITS}, p as (select distinct doc_name, 'Section ' || page as place from units), g as (select doc_name, list(place order by place) as ps from p group by doc_name) select doc_name, array_to_string(ps[1:6], '; ') || case when len(ps) > 6 then '; +' || len(ps) - 6 || ' more' else '' end as places from g")
def shown_places(spark, d):
    places = F.array_sort(F.collect_set(F.concat(F.lit("Section "), F.col("page").cast("string"))))
    return units(spark, d).groupBy("doc_name").agg(places.alias("ps")).select("doc_name", references.shown_places(F.col("ps")).alias("places"))


def scan(spark, d):
    """(found, known): a scan and the manifest of the one before it, an hour older."""
    files = lambda keep, at: snapshot(spark, d, keep).select("filename", F.concat(F.lit("/data/"), "filename").alias("path"), F.lit("txt").alias("ext"), F.lit(at).alias("mtime"), F.lit(1).alias("size"), F.lit(0).alias("rank"), "sha256")
    return files("user_id % 10 <> 3", 7200), maintenance.manifest(files("user_id % 10 <> 7 and event_id % 50 <> 1", 3600))


COMPARED = f"{VERSIONS}, c as (select coalesce(s.filename, m.filename) as filename, s.sha256 as now, case when m.filename is null then 'new' when s.filename is null then 'removed' when s.sha256 = m.sha256 then 'unchanged' else 'changed' end as status from scan s full join man m on s.filename = m.filename)"


@query(f"with {COMPARED} select count(*) filter (status <> 'removed') as found, count(*) filter (status in ('new', 'changed')) as new_or_changed, count(*) filter (status = 'unchanged') as unchanged, count(*) filter (status = 'removed') as removed from c")
def scan_counts(spark, d):
    return maintenance.scanned(*scan(spark, d))[2]


@query(f"with {COMPARED} select filename, now as sha256, case when status = 'unchanged' then 3600 else 7200 end::bigint as mtime from c where status <> 'removed'")
def saved_manifest(spark, d):
    return maintenance.scanned(*scan(spark, d))[0].select("filename", "sha256", "mtime")


FORMS = f"map {{{', '.join(f'{chr(39)}{k}{chr(39)}: {chr(39)}{v}{chr(39)}' for k, v in lexicon.SHORT_FORMS.items())}}}"
OWN = {"offic": "office", "paperz": "papers"}
MISSPELT = f"map {{{', '.join(f'{chr(39)}{k}{chr(39)}: {chr(39)}{v}{chr(39)}' for k, v in OWN.items())}}}"


def plain_sql(x: str) -> str:
    return strip(f"regexp_replace(regexp_replace(lower({x}), '{NOT_PLAIN}', ' ', 'g'), '{WS}+', ' ', 'g')")


WRITTEN = rf"array_to_string(list_transform(regexp_split_to_array(lower(q), '[^\p{{L}}\p{{N}}_\x{{0600}}-\x{{06FF}}]+'), lambda w: coalesce({FORMS}[w], w)), ' ')"


@query(rf"with {ASKED}, o as (select query_id, 'The CTO''s offic, TORs; dg-hr it_x (Mgr) paperz: ' || question as q from asked), w as (select query_id, {plain_sql(WRITTEN)} as p from o) select query_id, array_to_string(list_transform(string_split(p, ' '), lambda w: coalesce({MISSPELT}[w], w)), ' ') as written from w")
def written_questions(spark, d):
    q = F.concat(F.lit("The CTO's offic, TORs; dg-hr it_x (Mgr) paperz: "), "question")
    return asked(spark, d).select("query_id", T.expanded_text(q, lexicon.SHORT_FORMS, OWN).alias("written"))


#: Units with a header and a page number on every page.
PAGED = "units as (select doc_id as chunk_id, source as doc_name, doc_id // 20 as page, 'All Rights Reserved, ' || source || chr(10) || text || chr(10) || 'Page ' || doc_id // 20 as text from documents)"


def paged(spark, d):
    return units(spark, d).withColumn("text", F.concat(F.lit("All Rights Reserved, "), "doc_name", F.lit("\n"), "text", F.lit("\nPage "), F.col("page").cast("string")))


@query(ORACLES["header_footer_repeated"].replace(UNITS, PAGED))
def page_headers(spark, d):
    return lines.repeated_lines(paged(spark, d), MARKS)


@query(ORACLES["strip_repeated_lines"].replace(UNITS, PAGED))
def pages_without_headers(spark, d):
    u = paged(spark, d)
    made = lines.without_repeated(u, lines.repeated_lines(u, MARKS)).filter("n_lines > 0")
    return made.select("chunk_id", "n_lines", F.size("kept_lines").cast("long").alias("n_kept"), F.md5(F.array_join("kept_lines", "\n")).alias("digest"))

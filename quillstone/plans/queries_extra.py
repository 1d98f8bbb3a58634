"""Further queries: references and addresses, canned replies, spelling, refusals, sessions, refreshed rows, manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone import lexicon
from quillstone.config import CONFIG as C
from quillstone.functions import text as T
from quillstone.operators import answers, maintenance, references, replies, retrieval
from quillstone.plans.queries import QTOKS, TAGS, UNITS, in_list, query, read, strip, tag_sql, tokens, units, vocab, word_list
from quillstone.plans.queries_more import plain

BASE = "https://files.example.org"


def any_sql(x: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains({x}, '{w}')" for w in words) + ")"


# ---- references ------------------------------------------------------------------------


@query(f"""with s as (select doc_id, case when doc_id % 7 = 0 then null else doc_id % 50 end as a, case doc_id % 4 when 0 then null when 1 then doc_id % 50 + 3 when 2 then doc_id % 50 - 2 else doc_id % 50 end as b, case when doc_id % 3 = 0 then '  ' when doc_id % 3 = 1 then ' ' || source || ' ' end as loc, case when doc_id % 2 = 0 then source else 'Page ' || doc_id end as loc_start from documents)
select doc_id, case when a is null then '' else array_to_string(range(least(a, coalesce(b, a)), greatest(a, coalesce(b, a)) + 1), ',') end as pages, array_to_string(list_sort(list_distinct(list_filter([{strip("coalesce(loc, '')")}, loc_start], lambda p: p <> ''))), '|') as places from s""")
def reference_pages(spark, d):
    i = F.col("doc_id")
    s = read(spark, d, "documents").select(
        "doc_id",
        F.when(i % 7 != 0, i % 50).alias("a"),
        F.when(i % 4 == 1, i % 50 + 3).when(i % 4 == 2, i % 50 - 2).when(i % 4 == 3, i % 50).alias("b"),
        F.when(i % 3 == 0, "  ").when(i % 3 == 1, F.concat(F.lit(" "), "source", F.lit(" "))).alias("loc"),
        F.when(i % 2 == 0, F.col("source")).otherwise(F.concat(F.lit("Page "), i)).alias("loc_start"),
    )
    pages = references.page_list(F.col("a"), F.col("b"))
    return s.select("doc_id", F.array_join(pages.cast("array<string>"), ",").alias("pages"), F.array_join(references.place_list(F.col("loc"), F.col("loc_start")), "|").alias("places"))


ADDRESSES = f"""p as (select page_id, string_split(url, '/')[-1] as base, case when page_id % 5 = 0 then url end as given,
case page_id % 5 when 1 then '/assets/data/' || page_id || ' a.pdf' when 2 then 'sub\\' || page_id || '.DOCX' when 3 then url else '' end as path, case when page_id % 2 = 0 then '?v=1' end as hint, case when page_id % 10 = 4 then null else 'Book ' || page_id || '.pdf' end as document, case when page_id % 3 > 0 then page_id % 3 end as page from pages),
n as (select *, replace(path, '\\', '/') as sp from p),
u as (select *, case when given is not null then given when path <> '' then case when starts_with(sp, 'http') then sp else '{BASE}' || case when starts_with(sp, '/') then '' else '/' end || sp end || coalesce(hint, '') else '{BASE}/assets/data/' || replace(url_encode(coalesce(document, 'Unknown document')), '%2F', '/') end as u,
case when regexp_matches(sp, '^/?assets/data/') or regexp_matches(lower(sp), '\\.(pdf|docx)$') then string_split(sp, '/')[-1] else coalesce(document, '') end as file from n)"""


@query(f"with {ADDRESSES} select page_id, case when contains(u, '#') or page is null then u else u || '#page=' || page end as open_url, file, '{BASE}/download/' || replace(url_encode(file), '%2F', '/') as download_url from u")
def open_urls(spark, d):
    i = F.col("page_id")
    p = read(spark, d, "pages").select(
        "page_id",
        F.when(i % 5 == 0, F.col("url")).alias("given"),
        F.when(i % 5 == 1, F.concat(F.lit("/assets/data/"), i, F.lit(" a.pdf"))).when(i % 5 == 2, F.concat(F.lit("sub\\"), i, F.lit(".DOCX"))).when(i % 5 == 3, F.col("url")).otherwise("").alias("path"),
        F.when(i % 2 == 0, "?v=1").alias("hint"),
        F.when(i % 10 != 4, F.concat(F.lit("Book "), i, F.lit(".pdf"))).alias("document"),
        F.when(i % 3 > 0, i % 3).alias("page"),
    )
    base, file = F.lit(BASE), references.file_name(F.col("path"), F.col("document"))
    to = references.open_url(base, F.col("given"), F.col("path"), F.col("hint"), F.col("document"), references.page_list(F.col("page"), F.col("page")))
    return p.select("page_id", to.alias("open_url"), file.alias("file"), references.download_url(base, file).alias("download_url"))


PATHS = ["/srv/data/%s", "/srv/data/../data/%s", "/srv/data/../%s", "/srv/database/%s", "/srv/data/./a//../%s", "srv/data/%s", "/srv/data/a/../../../%s", "/../srv/data/%s"]


STEP = "case when p[1] in ('', '.') then a when p[1] = '..' then a[:-2] else list_concat(a, p) end"
AT = f"'/' || array_to_string(list_reduce(list_transform(string_split(path, '/'), lambda p: [p]), lambda a, p: {STEP}, []::varchar[]), '/')"


@query("with b as (select page_id, string_split(string_split(url, '?')[1], '/')[-1] as base from pages), p as (" + " union all ".join(f"select page_id, '{p.replace('%s', '')}' || base as path from b" for p in PATHS) + f"), r as (select *, {AT} as dest from p) select page_id, path, starts_with(path, '/') and (dest = '/srv/data' or starts_with(dest, '/srv/data/')) as contained from r")
def contained_paths(spark, d):
    base = F.element_at(F.split(F.element_at(F.split("url", r"\?"), 1), "/"), -1)
    made = read(spark, d, "pages").select("page_id", F.explode(F.array(*[F.concat(F.lit(p.replace("%s", "")), base) for p in PATHS])).alias("path"))
    return made.select("page_id", "path", references.is_contained(F.col("path"), "/srv/data").alias("contained"))


@query("""with r as (select doc_id % 50 as query_id, doc_id as ref_id, source as document, case when doc_id % 3 > 0 then 'p' || doc_id % 3 else '' end as path, case when doc_id % 4 = 1 then 'u' || doc_id else '' end as url, case when doc_id % 5 > 1 then md5(text) else '' end as snippet, doc_id // 50 % 9 as p0, doc_id // 50 % 9 + doc_id % 2 as p1, 'L' || doc_id % 4 as place from documents),
x as (select query_id, document, path, unnest(range(p0, p1 + 1)) as page from r), pg as (select query_id, document, path, string_agg(page::varchar, ',' order by page) as pages from (select distinct * from x) group by all)
select query_id, document, path, coalesce(arg_min(url, ref_id) filter (url <> ''), '') as url, coalesce(arg_min(snippet, ref_id) filter (snippet <> ''), '') as snippet, any_value(pages) as pages, array_to_string(list_sort(list(distinct place)), '|') as places from r join pg using (query_id, document, path) group by query_id, document, path""")
def reference_groups(spark, d):
    i = F.col("doc_id")
    p0 = F.floor(i / 50).cast("long") % 9
    r = read(spark, d, "documents").select(
        (i % 50).alias("query_id"),
        i.alias("ref_id"),
        F.col("source").alias("document"),
        F.when(i % 3 > 0, F.concat(F.lit("p"), i % 3)).alias("path"),
        F.when(i % 4 == 1, F.concat(F.lit("u"), i)).alias("url"),
        F.when(i % 5 > 1, F.md5("text")).otherwise("").alias("snippet"),
        p0.alias("page_start"),
        (p0 + i % 2).alias("page_end"),
        F.concat(F.lit("L"), i % 4).alias("place"),
    )
    return references.grouped(r).select("query_id", "document", "path", "url", "snippet", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"), F.array_join("places", "|").alias("places"))


# ---- texts and spelling ----------------------------------------------------------------


@query("""with s as (select doc_id, coalesce(text, '') as a, case doc_id % 3 when 0 then null when 1 then text else 'DOC: ' || source || chr(10) || 'LOC: ' || doc_id end as b from documents), m as (select doc_id, case when coalesce(b, '') = '' or contains(a, b) then a else a || chr(10) || b end as t from s)
select doc_id, length(t) as n, md5(t) as digest from m""")
def matching_text(spark, d):
    i = F.col("doc_id")
    b = F.when(i % 3 == 1, F.col("text")).when(i % 3 == 2, F.concat(F.lit("DOC: "), "source", F.lit("\nLOC: "), i))
    t = T.matching_text(F.col("text"), b)
    return read(spark, d, "documents").select("doc_id", F.length(t).cast("long").alias("n"), F.md5(t).alias("digest"))


STEM = "case when length(tok) <= 3 then tok when suffix(tok, 'ies') and length(tok) > 4 then left(tok, length(tok) - 3) || 'y' when suffix(tok, 'es') and length(tok) > 4 then left(tok, length(tok) - 2) when suffix(tok, 's') and not suffix(tok, 'ss') and length(tok) > 4 then left(tok, length(tok) - 1) else tok end"


@query(f"""with {UNITS}, v as (select distinct w as word from (select unnest({word_list('lower(text)')}) as w from units) where length(w) >= 3),
q as (select conv_id * 1000 + turn as query_id, {word_list(plain('text'))} as ws from conversations), e as (select query_id, unnest(ws) as tok, generate_subscripts(ws, 1) as pos from q where len(ws) <= 24),
o as (select distinct tok from e where length(tok) >= 4 and not regexp_full_match(tok, '[0-9]+') and tok not in {in_list(lexicon.OVERLAP_STOP + lexicon.KEEP_SHORT)} and tok not in (select word from v) and {STEM} not in (select word from v)),
b as (select tok, word from o join v on left(tok, 1) = left(word, 1) and abs(length(tok) - length(word)) <= 2 where regexp_full_match(tok, '[a-z]+') and regexp_full_match(word, '[a-z]+') and levenshtein(tok, word) <= 2 qualify row_number() over (partition by tok order by levenshtein(tok, word), word) = 1),
f as (select query_id, pos, tok, word, count(word) over (partition by query_id order by pos) as n from e left join b using (tok))
select query_id, string_agg(case when n <= 2 then coalesce(word, tok) else tok end, ' ' order by pos) as corrected from f group by query_id having max(n) > 0""")
def spelled_questions(spark, d):
    q = read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("question"))
    return retrieval.corrected(q, vocab(spark, d), lexicon.OVERLAP_STOP, lexicon.KEEP_SHORT)


# ---- replies ---------------------------------------------------------------------------

VARIANTS = ["", "Hello, ", "Good  Morning - ", "A.O.A ", "سلام ", "hi", "hi there", "What is your name", "naam kya hai", "CTO naam kya hai", "Who made you? ", "greetings "]
ALONE = (5, 6, 7, 8, 9)


def turns_with(spark, d):
    whole = [F.lit(v) if i in ALONE else F.concat(F.lit(v), "text") for i, v in enumerate(VARIANTS)]
    return read(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.array(*whole)).alias("variant", "said"))


TURNS = "g as (" + " union all ".join(f"select conv_id, turn, {i} as variant, '{v}'" + ("" if i in ALONE else " || text") + " as said from conversations" for i, v in enumerate(VARIANTS)) + ")"
URDU = r"regexp_matches(raw, '[\x{0600}-\x{06FF}]')"
AFTER = r"([^\p{L}\p{N}_]|$)"


@query(f"""with {TURNS}, r as (select *, {strip('said')} as raw from g), h as (select *, case when {URDU} then regexp_extract(raw, '^({lexicon.GREETINGS_URDU}){AFTER}', 1) else regexp_extract(raw, '(?i)^({lexicon.GREETINGS_LATIN}){AFTER}', 1) end as hello from r)
select conv_id, turn, variant, case when hello = '' then '' when {URDU} then '{lexicon.ACK_URDU}' when regexp_matches(lower(hello), '{lexicon.SALAM}') then '{lexicon.ACK_SALAM}' else '{lexicon.ACK}' end as ack, md5(case when hello = '' then raw else regexp_replace(substr(raw, length(hello) + 1), '^[ ,:\\-—–\n\t]+', '') end) as rest from h""")
def greeting_acks(spark, d):
    return turns_with(spark, d).select("conv_id", "turn", "variant", answers.acknowledged(F.col("said")).alias("x")).select("conv_id", "turn", "variant", "x.ack", F.md5("x.rest").alias("rest"))


GREETED = "(q in " + in_list(lexicon.GREETED) + " or (n <= 4 and (" + " or ".join(f"starts_with(q, '{g} ')" for g in lexicon.GREETED) + ")))"
ABOUT_ROLE = f"len(list_intersect(ws, [{', '.join(repr(w) for w in lexicon.ROLE_WORDS)}])) > 0"


@query(f"""with {TURNS}, r as (select conv_id, turn, variant, turn % 4 = 3 as has_history, {strip('lower(said)')} as q from g), w as (select *, {word_list('q')} as ws, len({word_list('q')}) as n from r)
select conv_id, turn, variant, case when not has_history and {GREETED} then 'greeting' when not has_history and not {ABOUT_ROLE} and ({any_sql('q', lexicon.IDENTITY)} or (n <= 4 and {any_sql('q', lexicon.IDENTITY_SHORT)})) then 'identity' when {any_sql('q', lexicon.MAKERS)} then 'creator' end as intent from w""")
def canned_intents(spark, d):
    return turns_with(spark, d).select("conv_id", "turn", "variant", answers.canned_intent(F.col("said"), F.col("turn") % 4 == 3).alias("intent"))


@query(f"""with {QTOKS}, c as (select q.query_id as case_id, toks, query_id % 3 = 0 as is_refusal, case query_id % 4 when 0 then 'Unfortunately that is not specified.' when 1 then 'Yeh available nahi hai' else d.text end as answer, case when query_id % 5 = 0 then 'refuse' else 'answer' end as decision from qt q join documents d on d.doc_id = q.query_id),
m as (select *, list_filter(toks, lambda k: not contains(lower(coalesce(answer, '')), k)) as missing from c)
select case_id, case when is_refusal then decision = 'refuse' or {any_sql("lower(coalesce(answer, ''))", lexicon.REFUSED)} else not {any_sql("lower(coalesce(answer, ''))", lexicon.REFUSED_PLAINLY)} and len(missing) = 0 end as passed, case when is_refusal then '' else array_to_string(missing, '|') end as missing from m""")
def eval_refusals(spark, d):
    i = F.col("query_id")
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("query_id"), "text")
    answer = F.when(i % 4 == 0, "Unfortunately that is not specified.").when(i % 4 == 1, "Yeh available nahi hai").otherwise(F.col("text"))
    decision = F.when(i % 5 == 0, "refuse").otherwise("answer")
    c = docs.join(retrieval.if_small(tokens(spark, d)), "query_id").select(i.alias("case_id"), answers.passed(answer, F.col("toks"), i % 3 == 0, decision).alias("x"))
    return c.select("case_id", "x.passed", "x.missing")


@query("""with s as (select conv_id, arg_min(text, turn) as t, count(*) as n from conversations group by conv_id), i as (select conv_id % 5 as owner, conv_id, case when length(t) >= 38 then left(t, 38) || '...' else t end as title, n as n_turns from s),
h as (select owner, conv_id, 'old' as title, 0 as n_turns, row_number() over (partition by owner order by conv_id) - 1 as place from i where conv_id % 2 = 0), v as (select *, conv_id * 7 % 11 as saved_at from i where conv_id % 3 > 0),
b as (select coalesce(h.owner, v.owner) as owner, coalesce(h.conv_id, v.conv_id) as conv_id, coalesce(v.title, h.title) as title, coalesce(v.n_turns, h.n_turns) as n_turns, h.place as p, v.saved_at as sa from h full join v on h.owner = v.owner and h.conv_id = v.conv_id)
select owner, conv_id, title, n_turns, row_number() over (partition by owner order by p is not null, case when p is null then -sa end, p, conv_id) - 1 as place from b""")
def session_upsert(spark, d):
    i = replies.sessions(read(spark, d, "conversations").select("conv_id", "turn", "text")).withColumn("owner", F.col("conv_id") % 5)
    h = retrieval.ranked(i.filter("conv_id % 2 = 0"), ("owner",), "conv_id").select("owner", "conv_id", F.lit("old").alias("title"), F.lit(0).cast("long").alias("n_turns"), (F.col("rn") - 1).cast("long").alias("place"))
    return replies.upserted(h, i.filter("conv_id % 3 > 0").withColumn("saved_at", F.col("conv_id") * 7 % 11))


# ---- upkeep ----------------------------------------------------------------------------

STORED = f"""{UNITS}, s as (select chunk_id, doc_name, chunk_id % 9 <> 0 as active, case when chunk_id % 2 = 0 then 2 else 1 end as v, {tag_sql('text')} as tags, 'Page ' || page as loc, text from units),
t as (select *, sha256('DOCUMENT: ' || doc_name || chr(10) || 'LOCATION: ' || loc || chr(10) || 'TAGS: ' || tags || chr(10) || text) as e, sha256('DOC: ' || doc_name || chr(10) || 'LOC: ' || loc || chr(10) || 'TAGS: ' || tags || chr(10) || text) as f, '/assets/data/' || replace(url_encode(doc_name), '%2F', '/') as p from s where active)"""


@query(f"with {STORED} select chunk_id, 2 as embed_version, 2 as search_version, e as embed_sha256, f as search_sha256, p as public_path, v <> 2 or chunk_id % 5 = 0 or chunk_id % 7 = 0 as refreshed from t")
def refreshed_rows(spark, d):
    i = F.col("chunk_id")
    s = units(spark, d).select("chunk_id", "doc_name", "text", (i % 9 != 0).alias("active"), T.tags(F.col("text"), TAGS).alias("tags"), F.concat(F.lit("Page "), "page").alias("loc_label"))
    parts = [F.col(c) for c in ("doc_name", "loc_label", "tags", "text")]
    stored = s.withColumns(
        {
            "embed_version": F.when(i % 2 == 0, 2).otherwise(1),
            "search_version": F.lit(C.search_version),
            "embed_sha256": F.when(i % 5 != 0, F.sha2(T.embed_text(*parts), 256)),
            "search_sha256": F.sha2(T.search_text(*parts), 256),
            "public_path": F.when(i % 7 == 0, F.col("doc_name")).otherwise(F.concat(F.lit(references.DATA_PATH), T.url_quoted(F.col("doc_name")))),
        }
    )
    return maintenance.refreshed(stored).select("chunk_id", "embed_version", "search_version", "embed_sha256", "search_sha256", "public_path", "refreshed")


@query("""select source || '.pdf' as filename, '/in/' || source || '.pdf' as path, coalesce(max(doc_id) filter (doc_id % 2 = 0), 0)::bigint as mtime, sum(n_chars)::bigint as size, 0::bigint as rank, 'pdf' as ext, sha256(source) as sha256, 2 as version, 2 as embed_text_version, 4500 as chunk_max_chars from documents where source is not null group by source""")
def manifest_rows(spark, d):
    g = read(spark, d, "documents").filter("source is not null").groupBy("source").agg(F.max(F.when(F.col("doc_id") % 2 == 0, F.col("doc_id"))).alias("mtime"), F.sum("n_chars").alias("size"))
    name = F.concat("source", F.lit(".pdf"))
    files = g.select(name.alias("filename"), F.concat(F.lit("/in/"), name).alias("path"), F.lit("pdf").alias("ext"), "mtime", "size", T.book_rank(name).alias("rank"), F.sha2("source", 256).alias("sha256"))
    return maintenance.manifest(files).select("filename", "path", "mtime", "size", "rank", "ext", "sha256", "version", "build.embed_text_version", "build.chunk_max_chars")

"""The queries of the engine on the driver's tables, each with DuckDB SQL for the same rows.

``documents`` stand for extracted units (source = document, id // 20 = page),
``embeddings`` for chunk vectors, ``benchmark`` for questions, ``conversations`` for
history, ``labels`` for gold. Words that occur in these texts take the lexicon's place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstone import lexicon
from quillstone.config import CONFIG as C
from quillstone.functions import text as T
from quillstone.operators import answers, blocked, chunking, keywords, lines, maintenance, postings, retrieval, vectors
from quillstone.plans import variants
from quillstone.sources.scratch import kept, new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TAGS = [("the", "definite"), ("of the", "genitive"), ("that|this", "pointing"), ("und", "german"), ("que", "romance"), ("licensed", "licence"), ("rights? reserved", "licence")]
MARKS = ["license", "rights reserved"]
KEEP = ["licensed", "reserved"]
STOP = ["the", "of", "and", "to", "in", "de", "la", "der", "die", "und"]
FIXES = {"the": "teh", "of": "ov", "and": "nad", "la": "al", "und": "nud"}

# DuckDB fragments
WS = r"[\x09-\x0D ]"
UNITS = "units as (select doc_id as chunk_id, source as doc_name, doc_id // 20 as page, text from documents)"
ASKED = "asked as (select item_id as query_id, text as question from benchmark)"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def clean(x: str) -> str:
    x = rf"regexp_replace(regexp_replace(regexp_replace({x}, '\x00+', ' ', 'g'), '\r\n?', chr(10), 'g'), '\n{{4,}}', chr(10) || chr(10) || chr(10), 'g')"
    return strip(f"array_to_string(list_transform(string_split({x}, chr(10)), lambda l: {strip('l')}), chr(10))")


def line_sql(x: str = "text") -> str:
    return f"list_filter(list_transform(string_split({x}, chr(10)), lambda l: {strip('l')}), lambda l: l <> '')"


def norm(x: str) -> str:
    return strip(rf"regexp_replace(regexp_replace(lower({x}), '[0-9]+', '0', 'g'), '{WS}+', ' ', 'g')")


def n_of(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def word_list(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> '')"


def in_list(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


LETTER = r"[A-Za-z\x{0600}-\x{06FF}]"
PAGE_NO = T.PAGE_NUMBER
LINES = f"{UNITS}, ls as (select chunk_id, doc_name, page, {line_sql()} as a from units), li as (select chunk_id, doc_name, page, unnest(a) as line, generate_subscripts(a, 1) - 1 as line_no from ls)"
ROWISH = rf"(length(line) >= 20 and regexp_matches(line, '\t|  ') and {n_of('line', '[A-Za-z0-9' + chr(92) + 'x{0600}-' + chr(92) + 'x{06FF}]{2,}')} >= 3)"
STRUCT = rf"((length(line) >= 18 and (regexp_matches(line, '\t') or {n_of('line', ' ' + chr(92) + '| ')} >= 2)) or regexp_matches(line, '{T.BULLET}'))"
HEAD = f"(regexp_matches(lower(line), '{T.HEADING}') or (line = upper(line) and line <> lower(line) and {n_of('line', '[A-Za-z]')} between 4 and 40))"
CAND = lambda x: f"({x} <> '' and length({x}) <= 120 and (regexp_matches(lower({x}), '{PAGE_NO}') or {n_of(x, LETTER)} <= 6 or " + " or ".join(f"contains(lower({x}), '{m}')" for m in MARKS) + "))"
PAIRS = "pairs as (select q.vec_id as query_id, e.vec_id, round(list_inner_product(q.embedding::double[], e.embedding::double[]), 6) as score from embeddings q join embeddings e on q.vec_id % 50 = 0 and q.vec_id <> e.vec_id)"
TOPK = lambda k: f"{PAIRS}, hits as (select * from pairs qualify row_number() over (partition by query_id order by score desc, vec_id) <= {k})"
NOT_WORD, NOT_PLAIN = r"[^\p{L}\p{N}_\x09-\x0D -]", r"[^a-z0-9\x{0600}-\x{06FF}\x09-\x0D ]"
PLAIN = f"regexp_replace(lower(question), '{NOT_WORD}', '', 'g')"
QTOKS = f"{ASKED}, qt as (select query_id, question, list_filter({word_list(PLAIN)}, lambda w: w not in {in_list(STOP)} and length(w) > 1) as toks from asked)"
SCAN = f"""{UNITS}, {QTOKS}, low as (select chunk_id, lower(text) as t from units),
sc as (select query_id, chunk_id, len(list_filter(toks, lambda w: contains(t, w))) as n_found, len(toks) as n, len(toks) > 1 and contains(t, array_to_string(toks, ' ')) as phrase from qt, low where len(toks) > 0),
kw as (select query_id, chunk_id, n_found::bigint as n_found, case when phrase then 0.75 when n_found = n then 0.65 when n_found >= 0.75 * n and n >= 3 then 0.6 when n_found >= 0.5 * n and n >= 2 then 0.55 end::double as score from sc where phrase or n_found = n or (n_found >= 0.75 * n and n >= 3) or (n_found >= 0.5 * n and n >= 2))"""


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def units(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_name"), F.floor(F.col("doc_id") / 20).cast("long").alias("page"), "text")


def asked(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def tokens(spark: SparkSession, d: str) -> DataFrame:
    return asked(spark, d).select("query_id", "question", T.query_words(F.col("question"), STOP).alias("toks"))


def hits(spark: SparkSession, d: str, k: int, wanted: DataFrame | None = None) -> DataFrame:
    """The k best of every vector whose id is divisible by 50, among all vectors; ``wanted`` (vec_id): of those that the result is joined with."""
    e = read(spark, d, "embeddings").select("vec_id", "embedding")
    q = e.filter("vec_id % 50 = 0")
    q = q if wanted is None else q.join(retrieval.if_small(wanted), "vec_id", "left_semi")
    return vectors.top_k(e, q.select(F.col("vec_id").alias("query_id"), "embedding"), k, block=C.query_block)


def question_hits(spark: SparkSession, d: str, k: int) -> DataFrame:
    """(query_id, chunk_id, score) for every question: those vectors in turn stand for the questions' own. A vector that stands for no question has no hits in the result, and is not searched for."""
    top = read(spark, d, "embeddings").agg(F.floor(F.max("vec_id") / 50).cast("long").alias("last"))
    mine = asked(spark, d).join(F.broadcast(top)).select("query_id", (50 * (F.col("query_id") % (F.col("last") + 1))).alias("vec"))
    found = hits(spark, d, k, mine.select(F.col("vec").alias("vec_id")).distinct()).withColumnRenamed("query_id", "vec")
    return found.join(retrieval.if_small(mine), "vec").select("query_id", F.col("vec_id").alias("chunk_id"), "score")


def unit_lines(spark: SparkSession, d: str) -> DataFrame:
    return units(spark, d).select("chunk_id", "doc_name", "page", F.posexplode(T.line_list(F.col("text"))).alias("line_no", "line"))


# ---- text ------------------------------------------------------------------------------


@query(f"with {UNITS} select chunk_id, {clean('text')} as cleaned from units")
def clean_text(spark, d):
    return units(spark, d).select("chunk_id", T.clean_general(F.col("text")).alias("cleaned"))


@query(rf"with {UNITS} select chunk_id, {strip('regexp_replace(' + clean('text') + r", '[ \t]+', ' ', 'g')")} as cleaned from units")
def clean_chunk_text(spark, d):
    return units(spark, d).select("chunk_id", T.clean_chunk(F.col("text")).alias("cleaned"))


@query(f"with {LINES} select chunk_id, line_no::int as line_no, line, {norm('line')} as norm from li")
def page_lines(spark, d):
    return unit_lines(spark, d).select("chunk_id", "line_no", "line", T.normal_line(F.col("line")).alias("norm"))


@query(f"with {LINES} select chunk_id, line_no::int as line_no, {CAND('line')} as candidate from li")
def header_footer_candidates(spark, d):
    return unit_lines(spark, d).select("chunk_id", "line_no", T.is_header_candidate(F.col("line"), MARKS).alias("candidate"))


REPEATED = f"""{LINES}, pages as (select doc_name, count(*) as pages from ls where len(a) > 0 group by all),
edge as (select doc_name, chunk_id, unnest(list_distinct(list_transform(list_filter(list_concat(a[1:2], list_reverse(a)[1:2]), lambda x: {CAND('x')}), lambda x: {norm('x')}))) as norm from ls where len(a) > 0),
rep as (select doc_name, norm, count(*) as n from edge join pages using (doc_name) group by doc_name, norm, pages having pages >= 3 and count(*) >= greatest(2, floor(pages * 0.6)))"""


@query(f"with {REPEATED} select * from rep")
def header_footer_repeated(spark, d):
    return lines.repeated_lines(units(spark, d), MARKS)


@query(f"""with {REPEATED}, g as (select li.chunk_id, line_no, line, rep.n is not null or regexp_matches(lower(line), '{PAGE_NO}') as gone from li left join rep on li.doc_name = rep.doc_name and {norm('line')} = rep.norm),
p as (select chunk_id, count(*) as n_lines, count(*) filter (not gone) as kept, string_agg(line, chr(10) order by line_no) as every, string_agg(line, chr(10) order by line_no) filter (not gone) as left_ from g group by all)
select chunk_id, n_lines, case when kept >= greatest(3, floor(n_lines * 0.25)) then kept else n_lines end as n_kept, md5(case when kept >= greatest(3, floor(n_lines * 0.25)) then left_ else every end) as digest from p""")
def strip_repeated_lines(spark, d):
    u = units(spark, d)
    made = lines.without_repeated(u, lines.repeated_lines(u, MARKS)).filter("n_lines > 0")
    return made.select("chunk_id", "n_lines", F.size("kept_lines").cast("long").alias("n_kept"), F.md5(F.array_join("kept_lines", "\n")).alias("digest"))


@query(rf"""with {LINES}, t as (select chunk_id, line_no::int as line_no, regexp_replace(line, ' (of|de|der) ', '   ', 'g') as line from li)
select chunk_id, line_no, {ROWISH} as is_row, {strip("regexp_replace(regexp_replace(" + strip('line') + r", '\t+', '  ', 'g'), '" + WS + r"{2,}', ' | ', 'g')")} as normal from t""")
def table_rows(spark, d):
    t = unit_lines(spark, d).withColumn("line", T.replaced(F.col("line"), " (of|de|der) ", "   "))
    return t.select("chunk_id", "line_no", T.looks_like_row(F.col("line")).alias("is_row"), T.normal_row(F.col("line")).alias("normal"))


JOINABLE = rf"{LINES}, jl as (select chunk_id, line_no, regexp_replace(regexp_replace(line, '\.$', ':'), '(en|er)$', '-') as line from li)"


@query(rf"""with {JOINABLE},
s as (select chunk_id, line_no, regexp_matches(line, '{T.BULLET}') or {ROWISH} as single, case when {ROWISH} and not regexp_matches(line, '{T.BULLET}') then {strip("regexp_replace(regexp_replace(" + strip('line') + r", '\t+', '  ', 'g'), '" + WS + r"{2,}', ' | ', 'g')")} else line end as line from jl),
b as (select *, lag(line) over w as prev, lag(single) over w as psingle from s window w as (partition by chunk_id order by line_no)),
c as (select *, coalesce(suffix(prev, '-') and not psingle, false) as hyphen, single or coalesce(psingle, true) or suffix(prev, ':') as brk from b),
g as (select *, sum((brk and not (hyphen and not single))::int) over (partition by chunk_id order by line_no) as seg from c)
select chunk_id, seg::bigint as seg, replace(replace(string_agg(line, chr(10) order by line_no), '-' || chr(10), ''), chr(10), ' ') as content from g group by chunk_id, seg""")
def join_lines(spark, d):
    shaped = T.replaced(T.replaced(F.col("line"), "\\.$", ":"), "(en|er)$", "-")
    return lines.joined_lines(unit_lines(spark, d).select("chunk_id", "line_no", shaped.alias("line")), "chunk_id")


BLOCKS = f"""bl as (select chunk_id, line_no, line, {STRUCT} as structured, {HEAD} as heading from li),
bm as (select *, coalesce(lag(structured) over (partition by chunk_id order by line_no) <> structured, true) or heading as brk from bl),
bs as (select *, sum(brk::int) over (partition by chunk_id order by line_no) as block from bm),
blocks as (select chunk_id, block::bigint as block, bool_or(structured) as structured, count(*) as n_lines, sum(length(line))::bigint as n_chars from bs group by chunk_id, block)"""


@query(f"with {LINES}, {BLOCKS} select * from blocks")
def block_segments(spark, d):
    found = units(spark, d).select("chunk_id", F.posexplode(chunking.block_segments(F.col("text"))).alias("at", "b"))
    return found.select("chunk_id", (F.col("at") + 1).cast("long").alias("block"), "b.structured", "b.n_lines", "b.n_chars")


@query(f"""with {LINES}, {BLOCKS}, o as (select chunk_id, line_no as block, length(line) as n_chars from li)
, w as (with recursive r as (
  select chunk_id, block, n_chars as size, 0 as chunk_no from o where block = 0
  union all
  select o.chunk_id, o.block, case when r.size + o.n_chars + 2 > 500 then o.n_chars else r.size + o.n_chars + 2 end, r.chunk_no + (r.size + o.n_chars + 2 > 500)::int
  from r join o on o.chunk_id = r.chunk_id and o.block = r.block + 1) select * from r)
select chunk_id, block::bigint as block, chunk_no::bigint as chunk_no from w""")
def pack_blocks(spark, d):
    sized = unit_lines(spark, d).select("chunk_id", F.col("line_no").cast("long").alias("block"), F.length("line").alias("n_chars"))
    return chunking.packed(sized, "chunk_id", "block", "n_chars", 500)


SLICES = f"""{UNITS}, sl as (select chunk_id, unnest(range(0, greatest(0, ceil((length(text) - 1000) / 800.0))::int + 1)) as slice_no, text from units),
pieces as (select chunk_id, slice_no::int as slice_no, substr(text, slice_no * 800 + 1, 1000) as piece from sl)"""


@query(f"with {SLICES} select chunk_id, slice_no, length(piece) as n, md5(piece) as digest from pieces")
def window_slices(spark, d):
    return chunking.window_slices(units(spark, d).select("chunk_id", "text"), "text", 1000, 200).select("chunk_id", "slice_no", F.length("piece").cast("long").alias("n"), F.md5("piece").alias("digest"))


@query(rf"""with {SLICES}, b as (select chunk_id, slice_no, right(lag(piece) over (partition by chunk_id order by slice_no), 120) as tail from pieces),
p as (select *, length(regexp_extract(tail, '^[\p{{L}}\p{{N}}_]*')) + 1 as pos from b)
select chunk_id, slice_no, coalesce(case when pos between 2 and 20 and pos <= length(tail) then regexp_replace(substr(tail, pos), '^{WS}+', '') else tail end, '') as overlap from p""")
def overlap_tail(spark, d):
    pieces = chunking.window_slices(units(spark, d).select("chunk_id", "text"), "text", 1000, 200)
    return chunking.with_overlap(pieces, "chunk_id", "slice_no", "piece", 120).select("chunk_id", "slice_no", "overlap")


@query(f"""with {SLICES}, f as (select *, count(*) over (partition by chunk_id) = 1 as alone, row_number() over (partition by chunk_id order by slice_no desc) = 1 as last from pieces)
select chunk_id, slice_no from f where length(piece) >= 200 or alone or {" or ".join(f"contains(lower(piece), '{k}')" for k in KEEP)} or (last and {n_of('piece', LETTER + '{3,}')} >= 10)""")
def kept_chunks(spark, d):
    pieces = chunking.window_slices(units(spark, d).select("chunk_id", "text"), "text", 1000, 200)
    return chunking.kept_chunks(pieces, "chunk_id", "slice_no", "piece", 200, KEEP).select("chunk_id", "slice_no")


@query(f"with {UNITS} select chunk_id, md5(case when not contains(lower(text), 'the of') then '[Role: the of]' || chr(10) || text else text end) as digest from units")
def role_context(spark, d):
    return units(spark, d).select("chunk_id", F.md5(chunking.with_context(F.col("text"), F.lit("the of"))).alias("digest"))


@query(rf"""with n as (select doc_id, case doc_id % 4 when 0 then 'book ' || doc_id || ' notes.pdf' when 1 then 'My Book' || doc_id || '.pdf' when 2 then 'notebook' || doc_id || '.pdf' else 'annex.pdf' end as name from documents)
select doc_id, name, coalesce(try_cast(regexp_extract(lower(name), '(?:^|[^a-z0-9_])book *([0-9]{{1,9}})', 1) as int), 0) as rank from n""")
def book_rank(spark, d):
    i = F.col("doc_id")
    name = F.when(i % 4 == 0, F.concat(F.lit("book "), i, F.lit(" notes.pdf"))).when(i % 4 == 1, F.concat(F.lit("My Book"), i, F.lit(".pdf"))).when(i % 4 == 2, F.concat(F.lit("notebook"), i, F.lit(".pdf"))).otherwise("annex.pdf")
    return read(spark, d, "documents").select("doc_id", name.alias("name")).select("doc_id", "name", T.book_rank(F.col("name")).alias("rank"))


LOWSIG = rf"""(t = '' or (not ({" or ".join(f"contains(lower(t), '{k}')" for k in KEEP)}) and (regexp_matches(lower(t), '{PAGE_NO}') or (length(t) <= 16 and regexp_matches(t, '^[0-9\p{{P}}\x09-\x0D ]+$')) or (length(t) < 60 and {n_of('t', LETTER + '{2,}')} < 6 and {n_of('t', LETTER)} < 25))))"""


@query(f"with {LINES}, x as (select chunk_id, line_no::int as line_no, {strip('line')} as t from li) select chunk_id, line_no, {LOWSIG} as low_signal from x")
def low_signal_filter(spark, d):
    return unit_lines(spark, d).select("chunk_id", "line_no", T.is_low_signal(F.col("line"), KEEP).alias("low_signal"))


def tag_sql(x: str) -> str:
    hits_ = ", ".join(rf"case when regexp_matches(lower({x}), '(^|[^\p{{L}}\p{{N}}_])({p})($|[^\p{{L}}\p{{N}}_])') then '{t}' end" for p, t in TAGS)
    flat = f"list_filter([{hits_}], lambda v: v is not null)"
    return f"array_to_string(list_filter({flat}, lambda v, i: list_position({flat}, v) = i), ',')"


@query(f"with {UNITS} select chunk_id, {tag_sql('text')} as tags from units")
def tag_multi_label(spark, d):
    return units(spark, d).select("chunk_id", F.array_join(T.tags(F.col("text"), TAGS), ",").alias("tags"))


@query(f"with {UNITS} select chunk_id, sha256('DOCUMENT: ' || doc_name || chr(10) || 'LOCATION: Page ' || page || chr(10) || 'TAGS: ' || {tag_sql('text')} || chr(10) || text) as embed_sha, sha256('DOC: ' || doc_name || chr(10) || 'LOC: Page ' || page || chr(10) || 'TAGS: ' || {tag_sql('text')} || chr(10) || text) as search_sha from units")
def embed_text_header(spark, d):
    loc = T.loc_label(F.lit("page"), F.col("page"), F.lit(None).cast("long"), F.lit(None).cast("string"))
    tags = T.tags(F.col("text"), TAGS)
    made = [F.sha2(f(F.col("doc_name"), loc, tags, F.col("text")), 256) for f in (T.embed_text, T.search_text)]
    return units(spark, d).select("chunk_id", made[0].alias("embed_sha"), made[1].alias("search_sha"))


@query("select doc_id, case when doc_id % 5 = 4 then case when doc_id % 2 = 0 then 'Section ' || source else '' end when doc_id % 3 = 0 then 'Page ' || doc_id else 'Pages ' || doc_id || '-' || doc_id + 2 end as label from documents")
def loc_labels(spark, d):
    i = F.col("doc_id")
    kind = F.when(i % 5 == 4, "section").otherwise("page")
    return read(spark, d, "documents").select("doc_id", T.loc_label(kind, i, F.when(i % 3 != 0, i + 2), F.when(i % 2 == 0, F.concat(F.lit("Section "), "source"))).alias("label"))


@query("select sha256(text) as digest, count(*) as n, min(doc_id) as first_id from documents group by 1 having count(*) > 1")
def content_hash_dups(spark, d):
    return read(spark, d, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


@query(f"""with {ASKED}, w as (select query_id, {word_list(strip(f"regexp_replace(regexp_replace(lower(question), '{NOT_PLAIN}', ' ', 'g'), '{WS}+', ' ', 'g')"))} as ws from asked),
k as (select query_id, list_filter(ws, lambda w: w not in {in_list(lexicon.OVERLAP_STOP)} and (length(w) >= 3 or w in {in_list(lexicon.KEEP_SHORT)})) as ws from w)
select query_id, array_to_string(list_transform(ws, lambda t: case when length(t) <= 3 then t when suffix(t, 'ies') and length(t) > 4 then left(t, length(t) - 3) || 'y' when suffix(t, 'es') and length(t) > 4 then left(t, length(t) - 2)
  when suffix(t, 's') and not suffix(t, 'ss') and length(t) > 4 then left(t, length(t) - 1) else t end), ' ') as stems from k""")
def stem_tokens(spark, d):
    return asked(spark, d).select("query_id", F.array_join(T.overlap_tokens(F.col("question"), lexicon.OVERLAP_STOP, lexicon.KEEP_SHORT), " ").alias("stems"))


FIX_CASE = " ".join(f"when lower(w) = '{k}' then case when left(w, 1) = upper(left(w, 1)) then upper(left('{v}', 1)) || substr('{v}', 2) else '{v}' end" for k, v in FIXES.items())


@query(f"with {ASKED} select query_id, array_to_string(list_transform({word_list('question')}, lambda w: case {FIX_CASE} else w end), ' ') as fixed from asked")
def typo_fix(spark, d):
    return asked(spark, d).select("query_id", T.fix_words(F.col("question"), FIXES).alias("fixed"))


ABB_CASE = " ".join(f"when lower(regexp_replace(w, '[^a-zA-Z]', '', 'g')) = '{k}' then '{v}'" for k, v in FIXES.items())


@query(f"with {ASKED} select query_id, array_to_string(list_transform({word_list('question')}, lambda w: case {ABB_CASE} else w end), ' ') || ' Schedule-' || ['I','II','III','IV','V','VI','VII','VIII','IX','X'][query_id % 10 + 1] as expanded from asked")
def abbrev_expand(spark, d):
    wide = F.concat(T.expand_words(F.col("question"), FIXES), F.lit(" schedule "), (F.col("query_id") % 10 + 1).cast("string"))
    return asked(spark, d).select("query_id", T.schedule_number(wide, lexicon.ROMAN).alias("expanded"))


@query(f"with {UNITS}, w as (select unnest({word_list('lower(text)')}) as w from units) select w as word, count(*) as n from w where length(w) >= 3 group by w")
def vocab(spark, d):
    return units(spark, d).select(F.explode(T.words_of(F.lower("text"))).alias("word")).filter("length(word) >= 3").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {UNITS}, v as (select w as word, count(*) as n from (select unnest({word_list('lower(text)')}) as w from units) where length(w) >= 3 group by w having regexp_full_match(w, '[a-z]+')),
{QTOKS}, t as (select tok from (select distinct unnest(toks) as tok from qt) where regexp_full_match(tok, '[a-z]+')), c as (select tok, word, levenshtein(tok, word) as dist from t join v on left(tok, 1) = left(word, 1) and abs(length(tok) - length(word)) <= 2 where tok <> word)
select tok, word, dist::int as dist from c where dist <= 2 qualify row_number() over (partition by tok order by dist, word) <= 3""")
def spell_candidates(spark, d):
    return retrieval.spelling(vocab(spark, d), tokens(spark, d))


# ---- vectors ---------------------------------------------------------------------------


@query(f"with {TOPK(30)} select * from hits")
def vec_topk(spark, d):
    return hits(spark, d, 30)


@query(f"with {TOPK(30)} select query_id, label, count(*) as n, max(score) as best from hits join embeddings using (vec_id) group by all")
def vec_topk_by_label(spark, d):
    labels = read(spark, d, "embeddings").select("vec_id", "label")
    return hits(spark, d, 30).join(labels, "vec_id").groupBy("query_id", "label").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best"))


@query("select vec_id, round(sqrt(list_inner_product(embedding::double[], embedding::double[])), 5) as norm, round(embedding[1]::double / (sqrt(list_inner_product(embedding::double[], embedding::double[])) + 1e-12), 5) as first_part from embeddings")
def vec_normalize(spark, d):
    e = read(spark, d, "embeddings")
    v = vectors.normalized(F.col("embedding"))
    size = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return e.select("vec_id", F.round(size, 5).alias("norm"), F.round(v[0], 5).alias("first_part"))


@query(ORACLES["vec_topk"])
def vec_topk_blocked(spark, d):
    """vec_topk with neither side on the driver."""
    e = read(spark, d, "embeddings").select("vec_id", "embedding")
    return blocked.top_k(e, e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 30)


@query(f"with {TOPK(30)} select query_id % 5 as query_id, vec_id, max(score) as score from hits group by 1, 2")
def vec_multi_query_max(spark, d):
    return vectors.best_of_variants(hits(spark, d, 30).withColumn("query_id", F.col("query_id") % 5))


@query(f"with {TOPK(30)}, m as (select *, max(score) over (partition by query_id) >= 0.4 as any_, row_number() over (partition by query_id order by score desc, vec_id) as rn from hits) select query_id, vec_id, score from m where (any_ and score >= 0.4) or (not any_ and score >= 0.2 and rn <= 14)")
def vec_threshold_fallback(spark, d):
    return vectors.thresholded(hits(spark, d, 30), 0.4, 0.2, C.fallback_hits)


# ---- retrieval -------------------------------------------------------------------------


@query(f"with {SCAN} select query_id, chunk_id, n_found, score from kw")
def keyword_scan(spark, d):
    return retrieval.keyword_scan(units(spark, d), tokens(spark, d), C.query_block)


def posted(spark, d):
    """The posting lists of all texts, built in the shared folder."""
    path = new_folder(spark, "postings")
    postings.add(units(spark, d), path)
    return postings.opened(spark, path)


@query(ORACLES["keyword_scan"])
def posted_scan(spark, d):
    return postings.search(posted(spark, d), units(spark, d), tokens(spark, d), C.query_block)


ASKED_HITS = lambda k: f"{PAIRS}, mine as (select query_id, 50 * (query_id % (select max(vec_id) // 50 + 1 from embeddings)) as vec from asked), best as (select * from pairs qualify row_number() over (partition by query_id order by score desc, vec_id) <= {k}), qhits as (select m.query_id, b.vec_id as chunk_id, b.score from mine m join best b on b.query_id = m.vec)"
SEM = f"{ASKED_HITS(30)}, sem as (select * from qhits)"
FUSED = "fu as (select k.query_id, k.chunk_id, round(k.score + coalesce(0.1::double * s.score, 0), 6) as score from kw k left join sem s using (query_id, chunk_id) qualify row_number() over (partition by k.query_id order by round(k.score + coalesce(0.1::double * s.score, 0), 6) desc, k.chunk_id) <= 10)"


def semantic(spark, d):
    return question_hits(spark, d, 30)


def fused(spark, d):
    return keywords.fused(units(spark, d), tokens(spark, d), semantic(spark, d), C.fusion_weight, C.keyword_hits, C.query_block)


@query(f"with {SCAN}, {SEM}, {FUSED} select query_id, chunk_id, score from fu")
def keyword_semantic_fusion(spark, d):
    return fused(spark, d)


WINDOW = "near as (select distinct h.query_id, u2.chunk_id, 0.14::double as score from {0} h join units u on u.chunk_id = h.chunk_id join units u2 on u2.doc_name = u.doc_name and abs(u2.page - u.page) between 1 and 3 where not exists (select 1 from {0} x where x.query_id = h.query_id and x.chunk_id = u2.chunk_id))"


@query(f"with {UNITS}, {PAIRS}, h as (select query_id, vec_id as chunk_id, score from pairs where vec_id in (select doc_id from documents) qualify row_number() over (partition by query_id order by score desc, vec_id) <= 10), {WINDOW.format('h')} select * from near")
def page_window_expand(spark, d):
    u = units(spark, d)
    e = read(spark, d, "embeddings").select("vec_id", "embedding")
    stored = e.join(u.select(F.col("chunk_id").alias("vec_id")), "vec_id", "left_semi")
    first = vectors.top_k(stored, e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), C.expanded_hits).withColumnRenamed("vec_id", "chunk_id")
    return retrieval.page_window(first, u, C.page_radius, C.similarity)


GROUPED = f"{SCAN}, {SEM}, {FUSED}, {WINDOW.format('fu')}, ev as (select query_id, chunk_id, score, false as is_context from fu union all select query_id, chunk_id, score, true from near)"


def evidence(spark, d):
    first = kept(fused(spark, d))  # ten hits a question, used three times
    u = units(spark, d)
    return first.withColumn("is_context", F.lit(False)).unionByName(retrieval.page_window(first, u, C.page_radius, C.similarity).withColumn("is_context", F.lit(True)))


@query(f"""with {GROUPED}, g as (select query_id, doc_name, count(*) as n_hits, coalesce(max(score) filter (not is_context), max(score)) as max_score, min(chunk_id) as first, string_agg(chunk_id::varchar, ',' order by chunk_id) as chunks from ev join units using (chunk_id) group by all)
select query_id, doc_name, n_hits, max_score, chunks, row_number() over (partition by query_id order by max_score desc, first) as doc_rank from g""")
def doc_grouping(spark, d):
    names = units(spark, d).select("chunk_id", "doc_name")
    return retrieval.by_document(evidence(spark, d).join(names, "chunk_id"))


@query(f"""with {SCAN}, {SEM}, {FUSED}, marked as (select chunk_id from units where contains(text, 'Licensed') and contains(text, 'the')),
need as (select query_id from asked where contains(lower(question), 'the') and query_id not in (select query_id from fu join marked using (chunk_id))) select query_id, chunk_id, 0.55::double as score from need, marked""")
def rule_injection(spark, d):
    wants = asked(spark, d).filter(F.contains(F.lower("question"), F.lit("the")))
    return retrieval.injected(fused(spark, d), wants, units(spark, d), ["Licensed", "the"], C.keyword_floor)


@query(f"with {SCAN}, {SEM} select query_id, chunk_id, max(score) as score from (select query_id, chunk_id, score from kw union all select * from sem) group by all")
def merged_routes(spark, d):
    return retrieval.merged(keyword_scan(spark, d), semantic(spark, d))


PLAIN_TEXT = lambda x: strip(f"regexp_replace(regexp_replace(lower({x}), '{NOT_PLAIN}', ' ', 'g'), '{WS}+', ' ', 'g')")
STEM = "case when length(t) <= 3 then t when suffix(t, 'ies') and length(t) > 4 then left(t, length(t) - 3) || 'y' when suffix(t, 'es') and length(t) > 4 then left(t, length(t) - 2) when suffix(t, 's') and not suffix(t, 'ss') and length(t) > 4 then left(t, length(t) - 1) else t end"


def stems(x: str) -> str:
    return f"list_transform(list_filter({word_list(x)}, lambda w: w not in {in_list(lexicon.OVERLAP_STOP)} and (length(w) >= 3 or w in {in_list(lexicon.KEEP_SHORT)})), lambda t: {STEM})"


PHRASES = ["the of", "of the", "in der"]
#: The 40 best hits of each question that have a text, with the overlap of the question's keywords and the text's tokens.
BLEND = f"""{UNITS}, {ASKED}, {ASKED_HITS(40)}, st as (select query_id, {stems(PLAIN_TEXT('question'))} as s from asked), ks as (select query_id, (list_filter(s, lambda v, i: list_position(s, v) = i))[1:12] as keys from st),
toks as (select chunk_id, doc_name, {stems(PLAIN_TEXT('text'))} as toks, {" + ".join(f"contains(lower(text), '{x}')::int" for x in PHRASES)} as phrases from units where chunk_id in (select chunk_id from qhits)),
ov as (select h.query_id, h.chunk_id, h.score, doc_name, phrases, len(list_intersect(keys, toks)) as overlap from qhits h join ks using (query_id) join toks using (chunk_id)),
bl2 as (select *, round(0.75::double * score + 0.25::double * least(overlap, 12) / 12, 8) as blend from ov)"""


def blended(spark, d):
    keys = asked(spark, d).select("query_id", T.keywords(F.col("question"), lexicon.OVERLAP_STOP, lexicon.KEEP_SHORT, 12).alias("keys"))
    low = F.lower("text")
    has = sum((F.contains(low, F.lit(p)).cast("int") for p in PHRASES), F.lit(0)).alias("phrases")
    h = retrieval.with_overlap(question_hits(spark, d, 40), keys, units(spark, d).select("chunk_id", "doc_name", "text", has), lexicon.OVERLAP_STOP, lexicon.KEEP_SHORT)
    return retrieval.blended(h, C.semantic_weight, C.overlap_cap)


@query(f"with {BLEND} select query_id, chunk_id, blend, overlap, row_number() over (partition by query_id order by blend desc, score desc, chunk_id) as rank from bl2")
def blend_rerank(spark, d):
    return retrieval.ranked(blended(spark, d), ("query_id",), F.desc("blend"), F.desc("score"), "chunk_id").select("query_id", "chunk_id", "blend", "overlap", F.col("rn").cast("long").alias("rank"))


@query(f"with {BLEND} select query_id, chunk_id from bl2 qualify row_number() over (partition by query_id, doc_name order by blend desc, chunk_id) <= 2 or score >= 0.26 or score >= 0.22 or overlap >= 1")
def soft_gate(spark, d):
    return retrieval.soft_gate(blended(spark, d), C.gate_per_doc, C.gate_score, C.gate_soft).select("query_id", "chunk_id")


@query(f"with {BLEND} select query_id, doc_name, chunk_id from bl2 qualify row_number() over (partition by query_id, doc_name order by blend desc, chunk_id) <= 15")
def per_doc_cap(spark, d):
    return retrieval.ranked(blended(spark, d), ("query_id", "doc_name"), F.desc("blend"), "chunk_id").filter(F.col("rn") <= C.hits_per_doc).select("query_id", "doc_name", "chunk_id")


@query(f"""with {BLEND}, g as (select query_id, doc_name, max(blend) as score from bl2 group by all),
r as (select *, row_number() over w as doc_rank, max(score) over (partition by query_id) as top, first(doc_name) over w as primary_doc from g window w as (partition by query_id order by score desc, doc_name))
select query_id, doc_name, score, primary_doc, doc_rank from r where score >= 0.8::double * top and doc_rank <= 8""")
def relative_keep(spark, d):
    g = blended(spark, d).groupBy("query_id", "doc_name").agg(F.max("blend").alias("score"))
    return retrieval.relative_keep(g, C.relative_keep, C.max_docs)


@query(f"""with {UNITS}, {QTOKS}, low as (select chunk_id, doc_name, lower(text) as t from units), o as (select query_id, chunk_id, doc_name, len(list_filter(toks, lambda w: contains(t, w))) as n, len(toks) > 1 and contains(t, array_to_string(toks, ' ')) as phrase from qt, low where len(toks) > 0),
s as (select query_id, chunk_id, doc_name, round(case when phrase then greatest(0.62, 0.4 + least(0.28, 0.05 * n)) else 0.4 + least(0.28, 0.05 * n) end::double, 6) as score from o where n >= 2),
p as (select * from s qualify row_number() over (partition by query_id, doc_name order by score desc, chunk_id) <= 3) select query_id, chunk_id, score from p qualify row_number() over (partition by query_id order by score desc, chunk_id) <= 80""")
def lexical_fallback(spark, d):
    return keywords.lexical(units(spark, d), tokens(spark, d), block=C.query_block)


INTENT_SQL = " union all ".join(f"select {i} as no, '{p}' as pattern, '{e}' as extra" for i, (_, p, e) in enumerate(lexicon.INTENTS))


@query(f"""with {ASKED}, w as (select query_id, 0 as variant, question as q from asked union all select query_id, 1, question || ' members of the schedule and required experience' from asked union all select query_id, 2, 'how to file a complaint' from asked), k as ({INTENT_SQL})
select query_id, variant, string_agg(extra, ' ' order by no) as extra from w join k on regexp_matches(lower(q), '(^|[^\\p{{L}}\\p{{N}}_])(' || pattern || ')($|[^\\p{{L}}\\p{{N}}_])') group by query_id, variant""")
def intent_terms(spark, d):
    q = F.col("question")
    kinds = F.posexplode(F.array(q, F.concat(q, F.lit(" members of the schedule and required experience")), F.lit("how to file a complaint"))).alias("variant", "q")
    return asked(spark, d).select("query_id", kinds).select("query_id", "variant", variants.intent_terms(F.col("q")).alias("extra")).filter("extra <> ''")


@query(f"with {ASKED}, v as (select query_id, 0 as pos, question as variant from asked union all select query_id, 1, lower(question) from asked union all select query_id, 2, upper(left(question, 1)) || substr(question, 2) from asked union all select query_id, 3, question || ' in context' from asked), u as (select query_id, min(pos) as pos, lower(trim(variant)) as k from v group by query_id, k) select u.query_id, v.variant, row_number() over (partition by u.query_id order by u.pos) as no from u join v on v.query_id = u.query_id and v.pos = u.pos qualify no <= 3")
def query_variants(spark, d):
    q = F.col("question")
    v = asked(spark, d).select("query_id", F.posexplode(F.array(q, F.lower(q), F.concat(F.upper(F.left(q, F.lit(1))), F.substr(q, F.lit(2))), F.concat(q, F.lit(" in context")))).alias("pos", "variant"))
    first = retrieval.ranked(v.withColumn("k", F.lower(F.trim("variant"))), ("query_id", "k"), "pos").filter("rn = 1").drop("rn")
    return retrieval.ranked(first, ("query_id",), "pos").filter(F.col("rn") <= C.max_variants).select("query_id", "variant", F.col("rn").cast("long").alias("no"))


# ---- answers ---------------------------------------------------------------------------


@query(f"""with {SCAN}, {SEM}, {FUSED}, s as (select f.query_id, f.chunk_id, f.score, len(list_filter(q.toks, lambda w: contains(lower(u.text), w))) as subject from fu f join units u using (chunk_id) join qt q using (query_id))
select query_id, chunk_id, subject, row_number() over (partition by query_id order by subject desc, score desc, chunk_id) as rank from s""")
def subject_boost_rank(spark, d):
    j = fused(spark, d).join(units(spark, d).select("chunk_id", F.lower("text").alias("low")), "chunk_id").join(retrieval.if_small(tokens(spark, d)), "query_id")
    s = j.withColumn("subject", answers.subject_matches(F.col("low"), F.col("toks")))
    return retrieval.ranked(s, ("query_id",), F.desc("subject"), F.desc("score"), "chunk_id").select("query_id", "chunk_id", "subject", F.col("rn").cast("long").alias("rank"))


@query(f"""with {SCAN}, {SEM}, {FUSED}, s as (select query_id, chunk_id, score, length(text) as size from fu join units using (chunk_id)),
r as (select query_id, chunk_id, row_number() over w as rank, sum(size) over (partition by query_id order by score desc, chunk_id rows unbounded preceding) as upto from s window w as (partition by query_id order by score desc, chunk_id))
select query_id, chunk_id, rank, upto::bigint as upto from r where rank <= 30 and upto <= 28000""")
def context_budget(spark, d):
    s = fused(spark, d).join(units(spark, d).select("chunk_id", F.length("text").alias("size")), "chunk_id")
    return retrieval.within_budget(s, "query_id", [F.desc("score"), "chunk_id"], "size", C.evidence_chars, C.evidence_parts).select("query_id", "chunk_id", F.col("rn").cast("long").alias("rank"), "upto")


REFS = f"{SCAN}, {SEM}, {FUSED}, refs as (select query_id, (row_number() over (partition by query_id order by score desc, chunk_id))::int as ref_id, doc_name, page, left(text, 200) as snippet from fu join units using (chunk_id)), ans as (select query_id, case when query_id % 3 = 0 then 'plain' else 'a [' || query_id % 4 + 1 || '] b [2] c [99]' end as answer from asked)"
CITED = "cited as (select * from refs where (query_id % 3 <> 0 and ref_id in (2, 99, query_id % 4 + 1)) or (query_id % 3 = 0 and ref_id <= 3))"


def references(spark, d):
    j = fused(spark, d).join(units(spark, d), "chunk_id")
    refs = retrieval.ranked(j, ("query_id",), F.desc("score"), "chunk_id").select("query_id", F.col("rn").alias("ref_id"), "doc_name", "page", F.left("text", F.lit(C.snippet_chars)).alias("snippet"))
    return refs


def said(spark, d):
    i = F.col("query_id")
    return asked(spark, d).select("query_id", F.when(i % 3 == 0, "plain").otherwise(F.concat(F.lit("a ["), (i % 4 + 1).cast("string"), F.lit("] b [2] c [99]"))).alias("answer"))


@query(f"with {REFS}, {CITED} select query_id, ref_id, doc_name, page, snippet from cited")
def citation_filter(spark, d):
    return answers.cited(said(spark, d), references(spark, d))


@query(f"with {REFS}, {CITED}, f as (select * from cited qualify row_number() over (partition by query_id, doc_name, page order by ref_id) = 1) select query_id, ref_id as source_rank, doc_name, page, row_number() over (partition by query_id order by ref_id) as display_id from f")
def page_dedup_renumber(spark, d):
    return answers.renumbered(answers.cited(said(spark, d), references(spark, d))).drop("snippet")


@query(f"with {REFS} select query_id, doc_name, min_by(snippet, ref_id) as snippet, string_agg(distinct page::varchar, ',' order by page::varchar) as pages from refs group by all")
def group_references(spark, d):
    return references(spark, d).groupBy("query_id", "doc_name").agg(F.min_by("snippet", "ref_id").alias("snippet"), F.array_join(F.sort_array(F.collect_set(F.col("page").cast("string"))), ",").alias("pages"))


@query(f"with {UNITS}, p as (select distinct doc_name, page from units), i as (select *, page - row_number() over (partition by doc_name order by page) as island from p), s as (select doc_name, min(page) as lo, max(page) as hi from i group by doc_name, island) select doc_name, string_agg(case when lo = hi then lo::varchar else lo || '–' || hi end, ', ' order by lo) as pages from s group by doc_name")
def page_ranges(spark, d):
    return answers.page_ranges(units(spark, d), ["doc_name"])


@query("with q as (select conv_id, case when conv_id % 2 = 0 then max_by(text, turn) filter (role = 'user') end as question from conversations group by conv_id) select conv_id, max_by(text, turn) filter (role = 'user' and text <> '' and (question is null or text <> question)) as last_question, max_by(text, turn) filter (role = 'assistant' and text <> '') as last_answer from conversations join q using (conv_id) group by conv_id")
def last_turn_pair(spark, d):
    """In every second conversation the last user turn is the question itself."""
    c = read(spark, d, "conversations")
    last = F.max_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))).over(W.partitionBy("conv_id"))
    return answers.last_pair(c.withColumn("question", F.when(F.col("conv_id") % 2 == 0, last)))


@query("with r as (select * from conversations where role in ('user', 'assistant') qualify row_number() over (partition by conv_id order by turn desc) <= 4), c as (select *, count(*) filter (role = 'assistant') over (partition by conv_id) as a, count(*) filter (role = 'assistant' and contains(lower(text), 'that')) over (partition by conv_id) as n from r) select conv_id, turn, role, text from c where n < a")
def history_gate(spark, d):
    return answers.usable_history(read(spark, d, "conversations"), ["that"], C.history_turns)


@query("select page_id, replace(url_encode(url), '%2F', '/') as quoted, string_split(url, '/')[-1] as base from pages")
def url_build(spark, d):
    return read(spark, d, "pages").select("page_id", T.url_quoted(F.col("url")).alias("quoted"), F.element_at(F.split("url", "/"), -1).alias("base"))


@query(r"select conv_id, turn, case when regexp_matches(text, '[\x{0900}-\x{097F}]') then 'unsupported' when regexp_matches(text, '[\x{0600}-\x{06FF}]') then 'urdu' when regexp_matches(lower(text), '(^|[^a-z])(kya|hai|hain|kaun|kon|kaise|kahan|mujhe|batao|nahi|aap)($|[^a-z])') then 'roman_urdu' else 'english' end as language from conversations")
def language_route(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", answers.language(F.col("text")).alias("language"))


@query(f"""with g as (select conv_id, turn, 0 as variant, text from conversations union all select conv_id, turn, 1, 'Hello, ' || text from conversations union all select conv_id, turn, 2, 'hi!' from conversations),
h as (select *, regexp_matches(lower(trim(text)), '^({lexicon.GREETINGS})([^a-z]|$)') as has, trim(regexp_replace(trim(text), '(?i)^({lexicon.GREETINGS})[ ,.!-]*', '')) as r from g)
select conv_id, turn, variant, case when trim(text) = '' or (has and r = '') then 'A' when has then 'B' else 'C' end as decision, case when trim(text) = '' or (has and r = '') then '' when has then r else trim(text) end as rest from h""")
def smalltalk_route(spark, d):
    said_ = F.posexplode(F.array(F.col("text"), F.concat(F.lit("Hello, "), "text"), F.lit("hi!"))).alias("variant", "said")
    return read(spark, d, "conversations").select("conv_id", "turn", said_).select("conv_id", "turn", "variant", answers.greeting_split(F.col("said"), lexicon.GREETINGS).alias("x")).select("conv_id", "turn", "variant", "x.decision", "x.rest")


@query(f"with {QTOKS}, c as (select q.query_id as case_id, q.toks, d.text as answer from qt q join documents d on d.doc_id = q.query_id) select case_id, len(list_filter(toks, lambda k: not contains(lower(answer), lower(k)))) = 0 as passed, array_to_string(list_filter(toks, lambda k: not contains(lower(answer), lower(k))), '|') as missing from c")
def eval_cases(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("answer"))
    return answers.checked(docs.join(retrieval.if_small(tokens(spark, d)), "query_id").select(F.col("query_id").alias("case_id"), F.col("toks").alias("keywords"), "answer"))


@query("select source, count(*) as n, count(*) filter (quality = 1) as passed, count(*) filter (quality is distinct from 1) as failed, round(avg((quality is not distinct from 1)::int::double), 6) as pass_rate from documents join labels using (doc_id) group by source")
def eval_pass_rate(spark, d):
    j = read(spark, d, "documents").select("doc_id", "source").join(read(spark, d, "labels"), "doc_id")
    return answers.summary(j.withColumn("passed", F.col("quality") == 1), "source")


# ---- maintenance -----------------------------------------------------------------------

VERSIONS = "scan as (select 'f' || user_id as filename, md5(string_agg(event_type, ',' order by event_id)) as sha256 from events where user_id % 10 <> 3 group by user_id), man as (select 'f' || user_id as filename, md5(string_agg(event_type, ',' order by event_id)) as sha256 from events where user_id % 10 <> 7 and event_id % 50 <> 1 group by user_id)"


def snapshot(spark, d, keep):
    e = read(spark, d, "events").filter(keep).groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))).alias("es"))
    return e.select(F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("filename"), F.md5(F.array_join(F.transform("es", lambda x: x["event_type"]), ",")).alias("sha256"))


@query(f"with {VERSIONS} select coalesce(s.filename, m.filename) as filename, case when m.filename is null then 'new' when s.filename is null then 'removed' when s.sha256 = m.sha256 then 'unchanged' else 'changed' end as status from scan s full join man m on s.filename = m.filename")
def manifest_diff(spark, d):
    return maintenance.manifest_diff(snapshot(spark, d, "user_id % 10 <> 3"), snapshot(spark, d, "user_id % 10 <> 7 and event_id % 50 <> 1"))


@query(f"with {UNITS} select chunk_id, doc_name, doc_name not in ('src1', 'src2') and chunk_id % 9 <> 0 as active, case when doc_name in ('src1', 'src2') and chunk_id % 9 <> 0 then 1700000000 when chunk_id % 9 = 0 then 5 end::bigint as deactivated_at from units")
def soft_delete(spark, d):
    rows = units(spark, d).select("chunk_id", "doc_name", (F.col("chunk_id") % 9 != 0).alias("active"), F.when(F.col("chunk_id") % 9 == 0, F.lit(5)).cast("long").alias("deactivated_at"))
    gone = spark.createDataFrame([("src1",), ("src2",)], "doc_name string")
    return maintenance.soft_deleted(rows, gone, "doc_name", F.lit(1_700_000_000).cast("long"))


@query("select vec_id from embeddings where vec_id not in (select doc_id from documents where source in ('src1', 'src2'))")
def purge_vectors(spark, d):
    gone = read(spark, d, "documents").filter("source in ('src1', 'src2')").select(F.col("doc_id").alias("vec_id"))
    return maintenance.purged(read(spark, d, "embeddings").select("vec_id"), gone, "vec_id")


@query("select max(doc_id) + 1 as lo, max(doc_id) + count(*) as hi, count(*) as n from documents")
def next_ids(spark, d):
    docs = read(spark, d, "documents").select("doc_id")
    made = maintenance.with_next_ids(docs, docs.select(F.col("doc_id").alias("chunk_id")), ["doc_id"])
    return made.agg(F.min("chunk_id").alias("lo"), F.max("chunk_id").alias("hi"), F.countDistinct("chunk_id").alias("n"))


@query("select coalesce(bool_or(doc_id % 3 <> 2), false) as stale_embed_version, coalesce(bool_or(2 <> 2), false) as stale_search_version from documents where doc_id % 9 <> 0")
def stale_version_flags(spark, d):
    rows = read(spark, d, "documents").select((F.col("doc_id") % 3).alias("embed_version"), F.lit(2).alias("search_version"), (F.col("doc_id") % 9 != 0).alias("active"))
    return maintenance.stale(rows, {"embed_version": C.embed_version, "search_version": C.search_version})


@query("with b as (select distinct strftime(ts, 'build_%Y%m%d') as build_id from events), r as (select *, row_number() over (order by build_id desc) as rn, build_id = (select min(build_id) from b) as act from b) select build_id from r where rn > 3 and not act")
def retention(spark, d):
    b = read(spark, d, "events").select(F.date_format("ts", "'build_'yyyyMMdd").alias("build_id")).distinct()
    first = b.agg(F.min("build_id").alias("first"))
    return maintenance.to_delete(b.join(F.broadcast(first)).select("build_id", (F.col("build_id") == F.col("first")).alias("is_active")), C.builds_kept)


@query("select conv_id, turn, role, text from conversations qualify row_number() over (partition by conv_id order by turn desc) = 1")
def chat_upsert(spark, d):
    c = read(spark, d, "conversations")
    return retrieval.ranked(c, ("conv_id",), F.desc("turn")).filter("rn = 1").drop("rn").select("conv_id", "turn", "role", "text")


# ---- relational breadth ----------------------------------------------------------------


@query("select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by all")
def pricing_summary(spark, d):
    li = read(spark, d, "lineitem").filter("l_shipdate <= timestamp '1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


@query("select time_bucket(interval 1 hour, ts) as hour, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def tumbling_events(spark, d):
    e = read(spark, d, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("hour"), "event_type", "n", "total")


@query("select event_type, user_id % 3 as g, count(*) as n from events group by cube (event_type, user_id % 3)")
def cube_events(spark, d):
    return read(spark, d, "events").withColumn("g", F.col("user_id") % 3).cube("event_type", "g").agg(F.count(F.lit(1)).alias("n"))
